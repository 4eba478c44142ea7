"""Edit fingerprints against a walk character by character, a plain pass over neighbours, and pairs of near copies."""

import hashlib

import numpy as np
import pytest

from hirelake.llm import edit_prints

rng = np.random.default_rng(4)


def prose(n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


LONG = prose(9000)
TEXTS = [None, "", "a", "ab", "é漢🙂", "x" * 5000, prose(40), prose(300), LONG, LONG[:20000] + "!" + LONG[20000:], prose(30), prose(30)]


def stepped(text):
    """The embedded string, one time after another, from the table of steps alone."""
    chars, table, out, t = edit_prints.codes(text), edit_prints._steps(), [], 0
    for c, row in zip(chars.tolist(), edit_prints._rows(chars).tolist(), strict=True):
        stay = table[row + t % edit_prints.PERIOD]
        out += [c] * stay
        t += stay
    return out


@pytest.mark.parametrize("lanes", [1, 24, 1000])
def test_walkers_in_step_equal_one_walker(monkeypatch, lanes):
    monkeypatch.setattr(edit_prints, "LANES", lanes)
    chars = [edit_prints.codes(t or "") for t in TEXTS * 3]
    for text, times in zip(TEXTS * 3, edit_prints.walk_all(chars), strict=True):
        embedded = stepped(text or "")
        assert times[-1] == len(embedded) and all(embedded[t] == c for t, c in zip(times[:-1].tolist(), edit_prints.codes(text or "").tolist(), strict=True))


def test_samples_read_and_compare():
    for scale in range(1, 20):
        at, before = edit_prints.sample_times(scale), edit_prints.sample_times(scale - 1)
        assert len(set(at.tolist())) == min(edit_prints.SAMPLES, 1 << scale) and at.max() < 1 << scale
        assert set(at[at < 1 << (scale - 1)].tolist()) <= set(before.tolist())
    prints = edit_prints.prints_of(TEXTS)
    assert all(edit_prints.written(*edit_prints.read(p)) == p for p in prints) and prints[0] == prints[1]
    assert edit_prints.similarity(prints[0], prints[1]) == 1.0 and edit_prints.similarity(prints[1], prints[2]) == 0.0
    half = LONG[: len(LONG) // 2] + prose(9000)[: len(LONG) // 2]
    near, one, other = edit_prints.prints_of([half, LONG, prose(9000)])
    assert 0.35 < edit_prints.similarity(near, one) < 0.75 and edit_prints.similarity(one, other) < 0.2


def docs_of(spark, rows, parts):
    return spark.createDataFrame([(i, t, "y", 0.5) for i, t in rows], "doc_id long, text string, fingerprint string, near_next double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_edits_equal_a_plain_pass(spark, parts):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(900 + i, prose(5)) for i in range(60)]
    got = {r["doc_id"]: r for r in edit_prints.with_edits(docs_of(spark, rows, parts)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        own, after = t or "", after or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        p, q, r = edit_prints.prints_of([own, edited, after])
        want = (len(own), hashlib.sha256(edited.encode()).hexdigest(), p, q, edit_prints.similarity(p, q), edit_prints.similarity(p, r))
        assert tuple(got[i][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want


def test_edits_of_one_none_repeated_and_nameless(spark):
    assert edit_prints.with_edits(docs_of(spark, [], 1)).count() == 0
    one = edit_prints.with_edits(docs_of(spark, [(1, "abcdef")], 1)).collect()
    assert [(r["n_chars"], r["edited_sha256"], r["near_next"]) for r in one] == [(6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    rows = [(None, "no id"), (1, "same text"), (1, "same text"), (2, None)]
    got = edit_prints.with_edits(docs_of(spark, rows, 2)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 5), (1, 9), (1, 9), (2, 0)]


def test_near_classes_hold_copies_and_leave_others(spark):
    base = [prose(200) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:-1] + "#") for i, t in enumerate(base)] + [(200 + i, base[0]) for i in range(40)] + [(300, None), (301, ""), (None, base[1])]
    found = edit_prints.near_classes(edit_prints.fingerprints(docs_of(spark, rows, 3))).collect()
    classes = {r["doc_id"]: r["class_id"] for r in found}
    assert len(found) == len(rows) and all(classes[i] == classes[100 + i] == i for i in range(12))
    assert all(classes[200 + i] == 0 for i in range(40)) and classes[300] == classes[301] == 300 and classes[None] == 1
    prints = {r["doc_id"]: r["fingerprint"] for r in found if r["doc_id"] is not None}
    ids = sorted(prints)
    pairs = [(a, b) for a in ids for b in ids if a < b and edit_prints.similarity(prints[a], prints[b]) >= edit_prints.NEAR]
    assert sum(classes[a] == classes[b] for a, b in pairs) >= 0.95 * len(pairs)


def spoilt(text, share):
    """The text with single letters replaced or left out, at random places."""
    letters = [("" if draw < share / 2 else "#") if draw < share else c for c, draw in zip(text, rng.random(len(text)), strict=True)]
    return "".join(letters)


@pytest.mark.parametrize("tile, small", [(8192, 32), (5, 2)])
def test_near_classes_equal_the_links_of_all_pairs(spark, monkeypatch, tile, small):
    """Texts spoilt in many places, cut short across scales, and short ones: classes are what all near pairs connect."""
    monkeypatch.setattr(edit_prints, "TILE", tile)
    monkeypatch.setattr(edit_prints, "SMALL", small)
    texts = [spoilt(t, share) for t in [prose(12), prose(60), prose(300)] for share in (0.01, 0.02, 0.04, 0.06, 0.08, 0.1) for _ in range(12)]
    texts += [text[:n] for text in (prose(40), prose(400)) for n in range(100, len(text), len(text) // 25)]
    texts += [("abcdefghijklmnopqrstuvwxyz" * 2)[:n] for n in range(1, 50)]
    texts += [spoilt(t, 0.1) for t in [prose(4)] * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = edit_prints.near_classes(edit_prints.fingerprints(docs_of(spark, rows, 3))).collect()
    prints, least = {r["doc_id"]: r["fingerprint"] for r in found}, list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(least)
        if not _:
            near = [(a, b) for a in prints for b in prints if a < b and edit_prints.similarity(prints[a], prints[b]) >= edit_prints.NEAR]
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert len(near) > 1000 and {r["doc_id"]: r["class_id"] for r in found} == dict(enumerate(least))


def test_blocks_of_all_near_lengths_agree():
    """A pair of n and m digits at the limit of differing ones shares a block, wherever they differ."""
    for near in (0.5, 0.8, 0.95):
        for m in range(1, edit_prints.SAMPLES + 1):
            for n in range(max(m - edit_prints.most_differing(m, near), 1), m + 1):
                shared = set(edit_prints.widths(n, near)) & set(edit_prints.widths(m, near))
                assert any(n // w > edit_prints.most_differing(m, near) - (m - n) for w in shared)
