"""Hard negatives and whitening against brute force; edge cases of both."""

import math

import numpy as np
import pytest

from hirelake.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, rank int, component string"  # clashing names


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "x", 0, "c") for i, v, y in rows], SCHEMA).repartition(parts)


def sound(rows):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def by_id(i):
    return (i is None, i or 0)


def brute(rows, every=10):
    rows, out = [r for r in sound(rows) if r[2] is not None], []
    for at, (i, x, y) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(x, z, strict=False)), j, w) for k, (j, z, w) in enumerate(rows) if k != at]
        best = lambda found: sorted(found, key=lambda s: (-s[0], by_id(s[1])))
        for p, pid, _ in best([s for s in scored if s[2] == y])[:5]:
            inside = [s for s in scored if s[2] != y and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, pid, r, j, p, s) for r, (s, j, _) in enumerate(best(inside)[:10], 1)]
    return sorted(out, key=lambda r: [by_id(v) for v in r])


def mined(frame, every=10):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % every == 0).collect()), key=lambda r: [by_id(v) for v in r])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = [(i, (rng.integers(-3, 4, 6) / 8).tolist(), int(rng.integers(0, 3))) for i in range(400)]  # many ties
    made += [(500 + i, [0.25] * 6, i % 2) for i in range(300)]  # a third of all rows are one vector
    made += [made[10], made[10], (7, [0.5] * 6, 1), (None, [0.5] * 6, 2), (None, [0.75] * 6, 0), (800, [0.5, 0.5], 1), (810, [], 1)]
    return [*made, (820, None, 1), (830, [None] * 6, 1), (840, [float("nan")] * 6, 1), (850, [float("inf")] * 6, 1), (860, [0.5] * 6, None)]


def test_hard_negatives_equal_brute_force(spark, rows):
    got = mined(table(spark, rows))
    assert got == brute(rows) and len(got) > 1000
    assert got == mined(table(spark, rows[::-1], 7))


def test_hard_negatives_of_small_trees_and_large_numbers(spark, monkeypatch):
    rng = np.random.default_rng(6)
    far = [(i, (rng.standard_normal(5) * (1e6 if i % 3 else 1)).tolist(), i % 4) for i in range(120)]
    assert mined(table(spark, far)) == brute(far)
    one = [(0, [1.0, 2.0], 1)]
    assert mined(table(spark, one)) == [] and mined(table(spark, [])) == []


def test_tiles_and_search_drop_boxes():
    rng = np.random.default_rng(7)
    x, labels = rng.integers(-200, 200, (3000, 8)), np.sort(rng.integers(0, 3, 3000))
    leaves = hard_negatives.tiles(x, labels, 64)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) <= 64
    tree = hard_negatives.Tree([{"ids": r, "named": np.ones(len(r), bool), "labels": labels[r], "x": x[r]} for r in leaves], 8, 200)
    opened = []
    for leaf in tree.leaves:
        leaf["x"] = type("Seen", (np.ndarray,), {"__matmul__": lambda s, o: opened.append(1) or np.asarray(s) @ o})(leaf["x"].shape, float, leaf["x"].tobytes())
    for q in rng.integers(-200, 200, (20, 8)):
        want = hard_negatives.Wanted(10, -20000, 30000)
        tree.search(q.astype(float), 1, False, [want])
        scores = x @ q
        right = sorted((-s, False, i) for i, s in enumerate(scores.tolist()) if labels[i] != 1 and -20000 <= s <= 30000)[:10]
        assert want.rows == right
    assert len(opened) < 20 * len(leaves)


def test_whitening_equals_the_library_solver(spark):
    rng = np.random.default_rng(8)
    base = (rng.standard_normal((300, 9)) @ np.diag([3, 2, 1.5, 1.4999, 1, 1, 1, 0.5, 0.1])).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(base)] + [(i, base[0], 0) for i in range(200)] + [(None, base[1], 0), (901, [0.5], 1), (902, None, 1), (903, [None] * 9, 1), (904, [float("-inf")] * 9, 1)]
    got = whitening.whiten(table(spark, rows)).collect()
    kept = sound(rows)
    padded = [tuple(x + [0] * (9 - len(x))) for _, x, _ in kept]
    fit = np.array(sorted(set(padded)))
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    want = {}
    for (i, _, _), x in zip(kept, padded, strict=True):
        want.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True)), (np.array(x) - total / n) @ vectors[:, :4] / np.sqrt(values[:4])))
    sign = {}
    for r in got:
        k = r["component"] - 1
        near = [(d, w[k]) for d, w in want[r["vec_id"]] if d == r["deviation"]]
        assert near and any(abs(abs(w) - abs(r["whitened"])) < 1e-9 for _, w in near)
        if abs(r["whitened"]) > 1e-6 and len(near) == 1:
            assert sign.setdefault(k, np.sign(r["whitened"] * near[0][1])) == np.sign(r["whitened"] * near[0][1])
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_flat_equal_huge_and_no_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0  # no spread, no component
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i], 0) for i in range(20)])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    huge = whitening.whiten(table(spark, [(1, [1e12, 0.0], 0), (2, [0.0, 1e12], 0), (3, [3e30, 1.0], 0)])).collect()
    assert {(r["vec_id"], r["deviation"]) for r in huge} == {(1, None), (2, None)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 40])
def test_eigenpairs_with_repeated_eigenvalues(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    spectrum = np.sort(rng.choice([5.0, 5.0, 2.0, 2.0000001, 1.0], n))[::-1]
    a = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.eigenpairs((a + a.T) / 2)
    assert np.allclose(values, spectrum[:4], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12)
