"""What op5's training passes move between Spark and its workers, and that the cheaper ways give the same numbers."""

import numpy as np
import pyarrow as pa

from hirelake.llm import lm_scoring


def test_training_reads_no_row_for_each_pair(spark, monkeypatch):
    """Each round reads the whole table of pairs, so it is stored with many pairs to a row, and none is lost."""
    stored, cut = [], lm_scoring.cut

    def watched(df):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(lm_scoring, "cut", watched)
    docs = spark.createDataFrame([(" ".join(f"w{(i * k) % 97}" for k in range(60)),) for i in range(90)], "text string")
    vocabulary = [lm_scoring.END, *(f"w{k}" for k in range(97))]
    pairs = lm_scoring.count_pairs(docs, vocabulary)
    lm_scoring.train(pairs, np.ones(100), np.ones(100))
    told = sorted(map(tuple, pairs.collect()))
    rows = [r for df in stored for r in df.collect()]
    assert len(told) > 2000 and len(rows) <= 64
    numbers = [[np.frombuffer(r[name], kind) for r in rows] for name, kind in (("context", np.int32), ("target", np.int32), ("n", np.int64))]
    assert sorted(zip(*(np.concatenate(x).tolist() for x in numbers), strict=True)) == told
    assert sum(r["pairs"] for r in rows) == len(told)


def test_texts_are_split_as_tokens():
    odd = ["", None, " ", "\t lead", "trail \n", "The THE the", "É é İ ẞ \xa0x y", "".join(chr(i) + "A" for i in range(256)), "a\x00b \x1c \x1d\x85 c", "😀 x" * 3]
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array([*odd, "left out", *odd], kind)
        for part in (texts, texts.slice(3, 9)):
            words, n = lm_scoring.split(part)
            known = pa.array([lm_scoring.END, "the", "x"], pa.string())
            ids, ends = lm_scoring.with_ends(lm_scoring.places(words, known, 9), n, 0)
            want = [lm_scoring.tokens(t) for t in part.to_pylist()]
            assert [w.encode() for w in words.to_pylist()] == [w for t in want for w in t[:-1]]
            assert n.tolist() == [len(t) - 1 for t in want] and ends.tolist() == np.cumsum([len(t) for t in want]).tolist()
            assert ids.tolist() == [{lm_scoring.END.encode(): 0, b"the": 1, b"x": 2}.get(w, 9) for t in want for w in t]


def test_pieces_hold_all_rows(monkeypatch):
    monkeypatch.setattr(lm_scoring, "BYTES", 10)
    texts = ["abcd", None, "x" * 35, "", "", "efgh ijkl", "m"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])]
    got = [b.column("text").to_pylist() for b in lm_scoring.pieces(batches)]
    assert [t for b in got for t in b] == texts and len(got) > 1
    sizes = [[len(t or "") for t in b] for b in got]
    assert all(sum(x) - max(x) <= 10 for x in sizes)


def test_a_step_follows_the_gradient():
    """A minibatch with repeated classes against sums over its pairs, one by one."""
    rng, size, d = np.random.default_rng(3), 7, lm_scoring.DIMENSIONS
    model = lm_scoring.Model(rng.integers(1, 50, size).astype(float), rng.integers(1, 50, size).astype(float), 30)
    c, t, y = rng.integers(0, size, 20), rng.integers(1, size, 20), rng.integers(1, size, lm_scoring.SHARED)
    w = rng.random(20).astype(np.float32)
    own, to, squares = model.own.astype(float), model.to.astype(float), model.squares.astype(float)
    grad_own, grad_to = np.zeros_like(own), np.zeros_like(to)
    for i in range(20):
        for j, weight, real in [(t[i], w[i], 1), *((k, w[i] * lm_scoring.NOISE / lm_scoring.SHARED, 0) for k in y)]:
            off = weight * (1 / (1 + np.exp(model.base[j] - own[c[i]] @ to[j, :d] - to[j, d])) - real)
            grad_own[c[i]] += off * to[j, :d]
            grad_to[j] += off * np.append(own[c[i]], 1)
    seen = np.zeros((2, size))
    model._step(c, t, w, y, seen)
    for k, (table, before, grad) in enumerate([(model.own, own, grad_own), (model.to[:, :d], to[:, :d], grad_to[:, :d]), (model.to[:, d:], to[:, d:], grad_to[:, d:])]):
        new = squares[k] + (grad**2).mean(axis=1)
        assert np.allclose(model.squares[k], new, rtol=1e-3)
        assert np.allclose(table, before - lm_scoring.RATE * grad / np.sqrt(new)[:, None], atol=1e-4)
    assert np.array_equal(seen[0] > 0, np.isin(np.arange(size), c)) and np.array_equal(seen[1] > 0, np.isin(np.arange(size), [*t, *y]))
