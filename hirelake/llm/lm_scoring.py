"""Scoring by a log-bilinear language model trained with noise-contrastive estimation, in numpy.

Each token that occurs LEAST_COUNT times in the training documents has vectors of its own, so the model grows with the
corpus; up to FEWEST_WORDS of the most frequent tokens have them at any size, and the others are one class. Spark counts the
pairs of neighbouring model tokens of all training documents and keeps them as a table, many pairs to a row. In each round
the tasks run over minibatches of their part of the table, with sampled noise, and what they changed is averaged. Each
context is normalised over all targets, in blocks. A token is scored by its predecessor; a rarer token's probability
is its class's times its smoothed share of the class.

Frequent tokens' counts (FREQUENT at most, besides the model's) are broadcast; the others meet their counts in a
shuffle join.
Cases: null and empty texts are one end token; tokens that training didn't see count as zero; with no training
documents counts are zero and the model is its starting values; repeated rows get equal results; extra columns are not
read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, cut, held_out, levels, shuffles_removed, table

FOLDS = 5
#: Tokens of this count have vectors of their own, and the most frequent ones whatever their count; besides, there are
#: one class for the others, and the start of a text as a context.
LEAST_COUNT, FEWEST_WORDS = 100, 1022
DIMENSIONS = 24
NOISE = 10
#: Rounds of training; pairs of a minibatch; noise targets that its pairs share; visits of pairs in a round, at least
#: (few pairs are passed over up to MOST_PASSES times); rows of a block of vectors; contexts that are
#: normalised together; step size.
ROUNDS, BATCH, SHARED, LEAST_VISITS, MOST_PASSES, BLOCK, CONTEXTS, RATE = 4, 1024, 10 * NOISE, 2_000_000, 50, 8192, 256, 0.1
#: Pairs in a row of their table, besides a batch of Arrow's, and rows of it that a worker gets at a time.
GATHERED, PACKS = 64 * BATCH, 16
#: Tokens, or pairs of them, that a task counts before it hands them on, besides a piece of a batch.
COUNTED = 2_000_000
#: Tokens whose counts are broadcast, at most, besides the model's.
FREQUENT = 100_000
#: Rows of a batch in a worker; bytes of text that are split together (a document's more), and tokens scored together.
ROWS, BYTES, PIECE = 1000, 8_000_000, 65_536
#: The end of a text among the tokens; no word holds a space.
END = " "


def tokens(text: str | None) -> list[bytes]:
    """The UTF-8 words and the end; bytes, so that lower-casing and splitting touch ASCII alone."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END.encode()]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as tokens() has them but for the ends, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)  # white space before and after a text leaves empty words
    keep = full.to_numpy(zero_copy_only=False)
    if keep.all():
        return words, n
    return words.filter(full), np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))


def places(words: pa.Array, known: pa.Array, other: int) -> np.ndarray:
    """Each word's place among the known ones; other for a word that is not known."""
    return pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), other).to_numpy(zero_copy_only=False).astype(np.int64)


def with_ends(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids with each text's end behind its n words, and the places behind the ends."""
    out = np.full(len(ids) + len(n), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, np.cumsum(n + 1)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where BYTES of text are reached."""
    for b in batches:
        size = pc.binary_length(pc.fill_null(b.column("text"), "")).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // BYTES, prepend=-1))
        for first, last in zip(starts, np.append(starts[1:], len(b))[: len(starts)], strict=True):
            yield b.slice(first, last - first)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) of docs(text), counted in pieces before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.Array], ends: int) -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held))
            tokens = pa.concat_arrays([found.field(0), pa.array([END], found.field(0).type)])
            return pa.RecordBatch.from_arrays([tokens, pa.concat_arrays([found.field(1), pa.array([ends], pa.int64())])], ["token", "c"])

        held, ends = [], 0
        for b in pieces(batches):
            held.append(split(b.column("text"))[0])
            ends += len(b)
            if sum(map(len, held)) >= COUNTED:
                yield told(held, ends)
                held, ends = [], 0
        if held:
            yield told(held, ends)

    return docs.select("text").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def count_pairs(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(context, target, n): neighbouring classes of docs(text); the start is class 0, the others' class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))
    size = len(vocabulary) + 2
    end = vocabulary.index(END) + 2 if END in vocabulary else 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys // size).astype(np.int32)), pa.array((keys % size).astype(np.int32)), pa.array(n)], ["context", "target", "n"])

        held: list[np.ndarray] = []
        for b in pieces(batches):
            words, n = split(b.column("text"))
            ids, ends = with_ends(places(words, shared.value, -1) + 2, n, end)
            before = np.append(0, ids[:-1])
            before[ends[:-1]] = 0
            held.append(before * size + ids)
            if sum(map(len, held)) >= COUNTED:
                yield told(held)
                held = []
        if held:
            yield told(held)

    return docs.select("text").mapInArrow(count, "context int, target int, n long").groupBy("context", "target").agg(F.sum("n").alias("n"))


def packed(pairs: DataFrame) -> DataFrame:
    """pairs(context, target, n) with GATHERED pairs to a row: their number, and each column's numbers as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            all_pairs = pa.Table.from_batches(held)
            columns = [pa.array([all_pairs.column(name).to_numpy().tobytes()], pa.binary()) for name in ("context", "target", "n")]
            return pa.RecordBatch.from_arrays([pa.array([len(all_pairs)], pa.int64()), *columns], ["pairs", "context", "target", "n"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= GATHERED:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    return pairs.select("context", "target", "n").mapInArrow(pack, "pairs long, context binary, target binary, n binary")


def _runs(ids: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    first = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=first[1:])
    return np.flatnonzero(first)


def _sums(g: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of g, in order, from each start to the next; most runs have one row, which is taken as it is."""
    out, sizes = g.take(order[starts], axis=0), np.append(starts[1:], len(order)) - starts
    many = sizes > 1
    if many.any():
        out[many] = np.add.reduceat(g.take(order[np.repeat(many, sizes)], axis=0), np.cumsum(sizes[many]) - sizes[many], axis=0)
    return out


class Model:
    """A context vector (own) and a target vector with its bias (to) of each class, and beside them the mean squares that
    Adagrad keeps for context, target and bias."""

    def __init__(self, contexts: np.ndarray, targets: np.ndarray, n_pairs: int, seed: int = 11):
        """contexts and targets: how often each class is the one and the other; n_pairs: different pairs."""
        unigram = targets + 0.5
        unigram[0] = 1e-9  # a text's start is never a target
        unigram = unigram / unigram.sum()
        self.noise = np.cumsum(unigram)
        self.base = np.log(NOISE * unigram).astype(np.float32)
        self.root = np.sqrt(np.maximum(contexts, 1))  # contexts count by the root of their frequency
        self.mean = max(np.sqrt(contexts).sum() / max(n_pairs, 1), 1e-12)
        self.passes = int(np.clip(LEAST_VISITS // max(n_pairs, 1), 1, MOST_PASSES))
        start = np.random.default_rng(seed).normal(0, 0.05, (len(targets), 2 * DIMENSIONS + 1)).astype(np.float32)
        start[:, -1] = np.log(unigram)
        self.own, self.to = start[:, :DIMENSIONS].copy(), start[:, DIMENSIONS:].copy()
        self.squares = np.full((3, len(targets)), 1e-6, np.float32)

    def learn(self, context: np.ndarray, target: np.ndarray, n: np.ndarray, seen: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over pairs; a heavy one is visited more than once, with a part of its weight each time.

        seen (2, class): minibatches that changed a class as context and as target; counted up here.
        """
        weight = n / self.root[context] / self.mean
        visits = np.ceil(weight / 4).astype(np.int64)
        order = rng.permutation(np.repeat(np.arange(len(n)), visits))
        weight = (weight / visits).astype(np.float32)
        with np.errstate(over="ignore"):  # a score far below the noise overflows to a sigmoid of 0
            for k in range(0, len(order), BATCH):
                i = order[k : k + BATCH]
                self._step(context[i], target[i], weight[i], np.minimum(np.searchsorted(self.noise, rng.random(SHARED)), len(self.noise) - 1), seen)

    def _step(self, c: np.ndarray, t: np.ndarray, w: np.ndarray, y: np.ndarray, seen: np.ndarray) -> None:
        d = DIMENSIONS
        own = np.ones((len(c), d + 1), np.float32)  # the targets' bias meets a column of ones
        own[:, :d] = self.own.take(c, axis=0)
        real, fake = self.to.take(t, axis=0), self.to.take(y, axis=0)
        # With x the score less the noise's: up is w * (sigmoid(x) - 1) of the pairs, down w * sigmoid(x) of the noise.
        up = np.einsum("ij,ij->i", own, real)
        up -= self.base[t]
        np.exp(up, out=up)
        up += 1
        up = (-w / up)[:, None]
        less = -fake
        less[:, d] += self.base[y]
        down = own @ less.T
        np.exp(down, out=down)
        down += 1
        np.divide((w * np.float32(NOISE / SHARED))[:, None], down, out=down)
        to_own = down @ fake[:, :d]
        to_own += up * real[:, :d]
        to_target = np.empty((len(t) + len(y), d + 1), np.float32)
        np.multiply(up, own, out=to_target[: len(t)])
        np.matmul(down.T, own, out=to_target[len(t) :])
        for ids, g, table, side in ((c, to_own, self.own, 0), (np.concatenate([t, y]), to_target, self.to, 1)):
            keys = np.sort(ids * np.int64(len(ids)) + np.arange(len(ids)))
            ids = keys // len(ids)
            order = keys - ids * len(ids)
            starts = _runs(ids)
            rows, g = ids[starts], _sums(g, order, starts)
            for cols, which in ((slice(0, d), side), (slice(d, None), 2))[: side + 1]:
                part = g[:, cols]
                squares = np.einsum("ij,ij->i", part, part)
                squares /= np.float32(part.shape[1])
                squares += self.squares[which].take(rows)
                self.squares[which][rows] = squares
                part *= (np.float32(RATE) / np.sqrt(squares))[:, None]
            table[rows] = np.subtract(table.take(rows, axis=0), g, out=g)
            seen[side][rows] += 1

    def change(self, rows: slice) -> tuple[bytes, bytes]:
        """The vectors, side by side, and the mean squares of a block of classes."""
        return np.hstack([self.own[rows], self.to[rows]]).tobytes(), self.squares[:, rows].T.tobytes()

    def normaliser(self, first: int, last: int) -> np.ndarray:
        """log of the sum over all targets but the start, for contexts first to last."""
        own = np.pad(self.own[first:last], ((0, 0), (0, 1)), constant_values=1)  # the bias is a column of the targets
        top, total = np.full(len(own), -np.inf), np.zeros(len(own))
        for k in range(1, len(self.to), BLOCK):
            z = own @ self.to[k : k + BLOCK].T
            high = np.maximum(top, z.max(axis=1))
            z -= high[:, None].astype(np.float32)
            total = total * np.exp(top - high) + np.exp(z, out=z).sum(axis=1)
            top = high
        return top + np.log(total)


def train_nce(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Log10-probabilities (context, target) of the model fitted to a small matrix of pair counts."""
    c, t = np.nonzero(counts)
    model, rng = Model(counts.sum(axis=1), counts.sum(axis=0), len(c), seed), np.random.default_rng(seed)
    for _ in range(ROUNDS * model.passes):
        model.learn(c, t, counts[c, t], np.zeros((2, len(counts))), rng)
    z = model.own @ model.to[:, :-1].T + model.to[:, -1] - model.normaliser(0, len(counts))[:, None]
    z[:, 0] = -np.inf
    return (z / np.log(10)).astype(np.float32)


def train(pairs: DataFrame, contexts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors, target vectors with biases, and each context's normaliser, of the model fitted to the table pairs(context, target, n)."""
    spark = pairs.sparkSession
    sc = spark.sparkContext
    pairs = cut(packed(pairs))
    model = Model(contexts, targets, pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
    size = len(model.to)
    parts = pairs.coalesce(sc.defaultParallelism)
    for turn in range(ROUNDS):
        shared = sc.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, seen = copy.deepcopy(shared.value), np.zeros((2, size), np.float32)
            rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
            numbers = lambda b, name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in b.column(name)])
            pairs_of = lambda b: (numbers(b, "context", np.int32), numbers(b, "target", np.int32), numbers(b, "n", np.int64))
            if own.passes > 1:  # few pairs: held together to be passed over again
                held = [pairs_of(b) for b in batches if len(b)]
                held = [tuple(map(np.concatenate, zip(*held, strict=True)))] * own.passes if held else []
            else:
                held = (pairs_of(b.slice(k, 1)) for b in batches for k in range(len(b)))
            for context, target, n in held:
                own.learn(context, target, n, seen, rng)
            for k in range(0, size, BLOCK):
                rows = slice(k, k + BLOCK)
                if seen[:, rows].any():
                    weights, squares = own.change(rows)
                    columns = [pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (seen[:, rows].T.tobytes(), weights, squares))]
                    yield pa.RecordBatch.from_arrays(columns, ["first", "seen", "weights", "squares"])

        def merge(changed: pd.DataFrame) -> pd.DataFrame:
            """Means of what the tasks made of a block of classes, by how often each changed a class."""
            seen = np.stack([np.frombuffer(x, np.float32).reshape(-1, 2) for x in changed["seen"]]) + np.float32(1e-6)
            out = {"first": changed["first"].iloc[0]}
            for name, by in (("weights", (DIMENSIONS, DIMENSIONS + 1)), ("squares", (1, 2))):
                values = np.stack([np.frombuffer(x, np.float32).reshape(len(seen[0]), -1) for x in changed[name]])
                out[name] = np.average(values, axis=0, weights=np.repeat(seen, by, axis=2)).astype(np.float32).tobytes()
            return pd.DataFrame([out])

        changed = parts.mapInArrow(learn, "first int, seen binary, weights binary, squares binary")
        with batch_rows(spark, PACKS):
            merged = changed.groupBy("first").applyInPandas(merge, "first int, weights binary, squares binary").toArrow().to_pylist()
        for r in merged:
            rows = slice(r["first"], r["first"] + BLOCK)
            weights = np.frombuffer(r["weights"], np.float32).reshape(-1, 2 * DIMENSIONS + 1)
            model.own[rows], model.to[rows] = weights[:, :DIMENSIONS], weights[:, DIMENSIONS:]
            model.squares[:, rows] = np.frombuffer(r["squares"], np.float32).reshape(-1, 3).T
        shared.destroy()
    shared = sc.broadcast(model)

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                yield pd.DataFrame({"first": [k], "logs": [shared.value.normaliser(k, k + CONTEXTS).tobytes()]})

    logs = np.zeros(size)
    for r in spark.range(0, size, CONTEXTS, sc.defaultParallelism * 4).mapInPandas(normalise, "first long, logs binary").collect():
        logs[r["first"] : r["first"] + CONTEXTS] = np.frombuffer(r["logs"])
    return model.own, model.to, logs.astype(np.float32)


def _least(found: list[tuple[int, int, int]], size: int, enough: int) -> int:
    """Least count of the tokens that are among the size most frequent (by whole levels) or occur enough times."""
    least, taken = 1 << 62, 0
    for _, n, lowest in found:
        taken += n
        if taken > size and lowest < enough:
            break
        least = lowest
    return least


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text) by counts of training(text).

    The passes over the texts run here, in batches of ROWS rows, and the documents' sums are kept in the shared folder.
    """
    with batch_rows(docs.sparkSession, ROWS), shuffles_removed(docs.sparkSession):
        return cut(_score(docs, training))


def _score(docs: DataFrame, training: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    counts = cut(count_tokens(training))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    found = levels(counts)  # a few thousand numbers, whatever the input
    own = _least(found, FEWEST_WORDS, LEAST_COUNT)
    wanted = (F.col("c") >= min(own, _least(found, FREQUENT, LEAST_COUNT))) | (F.col("token") == END)
    top = counts.where(wanted).toPandas().sort_values(["c", "token"], ascending=[False, True])
    frequent = dict(zip(top["token"], top["c"].tolist(), strict=True))
    vocabulary = top.loc[(top["c"] >= own) | (top["token"] == END), "token"].tolist()
    if END not in frequent:  # no training documents
        top = pd.DataFrame({"token": [END], "c": [0]})
    classes = pd.Series(range(2, len(vocabulary) + 2), index=vocabulary, dtype="int64").reindex(top["token"]).fillna(1).to_numpy(np.int64)
    # A token's place in the arrays of logs and classes; the last place is for those not broadcast.
    listed, end = pa.array(top["token"], pa.string()), top["token"].tolist().index(END)
    known_logs, known_in = np.append(np.log10(top["c"].to_numpy(np.float64) + 0.5), 0.0), np.append(top["c"].to_numpy() > 0, False)
    del top
    tail_n = n - sum(frequent[w] for w in vocabulary)
    targets = np.array([0, tail_n] + [frequent[w] for w in vocabulary], np.float64)
    contexts = targets.copy()  # any token but a text's end is followed by one
    contexts[0] = targets[vocabulary.index(END) + 2] if END in frequent else 0
    if END in frequent:
        contexts[vocabulary.index(END) + 2] = 0
    model = train(count_pairs(training, vocabulary), contexts, targets)
    tail_v = v - len(vocabulary)
    shared = spark.sparkContext.broadcast((listed, known_logs, known_in, np.append(classes, 1), *model))
    base_norm, tail_norm = np.log10(n + 0.5 * (v + 1)), np.log10(tail_n + 0.5 * (tail_v + 1))

    kind = docs.schema["doc_id"].dataType.simpleString()
    sums_kind = pa.struct([("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums for each document, and a row for each of its rarer tokens."""
        listed, known_logs, known_in, classes, own, to, norm = shared.value
        rare_place = len(listed)
        for b in pieces(batches):
            words, n = split(b.column("text"))
            at = places(words, listed, rare_place)
            rare = at == rare_place
            rare_words, rare_docs = words.filter(pa.array(rare)).dictionary_encode(), np.repeat(np.arange(len(n)), n)[rare]
            at, ends = with_ends(at, n, end)
            starts = np.append(0, ends[:-1])
            ids = classes[at]
            before = np.append(0, ids[:-1])
            before[starts] = 0
            logs_e = np.empty(len(ids))
            for k in range(0, len(ids), PIECE):
                i, j = before[k : k + PIECE], ids[k : k + PIECE]
                target = to.take(j, axis=0)
                logs_e[k : k + PIECE] = np.einsum("ij,ij->i", own.take(i, axis=0), target[:, :-1]) + target[:, -1] - norm[i]
            total = lambda x: np.add.reduceat(x, starts)
            base, tail, n = known_logs[at], ids == 1, ends - starts
            model = total(logs_e) / np.log(10) + total(np.where(tail, base, 0.0)) - total(tail.astype(np.int64)) * tail_norm
            sums = [n, total(known_in[at].astype(np.int64)), total(base) - n * base_norm, model]
            doc_id, mark = b.column("doc_id"), b.column("mark")
            alone = pa.array([f"\t{i}\t{m}" for i, m in zip(doc_id.to_pylist(), mark.to_pylist(), strict=True)], words.type)  # meets no count
            names = ["doc_id", "mark", "token", "k", "own"]
            own_sums = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(sums, sums_kind, strict=True)], fields=list(sums_kind))
            yield pa.RecordBatch.from_arrays([doc_id, mark, alone, pa.array(np.zeros(len(b), np.int64)), own_sums], names)
            different = max(len(rare_words.dictionary), 1)
            keys, k = np.unique(rare_docs * different + rare_words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            of = pa.array(keys // different)
            yield pa.RecordBatch.from_arrays([doc_id.take(of), mark.take(of), rare_words.dictionary.take(pa.array(keys % different)), pa.array(k), pa.nulls(len(k), sums_kind)], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(partial, f"doc_id {kind}, mark long, token string, k long, own struct<n_tokens: long, known: long, base: double, model: double>")
    met = rows.join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    share = F.col("k") * F.log10(c + 0.5)
    summed = lambda name, other: F.coalesce(f"own.{name}", F.lit(other))
    sums = met.groupBy("doc_id", "mark").agg(
        F.count("own").alias("rows"), F.sum("own.n_tokens").alias("n_tokens"), F.sum(summed("known", 0) + F.when(c > 0, F.col("k")).otherwise(0)).alias("n_known"), F.sum(summed("base", 0.0) + share).alias("base"), F.sum(summed("model", 0.0) + share).alias("model")
    )
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))  # repeated rows were summed together
    return each.select("doc_id", F.expr("n_tokens div rows").alias("n_tokens"), F.expr("n_known div rows").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("model") / F.col("rows")).alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, docs.where(~held_out(F.col("doc_id"), FOLDS)))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
