"""Toxicity by weak supervision.

Many voters look at a document: one for each entry of a lexicon (fixed words, and words and word beginnings that
labelled rows single out) and some text patterns. A generative label model, fitted by expectation maximisation,
estimates how often each voter fires for either class and, for each voter, how that depends on the voter it is most
correlated with (a tree of dependences, the strongest ones within a class); the given label is one more noisy voter,
whose rates are set beforehand.
A logistic regression on the voters is trained on the posterior labels.

Labels are read from training folds alone, at most TRAIN_ROWS of them; scoring reads nothing but the text. The tasks
reduce the training rows to distinct patterns of votes with their counts; the driver fits both models on these.

Cases: null and empty texts fire no voter and get the base score; without labels of both classes every score is 0;
a label row of an id that has several counts as toxic if any does; repeated rows score alike; an empty table gives no
rows; other columns stay, but a column toxic_score is replaced; whole texts are read whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, cut, held_out, sample_rows, table
from .decontaminate import normal_words

#: Labelled rows that train the models, at most.
TRAIN_ROWS = 20_000
#: Lexicon entries learned from the labels, at most, and the evidence (G statistic) each needs.
LEXICON_SIZE, LEAST_EVIDENCE = 300, 15.0
#: Bytes of the word beginnings that may enter the lexicon.
STEMS = (5, 6, 7, 8)
#: Rows of a frame that a worker returns; rows of a batch that trains.
FRAME, ROWS = 20_000, 1000
FOLDS = 3
PREDICT_AT = 0.7
#: Rounds of expectation maximisation, and the one before which the dependences are chosen.
ROUNDS, TREE_AT = 30, 15
#: How often a given label says toxic, for either class: a voter whose rates are known beforehand.
LABEL_RATES = (0.005, 0.98)
#: G statistic that a dependence between two voters needs.
LEAST_DEPENDENCE = 20.0
#: Fixed lexicon of insults.
INSULTS = ["idiot", "moron", "stupid", "dumb", "fool", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "jerk", "imbecile"]
#: Fixed patterns: shouting, stretched letters, masked letters, second-person insult frames.
PATTERNS = [rb"!{2,}", rb"([a-z])\1{3,}", rb"\b[a-z]+\*+[a-z]*\b", rb"\byou(?: are|'re)? (?:an? )?[a-z]+\b", rb"\b(?:hate|kill|shut up)\b"]


def units(text: str | None) -> set[bytes]:
    """Distinct words of a text, and beginnings of its longer words, which end in an asterisk."""
    own = set(normal_words(text))
    return own | {w[:k] + b"*" for w in own for k in STEMS if len(w) > k}


class Voters:
    """The voters of a lexicon (Latin-1 views of bytes) and the patterns; a vote is the voter's place."""

    def __init__(self, lexicon: list[str]):
        self.place = {w.encode("latin-1"): i for i, w in enumerate(lexicon)}
        self.stems = {w[:-1]: i for w, i in self.place.items() if w.endswith(b"*")}
        self.patterns = [re.compile(p) for p in PATTERNS]
        self.size = len(lexicon) + len(PATTERNS)

    def votes(self, text: str | None) -> list[int]:
        own = set(normal_words(text))
        found = {self.place[w] for w in own & self.place.keys()}
        if self.stems:
            found |= {self.stems[s] for k in STEMS for s in {w[:k] for w in own if len(w) > k} & self.stems.keys()}
        low = (text or "").encode("utf-8", "surrogatepass").lower()
        return sorted(found | {len(self.place) + i for i, p in enumerate(self.patterns) if p.search(low)})


def dependences(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Parent of each voter (-1: none): a maximum spanning forest of the mutual information within classes.

    v (pattern, voter) holds 0 and 1; weights (class, pattern) the posterior counts.
    """
    size = v.shape[1]
    gain = np.zeros((size, size))
    for w in weights:
        n, ones, both = w.sum(), w @ v, (v * w[:, None]).T @ v
        rest = (both, ones[:, None] - both, ones[None, :] - both, n - ones[:, None] - ones[None, :] + both)
        sides = ((ones, ones), (ones, n - ones), (n - ones, ones), (n - ones, n - ones))
        for joint, (a, b) in zip(rest, sides, strict=True):
            joint = np.maximum(joint, 1e-9)
            gain += 2 * joint * np.log(joint * n / np.maximum(np.outer(a, b), 1e-9))
    group, linked = list(range(size)), [[] for _ in range(size)]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    a, b = np.nonzero(np.triu(gain, 1) > LEAST_DEPENDENCE)
    for k in np.argsort(-gain[a, b], kind="stable"):
        i, j = int(a[k]), int(b[k])
        if root(i) != root(j):
            group[root(i)] = root(j)
            linked[i].append(j)
            linked[j].append(i)
    parent = np.full(size, -1)
    seen: set[int] = set()
    for first in range(size):
        todo = [first] if first not in seen else []
        seen.add(first)
        while todo:
            i = todo.pop()
            for j in linked[i]:
                if j not in seen:
                    seen.add(j)
                    parent[j] = i
                    todo.append(j)
    return parent


def label_model(v: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of class 1 for each distinct pattern of votes v with given label y, that n rows have.

    For each class the model has each voter's rate where its parent is silent and where it fires; the label is a voter
    without a parent. A silent voter abstains: only votes, and the label either way, are evidence.
    """
    v = np.hstack([v, y[:, None]]).astype(np.float32)
    p = np.clip(y.astype(np.float64), 0.05, 0.95)
    parent = np.full(v.shape[1], -1)
    for turn in range(rounds):
        if turn == TREE_AT:
            parent[:-1] = dependences(v[:, :-1], np.stack([n * (1 - p), n * p]))
        above = np.where(parent >= 0, v[:, parent], 0).astype(np.float32)
        both, score = v * above, []
        for q in (n * (1 - p), n * p):
            fired, with_parent, parents = q @ v, q @ both, q @ above
            on = (with_parent + 1) / (parents + 2)  # rate where the parent fires
            off = (fired - with_parent + 1) / (q.sum() - parents + 2)
            on = np.where(parent >= 0, on, off)
            off[-1] = on[-1] = LABEL_RATES[len(score)]
            score.append(np.log(q.sum() + 1) + v @ np.log(off) + both @ (np.log(on) - np.log(off)) + (1 - y) * np.log1p(-off[-1]))
        p = 1 / (1 + np.exp(-np.clip(score[1] - score[0], -30, 30)))
    return p


def linear_classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of patterns that n rows have, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6  # the bias is free
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - p * z)).sum() + (pull * w * w).sum() / 2)

    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (n * (s - p)) @ x + pull * w
        step = np.linalg.solve((x * (n * np.maximum(s * (1 - s), 1e-6))[:, None]).T @ x + np.diag(pull), slope)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def lexicon_of(rows: DataFrame, n_toxic: int, n_rows: int) -> list[str]:
    """Entries that the labelled rows (text, toxic) single out, LEXICON_SIZE at most, and the fixed ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, toxic = Counter(), Counter()

        def told() -> Iterator[pd.DataFrame]:
            names = list(every)
            for part in (names[k : k + FRAME] for k in range(0, len(names), FRAME)):
                yield pd.DataFrame({"unit": [w.decode("latin-1") for w in part], "a": [toxic[w] for w in part], "n": [every[w] for w in part]})
            every.clear()
            toxic.clear()

        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                own = units(text)
                every.update(own)
                if y:
                    toxic.update(own)
                if len(every) > 5 * FRAME:
                    yield from told()
        yield from told()

    heard = rows.select("text", "toxic").mapInPandas(count, "unit string, a long, n long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where("n >= 3")
    rate = n_toxic / n_rows
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), F.col("n") * rate) + part(F.col("n") - F.col("a"), F.col("n") * (1 - rate)))
    telling = heard.where(F.col("a") > F.col("n") * rate * 1.5).withColumn("evidence", evidence).where(F.col("evidence") >= LEAST_EVIDENCE)
    found = telling.orderBy(F.desc("evidence"), F.desc(F.length("unit")), "unit").limit(4 * LEXICON_SIZE).collect()
    kept: dict[str, tuple[int, int]] = {}
    for r in found:  # a beginning that stands in the same documents as a longer entry says nothing new
        own = r["unit"].rstrip("*")
        if not (r["unit"].endswith("*") and any(k.startswith(own) and c == (r["a"], r["n"]) for k, c in kept.items())):
            kept[r["unit"]] = (r["a"], r["n"])
    return list(dict.fromkeys(list(kept)[:LEXICON_SIZE] + INSULTS))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, float] | None:
    """Lexicon, weights and bias; None without training labels of both classes."""
    with batch_rows(docs.sparkSession, ROWS):
        return _train(docs, labels, train_rows)


def _train(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[list[str], np.ndarray, float] | None:
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), FOLDS))
    ids = cut(sample_rows(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), train_rows, "doc_id"))
    total = ids.agg(F.sum("toxic"), F.count("*")).first()
    if not total[1] or not 0 < (total[0] or 0) < total[1]:
        return None
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))  # train_rows ids at most
    lexicon = lexicon_of(rows, total[0], total[1])

    @F.pandas_udf("array<int>")
    def fired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = Voters(lexicon)
        for texts in batches:
            yield texts.map(voters.votes)

    seen = rows.select("toxic", fired("text").alias("on")).groupBy("on", "toxic").count().orderBy("on", "toxic").collect()  # train_rows patterns at most
    x = np.zeros((len(seen), len(lexicon) + len(PATTERNS)), dtype=np.uint8)
    for i, r in enumerate(seen):
        x[i, r["on"]] = 1
    if not len(seen):
        return None
    n = np.array([r["count"] for r in seen], np.float64)
    w, b = linear_classifier(x, label_model(x, np.array([r["toxic"] for r in seen]), n), n)
    return lexicon, w, b


def score_toxicity(docs: DataFrame, model: tuple[list[str], np.ndarray, float] | None) -> DataFrame:
    """docs with the column toxic_score."""
    if model is None:
        return docs.withColumn("toxic_score", F.lit(0.0))
    lexicon, w, b = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = Voters(lexicon)
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(b + w[voters.votes(t)].sum(), -30, 30))) for t in texts], dtype="float64")

    return docs.withColumn("toxic_score", score("text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= PREDICT_AT).cast("int").alias("predicted"))
