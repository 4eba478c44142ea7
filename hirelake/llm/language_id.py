"""Language identification by a byte convolutional network in numpy.

Texts are cut into windows of a fixed number of bytes. Filters of several widths run over the bytes (each filter is a
table of byte weights for each of its places), the maximum over places is pooled, and a softmax layer gives the
languages; a document's scores are the mean log-probabilities of all its windows.

Training reads labelled rows of the training folds, TRAIN_ROWS at most, a few windows of each.
Cases: null texts and those without a letter (Unicode category L) are ``und`` with score 0; without training rows all
are ``und``; windows shorter than the length are padded; of languages that tie the first in order wins; repeated rows
get equal results, and an id that stands in several labelled rows trains with each of them; extra columns stay, but
columns lang_pred and lang_score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, held_out, sample_rows, table

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 12
#: Labelled rows that train the network, at most, and windows of each.
TRAIN_ROWS, TRAIN_WINDOWS = 4_000, 3
FOLDS = 3
LETTER = regex.compile(r"\p{L}")
#: Windows that a worker holds at once.
HELD = 8192


def windows(text: str | None) -> np.ndarray:
    """All bytes of the text, ASCII letters in lower case, as rows of WINDOW bytes; the last row is padded with zeros."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    rows = max(1, -(-len(b) // WINDOW))
    return np.pad(b, (0, rows * WINDOW - len(b))).reshape(rows, WINDOW)


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = [rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def responses(self, x: np.ndarray):
        """For each width, the filters' sums at each place."""
        for k, f in zip(WIDTHS, self.filters, strict=True):
            n = x.shape[1] - k + 1
            r = f[0].take(x[:, :n], axis=0)
            for j in range(1, k):
                r += f[j].take(x[:, j : j + n], axis=0)
            yield r

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), 64):  # small batches stay in the cache
            pooled = np.hstack([r.max(axis=1) for r in self.responses(x[at : at + 64])])
            z = np.maximum(pooled, 0) @ self.out + self.bias
            z -= z.max(axis=1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.vstack(parts)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 6) -> ByteCNN:
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                b, own = x[order[at : at + batch]], y[order[at : at + batch]]
                maps = list(self.responses(b))
                best = [r.argmax(axis=1) for r in maps]
                pooled = np.hstack([np.take_along_axis(r, i[:, None, :], axis=1)[:, 0] for r, i in zip(maps, best, strict=True)])
                live = np.maximum(pooled, 0)
                z = live @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(b)), own] -= 1
                p /= len(b)
                back = (p @ self.out.T) * (pooled > 0)
                grads = [np.zeros_like(f) for f in self.filters]
                rows, cols = np.arange(len(b))[:, None], np.arange(FILTERS)
                for w, (k, g) in enumerate(zip(WIDTHS, grads, strict=True)):
                    part = back[:, w * FILTERS : (w + 1) * FILTERS]
                    for j in range(k):
                        np.add.at(g[j], (b[rows, best[w] + j], cols), part)
                grads += [live.T @ p, p.sum(axis=0)]
                t += 1
                for q, g, a, c in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    c += 0.01 * (g * g - c)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-7)
        return self

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text; the windows of many texts pass through the network together."""
        held, sizes, counts = [], [], 0

        def judge() -> Iterator[tuple[str, float]]:
            total = np.zeros((len(sizes), len(self.classes)))
            if held:
                own = np.repeat(np.arange(len(sizes)), sizes)
                np.add.at(total, own, self.log_probs(np.vstack(held)))
            for z, n in zip(total, sizes, strict=True):
                if not n:
                    yield "und", 0.0
                else:
                    p = np.exp((z - z.max()) / n)
                    yield self.classes[int(p.argmax())], float(p.max() / p.sum())

        for text in texts:
            rows = windows(text) if text and LETTER.search(text) else np.zeros((0, WINDOW), np.uint8)
            sizes.append(len(rows))
            if len(rows):
                held.append(rows)
            counts += len(rows)
            if counts >= HELD:
                yield from judge()
                held, sizes, counts = [], [], 0
        yield from judge()


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _some_windows(texts: pd.Series) -> pd.Series:
    def some(text):
        rows = windows(text)
        return [rows[i].tobytes() for i in sorted({(len(rows) * j) // TRAIN_WINDOWS for j in range(TRAIN_WINDOWS)})]

    return texts.map(some)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ByteCNN | None:
    """Network trained on docs(doc_id, text, lang) of the training folds; None without any."""
    known = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"), FOLDS))
    rows = sample_rows(known, train_rows, "doc_id").select(F.col("doc_id").cast("string").alias("key"), "lang", _some_windows("text").alias("w")).toPandas()
    if rows.empty:
        return None
    rows = rows.assign(first=[b"".join(w) for w in rows["w"]]).sort_values(["key", "lang", "first"])  # the same order for any partitioning
    classes = sorted(rows["lang"].unique())
    x = np.array([np.frombuffer(b, np.uint8) for w in rows["w"] for b in w])
    y = np.repeat(np.searchsorted(classes, rows["lang"].to_numpy()), rows["w"].map(len))
    return ByteCNN(classes).fit(x, y)


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """docs with lang_pred and lang_score."""
    docs = docs.drop("lang_pred", "lang_score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    found = free_name("lang", docs)

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(model.predict(texts)), columns=["lang_pred", "lang_score"])

    return docs.withColumn(found, predict("text")).select(*docs.columns, f"{found}.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
