"""Whitening of embedding vectors: covariance over the cluster, leading eigenpairs by tridiagonalisation.

Each distinct vector counts once. Tasks sum the products of centred vectors, so what leaves a task has the size of the
covariance, whatever the rows. The covariance becomes tridiagonal by Householder reflections; Sturm counts bisect for
the leading eigenvalues; inverse iteration gives their vectors, orthogonalised again within clusters of near eigenvalues.
The components travel with the projecting tasks: width * COMPONENTS doubles. The driver holds width * width doubles, so a
width of a few thousand is the limit, at any number of rows.

Cases: a row whose vector is null, or holds a null, non-finite or too large (2^63 after scaling) entry, goes; a shorter
vector has zeros at its end; repeated vectors count once in the fit and all get their rows; ties between eigenvalues
give any orthonormal basis of their space, the same for all rows; eigenvalues that are zero but for rounding have no
component, so fewer than asked may come, none where all vectors are equal; a deviation that doesn't fit a long is null;
an empty table gives no rows; columns other than those named are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import LONG, largest, matrix, with_whole

#: Components returned.
COMPONENTS = 4
#: Eigenvalues nearer than this share of the matrix's norm are a cluster, whose vectors are orthogonalised again.
CLUSTER = 1e-3
#: Solves of an inverse iteration.
SOLVES = 4
EPS = float(np.finfo(float).eps)
#: Vectors that a task multiplies at once, and that make it worth a task of its own.
BLOCK, TASK_VECTORS = 4096, 65536


# ---- eigenpairs of a symmetric matrix, on the driver


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, next diagonal, orthogonal q) with a = q t q' by Householder reflections."""
    t, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = t[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if not norm or not np.abs(v[1:]).max():
            continue
        head = -np.copysign(norm, v[0])
        v[0] -= head
        v /= np.linalg.norm(v)
        part = t[k + 1 :, k + 1 :]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        t[k + 1 :, k], t[k, k + 1 :] = 0, 0
        t[k + 1, k] = t[k, k + 1] = head
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, 1).copy(), q


def below(diagonal: np.ndarray, beside: np.ndarray, x: float, least: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix that are less than x."""
    count, q = 0, 1.0
    for d, b in zip(diagonal.tolist(), [0.0, *(beside * beside).tolist()], strict=True):
        q = d - x - b / q
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def leading(diagonal: np.ndarray, beside: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, each bisected until doubles leave nothing between the ends."""
    reach = np.abs(np.concatenate([[0.0], beside])) + np.abs(np.concatenate([beside, [0.0]]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    least, found = EPS * EPS * norm, []
    for place in range(k):
        lo, hi = low - EPS * norm, (found[-1] if found else high) + 4 * EPS * norm
        while hi - lo > EPS * max(abs(lo), abs(hi), EPS * norm):
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            if below(diagonal, beside, mid, least) <= len(diagonal) - 1 - place:
                lo = mid
            else:
                hi = mid
        found.append((lo + hi) / 2)
    return found


def solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (t - shift) y = right by elimination with row exchanges; a pivot that vanishes becomes least."""
    n = len(diagonal)
    d, up, far, y = (diagonal - shift).tolist(), [*beside.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        low = beside[i]
        if abs(low) > abs(d[i]):
            factor = d[i] / low
            d[i], up[i], far[i], nxt = low, d[i + 1], up[i + 1], up[i]
            d[i + 1], up[i + 1] = nxt - factor * d[i + 1], -factor * up[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > least else least
            factor = low / d[i]
            d[i + 1] -= factor * up[i]
            y[i + 1] -= factor * y[i]
    for i in range(n - 1, -1, -1):
        d[i] = d[i] if abs(d[i]) > least else least
        y[i] = (y[i] - (up[i] * y[i + 1] if i + 1 < n else 0.0) - (far[i] * y[i + 2] if i + 2 < n else 0.0)) / d[i]
    return np.array(y)


def eigenpairs(a: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to k leading eigenvalues of a that are positive beyond rounding, falling, and their unit vectors as columns."""
    n = len(a)
    size = float(np.abs(a).max()) if n else 0.0
    if not size:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, beside, q = tridiagonal(a / size)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0.0))
    values = [v for v in leading(diagonal, beside, min(k, n)) if v > 4 * n * EPS * norm]
    start, vectors, group = np.random.default_rng(1), [], 0
    for at, value in enumerate(values):
        if at and values[at - 1] - value > CLUSTER * norm:
            group = at
        y = start.standard_normal(n)
        for _ in range(SOLVES):
            y = solve(diagonal, beside, value - (at - group) * EPS * norm, y / np.linalg.norm(y), EPS * EPS * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in vectors[group:at]:
                    y = y - (other @ y) * other
            y /= np.linalg.norm(y)
        vectors.append(y)
    turned = q @ np.array(vectors).T if vectors else np.zeros((n, 0))
    turned *= np.sign(turned[np.abs(turned).argmax(axis=0), range(turned.shape[1])])
    return np.array(values) * size, turned


# ---- sums over the cluster


def _blocks(frames: Iterator[pd.DataFrame], width: int) -> Iterator[np.ndarray]:
    for frame in frames:
        for at in range(0, len(frame), BLOCK):
            yield matrix(frame["x"].iloc[at : at + BLOCK], width)


def _totals(fit: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over fit's vectors of part, a function of a block of them whose values add up; a task tells one value for each place."""

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for block in _blocks(frames, width):
            total = part(block) if total is None else total + part(block)
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    found = fit.mapInPandas(tell, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    return found.sort_values("place")["value"].to_numpy()


def _exact_sums(fit: DataFrame, width: int) -> list[int]:
    """Sum of each coordinate as an unbounded integer."""

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [0] * width
        for block in _blocks(frames, width):
            own = block if largest(block) * len(block) < LONG else block.astype(object)
            total = [t + int(s) for t, s in zip(total, own.sum(axis=0), strict=True)]
        yield pd.DataFrame({"place": range(width), "value": [Decimal(t) for t in total]})

    found = fit.mapInPandas(tell, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [int(r["value"]) for r in sorted(found)]


@dataclass(frozen=True)
class Whitening:
    """What the projection needs: the fit's size and sums, the eigenpairs, their shares, the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - centre(self.n, self.sums)) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over coordinates of (n * x - sum)^2, exact; None where it doesn't fit a long."""
        most = self.n * largest(x) + max(map(abs, self.sums), default=0)
        own = x if len(self.sums) * most * most < LONG else x.astype(object)
        found = ((own * self.n - np.array(self.sums, own.dtype)) ** 2).sum(axis=1)
        return [int(v) if v < LONG else None for v in found]


def centre(n: int, sums: list[int]) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x; None if there are none."""
    fit = cut(vectors.select("x").distinct())
    n, width = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_VECTORS))
    fit = fit.coalesce(tasks)  # what a task tells is small against what it reads
    sums = _exact_sums(fit, width)
    middle, upper = centre(n, sums), np.triu_indices(width)
    half = _totals(fit, width, lambda x: ((c := x - middle).T @ c)[upper]) / n
    covariance = np.zeros((width, width))
    covariance[upper] = half
    covariance += np.triu(covariance, 1).T
    values, found = eigenpairs(covariance, components)
    if not len(values):
        return Whitening(n, sums, values, found, values, 0.0)
    turn, k = found / np.sqrt(values), len(values)
    mean = _totals(fit, width, lambda x: ((x - middle) @ turn).sum(axis=0)) / n
    spread = _totals(fit, width, lambda x: (c := (x - middle) @ turn - mean).T @ c).reshape(k, k) / n
    return Whitening(n, sums, values, found, values / np.trace(covariance), float(np.abs(spread - np.eye(k)).max()))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each sound row and component."""
    kind = rows.schema[key].dataType
    sound = with_whole(rows.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector")), "vector", "x")  # a text, as pandas has no null long
    model = fit_whitening(sound, components)
    schema = "key string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = lambda out: out.select(F.col("key").cast(kind).alias(key), *out.columns[1:])
    if model is None:
        return named(rows.sparkSession.createDataFrame([], schema))
    width, k = len(model.sums), len(model.values)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame) if k else 0, BLOCK):
                part = frame.iloc[at : at + BLOCK]
                x = matrix(part["x"], width)
                yield pd.DataFrame(
                    {"key": np.repeat(part["key"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": model.n, "deviation": pd.array(model.deviation(x), "Int64").repeat(k), "whitened": model.project(x).ravel(), "explained": np.tile(model.explained, len(x)), "identity_error": model.identity_error}
                )

    return named(sound.select("key", "x").mapInPandas(project, schema))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
