"""Vector columns as whole numbers, for operators that need exact sums and products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a unit that a whole number counts.
UNITS = 256
#: A whole number stays below this, so that it fits a long.
FITS = float(1 << 63)
#: Whole numbers of a double without rounding, and of a long.
EXACT, LONG = 1 << 53, 1 << 63


def whole(vector: Column, units: int = UNITS) -> Column:
    """Array of longs floor(units * c), c as double; null where the vector is null or holds a null, non-finite or too large entry."""
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(units)))
    sound = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(FITS)))
    return F.when(sound, F.transform(scaled, lambda v: F.floor(v)))


def with_whole(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """rows that have a sound vector, with its whole numbers in a column of that name."""
    return rows.withColumn(name, whole(F.col(vector))).where(F.col(name).isNotNull())


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows of longs; one that ends before width has zeros there."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.int64) if len(vectors) and width else np.zeros((len(vectors), width), np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for at, v in enumerate(vectors):
        out[at, : len(v)] = v
    return out


def largest(values: np.ndarray) -> int:
    """Largest absolute value as an unbounded integer."""
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
