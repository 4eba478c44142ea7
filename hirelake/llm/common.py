"""Small helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of every operator that keeps punctuation.
SPACE = " \t\n\x0b\x0c\r"
#: Parts into which the rows of a hot key are spread.
SALTS = 64
#: Counts up to this have a level of their own; above, a power of two has LEVELS of them.
PLAIN, LEVELS = 1024, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of maximal runs without ASCII white space; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; the fixed fold of a document."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(remainder(doc_id, parts) == 1, F.lit(False))


def free_name(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores before it, such that none of the frames has a column of it, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Where the setting is unset, a session on one machine gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under the shared folder and read again; for whole rows, which Parquet compresses."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Arrow batches have at most so many rows; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block, an action's shuffle files go when it ends; for results that are written and read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Within the block, descriptions of plans show the first field of each list alone and end early; for projections
    whose later fields hold large literals, since the driver keeps those texts with each execution. Afterwards the session
    is as it was."""
    own = {"spark.sql.debug.maxToStringFields": "1", "spark.sql.maxPlanStringLength": "100000"}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def sample_rows(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most limit rows, chosen by the hash of keys alone, so the same for any partitioning.

    No sort: where there are more, a row stays if its hash lies under limit / count, less five standard deviations, so
    that the number stays under the limit. Rows of equal keys stay or go together.
    """
    n = rows.count()
    if n <= limit:
        return rows
    share = max(limit - 5 * math.sqrt(limit), limit / 2) / n
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def level(count: Column) -> Column:
    """A number that grows with the count: the count itself up to PLAIN, then LEVELS steps for each doubling."""
    return F.when(count <= PLAIN, count).otherwise(PLAIN + F.ceil(LEVELS * F.log2(count / F.lit(PLAIN)))).cast("long")


def levels(counts: DataFrame, column: str = "c") -> list[tuple[int, int, int]]:
    """(level, rows, least count) from the highest level down; a few thousand at most, whatever the input."""
    found = counts.groupBy(level(F.col(column)).alias("level")).agg(F.count("*").alias("n"), F.min(column).alias("least")).collect()
    return sorted(((r["level"], r["n"], r["least"]) for r in found), reverse=True)


def most_frequent(counts: DataFrame, limit: int, key: str, column: str = "c") -> DataFrame:
    """The rows of counts with the highest counts, limit at most, without a sort: whole levels, and of the first level
    that has no room the rows of the smallest hashes of key, whose share leaves five standard deviations of room."""
    own, room = level(F.col(column)), limit
    for at, n, _ in levels(counts, column):
        if n > room:
            share = max(room - 5 * math.sqrt(room), 0) / n
            return counts.where((own > at) | ((own == at) & (F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))))
        room -= n
    return counts


def look_up(rows: DataFrame, values: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with values, which has at most one row of each key, so that a hot key lands in many tasks.

    The rows' distinct (key, salt) pairs, reduced before their shuffle, meet the values first: SALTS rows of a key at
    most. The rows then join on both. Null keys meet nothing.
    """
    salt = free_name("salt", rows, values)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(SALTS)).cast("int"))
    spread = salted.where(F.col(key).isNotNull()).select(key, salt).distinct().join(values, key)
    return salted.join(spread, [key, salt], how).drop(salt)
