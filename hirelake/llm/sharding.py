"""Extendible hashing: shards are buckets of a hash-prefix directory, split until each fits a byte limit.

Cases: null texts weigh 0 bytes; an empty table gives no rows; one document over the limit is a shard of its own
(``oversized``); equal rows (same id and text) share a hash, so beyond the limit they are dealt out by number, each row
to its own shard; extra columns are read only where they are to be written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, look_up, table

HASH_BITS = 60
#: Directory bits that one pass over the cells resolves.
STEP = 12
#: Equal rows of one hash that are numbered in one task, about; the fewest tasks that do it.
NUMBERED, SALTS = 50_000, 64
LIMIT_BYTES = 16 << 20


def _directory(cells: DataFrame, base: int, limit_bytes: int) -> DataFrame:
    """Leaf depth of each cell (hash prefix of base + STEP bits), null where it has to split further.

    Every cell adds its bytes to its ancestors, one for each depth; the first depth that fits is the leaf.
    """
    top = base + STEP
    lines = cells.select("cell", "bytes", "lo", "hi", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {top} - depth)"))
    sums = lines.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = sums.where((F.col("total") <= limit_bytes) | (F.col("lo") == F.col("hi"))).select("depth", "prefix")
    return lines.select("cell", "depth", "prefix").join(leaves, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))


def _shard(docs: DataFrame, keep: list[str], limit_bytes: int) -> DataFrame:
    """A row for each of docs with the columns _row (the columns keep), _bytes, _depth and _shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    slim = cut(docs.select(F.struct(*keep).alias("_row"), F.octet_length(text).cast("long").alias("n_bytes"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h")))
    hashes = slim.groupBy("h").agg(F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("largest"), F.count("*").alias("n"))
    found, base = [], 0
    left = hashes.select("h", "bytes")
    while base < HASH_BITS:
        top = base + STEP
        cells = cut(left.groupBy(F.expr(f"shiftright(h, {HASH_BITS - top})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        level = cut(_directory(cells, base, limit_bytes))
        found.append((top, level))
        open_cells = cells.join(level, "cell", "left_anti").select("cell")
        if open_cells.isEmpty():
            break
        left = left.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - top})")).join(open_cells, "cell", "left_semi").drop("cell")
        base = top
    out = slim
    for i, (top, level) in enumerate(found):
        out = look_up(out.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - top})")), level.withColumnRenamed("depth", f"depth{i}"), "cell").drop("cell")
    names = [f"depth{i}" for i in range(len(found))]
    depth = F.coalesce(*names, F.lit(HASH_BITS)) if names else F.lit(0)
    out = out.withColumn("depth", depth).drop(*names).withColumn("prefix", F.expr(f"shiftright(h, {HASH_BITS} - depth)"))
    out = out.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))))
    crowd = hashes.where(F.col("bytes") > limit_bytes).select("h", F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.col("largest"))).alias("room"), F.greatest(F.lit(SALTS), F.ceil(F.col("n") / NUMBERED)).alias("salts"))
    out = look_up(out, crowd, "h")
    dealt = (
        out.where("room is not null")
        .withColumn("salt", F.expr("pmod(monotonically_increasing_id(), salts)"))
        .withColumn("rn", F.expr("row_number() over (partition by h, salt order by n_bytes)"))
        .withColumn("shard", F.concat_ws(".", "shard", F.col("salt").cast("string"), F.expr("cast((rn - 1) div room as string)")))
        .select("_row", "n_bytes", "depth", "shard")
    )
    return cut(out.where("room is null").select("_row", "n_bytes", "depth", "shard").unionByName(dealt)).toDF("_row", "_bytes", "_depth", "_shard")


def shard(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard (prefix bits, dot-number for dealt-out equal rows), shard_bytes, shard_docs, oversized."""
    out = _shard(docs, ["doc_id"], limit_bytes).select("_row.doc_id", F.col("_bytes").alias("n_bytes"), F.col("_depth").cast("int").alias("depth"), F.col("_shard").alias("shard"))
    totals = out.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return look_up(out, totals, "shard").select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Write docs as Parquet, a folder for each shard; every row goes to its own shard, which a task writes alone.

    The folder's name is in the column shard, or one with underscores before it where docs has a column of that name.
    """
    name = free_name("shard", docs)
    plan = _shard(docs, docs.columns, limit_bytes).select("_row.*", F.concat(F.lit("s"), "_shard").alias(name))
    plan.repartition(name).write.partitionBy(name).parquet(path)


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Extendible splitting gives each row the first depth whose bucket fits, so the oracle sums each depth at once.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
k AS (SELECT doc_id, n_bytes, h, depth, h >> ({HASH_BITS} - depth) AS prefix FROM d, range(0, 25) r(depth)),
b AS (SELECT depth, prefix, sum(n_bytes) AS total, min(h) AS lo, max(h) AS hi, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT k.*, b.total, b.n, row_number() OVER (PARTITION BY k.doc_id, k.h ORDER BY k.depth) AS rn
      FROM k JOIN b USING (depth, prefix) WHERE b.total <= {LIMIT_BYTES} OR b.lo = b.hi)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth,
       CASE WHEN depth = 0 THEN '' ELSE lpad(to_base(prefix, 2), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(total AS BIGINT) AS shard_bytes, n AS shard_docs, total > {LIMIT_BYTES} AS oversized
FROM f WHERE rn = 1
"""
