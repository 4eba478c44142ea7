"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits itself and its 64 one-bit variants. Fingerprints that differ in two bits or fewer
share a variant; those that share a variant differ in two bits at most, so a bucket holds at most 65 of them, all
linked to one another, and links to the least of them carry every component. Colliding pairs are verified by their bits.

Cases: null and blank texts have fingerprint zero, linked like any other; texts under three words are one shingle;
equal fingerprints, and so repeated rows, are one class; rows with a null id belong to the class of their fingerprint,
which is null where no row with an id is in it; an empty table gives no rows; extra columns are read only if named.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, look_up, table
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if more than half of the shingles' hashes have it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
    counts = sum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for part in np.array_split(h, len(h) // 65536 + 1))
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of prints(fp, node) with fp distinct, enough to connect all within RADIUS bits."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < BITS - 1 else -(1 << (BITS - 1))).cast("long") for i in range(BITS)))
    variants = prints.select("fp", "node", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), F.struct("node", "fp").alias("member"))
    buckets = variants.groupBy("variant").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)  # 65 at most
    pairs = buckets.select(F.array_min("members").alias("x"), F.explode("members").alias("y")).where("x.node <> y.node")
    verified = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
    return verified.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns keep, fingerprint (hex) and component_id (least id of the class) of each row."""
    rows = cut(docs.select("doc_id", *keep, _fingerprints("text").alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = components(near_links(prints.where("node is not null")))
    classes = prints.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return look_up(rows, classes, "fp").select("doc_id", *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
