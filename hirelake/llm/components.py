"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _toward_least(pairs: DataFrame, keep_own: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them; hubs are pre-aggregated and their join can be split."""
    least = pairs.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("m"))
    linked = pairs.join(least, "a")
    if not keep_own:
        linked = linked.where("b > a")
    ends = linked.select(F.col("b").alias("x"), F.col("m").alias("y"))
    if keep_own:
        ends = ends.union(least.select("a", "m"))
    return ends.where("x <> y").distinct().toDF("a", "b")


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller node, without loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); a component is its smallest node.

    The rounds end when they leave the edges as they were; their number grows with the logarithm of the longest path.
    No edges: no rows. Loops and repeated edges are harmless.
    """
    edges = cut(_downward(edges).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_least(both, False)
        edges = cut(_toward_least(_downward(large), True))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b")))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
