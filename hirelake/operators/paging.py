"""Pages of a long list in any order: an index of ranges, so that page n is found by counts and only its ranges are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_index(rows: DataFrame, path: str, order: list[Column], by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Writes rows to path by ranges of (by, order), each in a folder of its own, and gives what is read back; a later session
    reads path as it reads any table.

    order has to end with a column that tells rows apart: then ties, and a group that holds most rows, are spread over
    ranges like any others. The ranges are drawn from a sample, so one may be larger than another, never out of order; there
    are as many as the session has shuffle partitions, unless said otherwise.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *(F.col(c) for c in by), *order).withColumn("_range", F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy("_range").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)  # an empty table leaves no file to tell the schema


def spans(index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, _range, start, length, total): how many rows of its group stand before a range, in it, and in all.

    There are as many rows as ranges and groups at most, and a group's window holds one row for each range.
    """
    counts = index.groupBy(*by, "_range").agg(F.count("*").alias("length"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("length").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*by, "_range", before.alias("start"), "length", F.sum("length").over(group).alias("total"))


def read_pages(index: DataFrame, order: list[Column], wanted: list[int], size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of the wanted pages of each group of the index, with page, position (from 1, in the group) and total.

    A negative page counts from the end (-1: the last). A page that a group hasn't got gives no rows, and one asked for
    twice, by either number, comes once. order and by are those of build_index; null values of by are a group.
    """
    pages = F.ceil(F.col("total") / size)
    told = spans(index, by).withColumn("page", F.explode(F.array_distinct(F.transform(F.array(*(F.lit(n).cast("long") for n in wanted)), lambda n: F.when(n < 0, pages + 1 + n).otherwise(n)))))
    first, end = (F.col("page") - 1) * size, F.col("page") * size
    hits = told.where((F.col("page") >= 1) & (F.col("start") < end) & (F.col("start") + F.col("length") > first))
    read = sorted(r["_range"] for r in hits.select("_range").distinct().collect())  # as many as ranges at most
    group = [f"_by_{c}" for c in by]
    hits = hits.withColumnsRenamed(dict(zip(by, group, strict=True))).withColumnRenamed("_range", "_at").drop("length")
    part = index.where(F.col("_range").isin(read) if read else F.lit(False))
    placed = part.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_at")
    for mine, other in zip(by, group, strict=True):
        same = same & F.col(mine).eqNullSafe(F.col(other))
    position = F.col("start") + F.col("_row")
    found = placed.join(hits, same).withColumn("position", position).where((F.col("position") > first) & (F.col("position") <= end))
    return found.drop("_range", "_at", "_row", "start", *group)
