"""Streaming ingest: files that land are keyed and stored once for each key, for ever."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..plans.fixtures import derive
from ..sources import normalize
from ..sources.folders import shared_folder


def start_ingest(rows: DataFrame, table: str, checkpoint: str, cutoff, prepare=None):
    """Starts a stream that appends the new postings of rows to table and ends when what has landed is done.

    Each batch has a folder of its own, which a repeated batch overwrites, and looks for known keys in earlier batches
    only, so a restart stores nothing twice. Rows without a date stay; rows older than cutoff go.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        posts = prepare(batch) if prepare else batch
        fresh = posts.where(normalize.is_fresh(F.col("date_posted"), cutoff))
        stored = batch.sparkSession.read.parquet(table).where(F.col("batch") < batch_id).select("job_key") if batch_id else None
        ingest.first_wins(fresh, stored).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_orders(spark: SparkSession, sf_dir: str, as_of: str, retention: int) -> DataFrame:
    """The table that the stream of postings derived from orders leaves."""
    folder = shared_folder(spark)
    path = f"{sf_dir}/orders.parquet"
    # A streaming source takes a folder or a pattern, never a single file.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/orders.parque[t]")
    cutoff = F.date_sub(F.lit(as_of).cast("date"), retention)
    start_ingest(stream, f"{folder}/table", f"{folder}/progress", cutoff, lambda b: derive(b.sparkSession, "postings", {"orders": b})).awaitTermination()
    return spark.read.parquet(f"{folder}/table")
