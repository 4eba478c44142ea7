"""Streaming user actions: what has landed is folded into keyed state, kept in Spark's state store.

Each (profile, job) has one value: for each field the last action by event time and id, and counts for the toggles. All
of it is free of order, so late actions take their place by themselves. A batch reads and writes the keys it names and
no others, whatever the history; Spark's checkpoint makes a repeated batch count once, and an event that lands twice is
dropped by its id. The current verdicts are the first ones beside the state, which the state reader gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lifecycle

#: The value of a key: times are microseconds, at zero where there was no such action yet.
LAST = ["status", "shown", "stamp", "notes"]
FOLD = ", ".join([*(f"{k}_at long, {k}_event long, {k} string" for k in LAST), "saves long", "moves long"])
NAMES = ["profile_id", "job_key", *(c.split()[0] for c in FOLD.split(", "))]
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "fold"


class Folder(StatefulProcessor):
    """Folds the actions of a key into its value and tells the new value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState(STATE, FOLD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        now = self.kept.get() if self.kept.exists() else None
        fold = list(now) if now is not None else [None] * (3 * len(LAST)) + [0, 0]
        for row in rows:
            for at, said in enumerate((row.status, row.shown, row.stamp, row.notes)):
                if said is not None and (fold[3 * at] is None or (row.at, row.event_id) > (fold[3 * at], fold[3 * at + 1])):
                    fold[3 * at : 3 * at + 3] = row.at, row.event_id, said
            fold[-2] += row.saves
            fold[-1] += row.moves
        self.kept.update(tuple(fold))
        yield Row(**dict(zip(NAMES, (*key, *fold), strict=True)))

    def close(self) -> None:
        pass


def told(actions: DataFrame) -> DataFrame:
    """What each valid action says of each field; an empty text says that a stamp is cleared or a note emptied."""
    done, value = F.col("action"), F.coalesce("value", F.lit(""))
    said = {
        "status": F.when(done == "status", value),
        "shown": F.when(done == "hide", "hidden").when(done == "promote", "shown"),
        "stamp": F.when(done == "promote", "").when(done.isin("status", "hide"), F.to_date("ts").cast("string")),
        "notes": F.when(done == "notes", F.concat(F.when(F.col("value").isNull(), "-").otherwise("+"), value)),
        "saves": F.when(done == "save", 1).otherwise(0).cast("long"),
        "moves": F.when(done == "notes", 0).otherwise(1).cast("long"),
    }
    return lifecycle.valid_actions(actions).select("profile_id", "job_key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *(c.alias(k) for k, c in said.items()))


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def start_actions(actions: DataFrame, changes: str, checkpoint: str):
    """Starts a stream of actions (profile_id, job_key, event_id, ts, action, value) that ends when what has landed is done.

    Each batch writes the values of the keys that it changed under changes, in a folder of its own that a repeated batch
    overwrites; the state itself is under checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")

    with _rocks(actions.sparkSession):
        key = {f.name: f.dataType.simpleString() for f in actions.schema}
        folded = (
            told(actions.dropDuplicates(["event_id"]))
            .groupBy("profile_id", "job_key")
            .transformWithState(Folder(), f"profile_id {key['profile_id']}, job_key {key['job_key']}, {FOLD}", "Append", "None")
        )
        return folded.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folds(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of every key that an action named, in the columns that lifecycle.with_folds reads."""
    with _rocks(spark):
        states = spark.read.format("state-metadata").load(checkpoint).where("operatorName like 'transformWithState%'").select("operatorId").distinct().first()
        kept = spark.read.format("statestore").option("operatorId", states[0]).option("stateVarName", STATE).load(checkpoint)
    v = lambda name: F.col(f"value.{name}")
    stamp: Column = F.when(v("stamp") != "", F.to_date(v("stamp")))
    return kept.select(
        *(F.col("key").getField(k).alias(k) for k in ("profile_id", "job_key")),
        v("status").alias("_status"),
        (v("shown") == "hidden").alias("_hidden"),
        stamp.alias("_stamp"),
        v("stamp").isNotNull().cast("int").alias("_stamps"),
        v("saves").alias("_saves"),
        F.when(v("notes").startswith("+"), F.substring(v("notes"), F.lit(2), F.length(v("notes")))).alias("_notes"),
        v("moves").alias("_moves"),
    )


def current(spark: SparkSession, verdicts: DataFrame, checkpoint: str, top_n: int, least: float) -> DataFrame:
    """The verdicts after all actions that the stream has seen, with what is shown rebalanced for each touched profile."""
    return lifecycle.rebalanced(lifecycle.with_folds(verdicts, folds(spark, checkpoint)), verdicts, top_n, least)
