"""The stream of actions over restarts, late and repeated events against the batch."""

from hirelake.operators import lifecycle
from hirelake.streaming import actions as stream

LOG = "profile_id long, job_key long, event_id long, ts timestamp, action string, value string"
VERDICTS = "profile_id long, job_key long, status string, hidden boolean, saved boolean, status_updated date, match_notes string, manager_score int, candidate_score int, match_score double"
BATCHES = [
    [(1, 10, 1, "2024-01-05 10:00:00", "status", "applied"), (1, 10, 2, "2024-01-05 11:00:00", "save", None), (1, 11, 3, "2024-01-05 10:00:00", "hide", None), (2, 10, 4, "2024-01-05 10:00:00", "notes", "first")],
    [(1, 10, 5, "2024-01-04 10:00:00", "status", "offer"), (1, 11, 3, "2024-01-05 10:00:00", "hide", None), (1, 11, 6, "2024-01-05 10:00:00", "promote", None), (3, 10, 7, "2024-01-05 10:00:00", "status", "bogus")],
    [(1, 10, 8, "2024-01-06 10:00:00", "save", None), (2, 10, 9, "2024-01-05 10:00:00", "notes", None), (2, 11, 10, "2024-01-01 10:00:00", "hide", None), (9, 9, 11, "2024-01-01 10:00:00", "save", None), (1, 12, 12, "2024-01-02 10:00:00", "status", None)],
    [],
]


def rows_of(frame):
    return sorted((tuple(str(v) for v in r) for r in frame.collect()))


def test_stream_equals_batch_over_restarts_late_and_repeated_events(spark, tmp_path):
    verdicts = spark.createDataFrame([(p, j, "new", p == 2, None, None, "fits", 50 + 10 * j - p, 60, 0.9) for p in (1, 2, 3) for j in (10, 11, 12)], VERDICTS)
    landed, changes, progress = (str(tmp_path / x) for x in ("landed", "changes", "progress"))
    seen = []
    for number, batch in enumerate(BATCHES):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(p, j, e, None, a, v) for p, j, e, _, a, v in batch], LOG)
        times = spark.createDataFrame([(e, t) for _, _, e, t, _, _ in batch], "event_id long, t string").distinct()
        frame.join(times, "event_id").withColumn("ts", F.to_timestamp("t")).select("profile_id", "job_key", "event_id", "ts", "action", "value").coalesce(1).write.mode("append").parquet(landed)
        stream.start_actions(spark.readStream.schema(LOG).parquet(landed), changes, progress).awaitTermination()
        seen += batch
        log = spark.read.schema(LOG).parquet(landed).dropDuplicates(["event_id"])
        want = lifecycle.after_actions(verdicts, log, 2, 0.4)
        assert rows_of(stream.current(spark, verdicts, progress, 2, 0.4)) == rows_of(want), number
    stream.start_actions(spark.readStream.schema(LOG).parquet(landed), changes, progress).awaitTermination()  # nothing landed
    assert rows_of(stream.current(spark, verdicts, progress, 2, 0.4)) == rows_of(want)
    told = spark.read.parquet(changes)
    named = {(r["batch"], r["profile_id"], r["job_key"]) for r in told.collect()}
    assert {k[1:] for k in named if k[0] == 1} == {(1, 10), (1, 11)}  # a batch writes the keys it names, the refused status none
    assert rows_of(stream.folds(spark, progress).select("profile_id", "job_key")) == sorted({(str(p), str(j)) for _, p, j in named})
