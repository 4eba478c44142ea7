"""Batches against walking each queue; stored pairs, the run log and the state after a rebalance in edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import packing, reports, scoring, stored_pairs


def walked(queue, budget, most):
    out, held, total, batch = [], 0, 0, 0
    for t in queue:
        if held and (total + t > budget or held >= most):
            held, total, batch = 0, 0, batch + 1
        held, total = held + 1, total + t
        out.append(batch)
    return out


@pytest.mark.parametrize(("budget", "most", "piece"), [(100, 7, 8), (100, 1, 4), (20_000, 50, 256), (50, 300, 16), (1, 5, 5)])
def test_batches_equal_walking_the_queue(spark, monkeypatch, budget, most, piece):
    monkeypatch.setattr(packing, "PIECE", piece)
    rng = random.Random(budget + most)
    queues = {p: [rng.choice([1, 2, 30, 99, 101, 500]) for _ in range(n)] for p, n in enumerate((0, 1, 2, 7, 8, 9, 40, 257, 700))}
    rows = [(p, i + 1, f"k{i}", t) for p, q in queues.items() for i, t in enumerate(q)]
    jobs = spark.createDataFrame(rows, "profile_id int, turn int, job_key string, tokens long").repartition(3)
    got = {(r["profile_id"], r["job_key"]): (r["tokens"], r["batch"]) for r in packing.token_batches(jobs, budget, most).collect()}
    assert got == {(p, f"k{i}"): (t, b) for p, q in queues.items() for i, (t, b) in enumerate(zip(q, walked(q, budget, most), strict=True))}


def test_tokens_of_filled_fields(spark):
    row = spark.createDataFrame([("abc", None, 0, "", 12, False), (None, None, 0, "", 0, False), ("x" * 35, "y" * 34, 0, "", 0, True)], "a string, b string, c int, d string, e int, f boolean")
    got = [r["t"] for r in row.select(packing.estimated_tokens(*map(F.col, row.columns)).alias("t")).collect()]
    assert got == [max(1, round(6 / 3.5)), 1, round((35 + 1 + 34 + 1 + 4) / 3.5)]


def test_stored_pairs_of_odd_texts(spark):
    texts = [None, "no json", "{}", "[]", "7", '[1, null, "x"]', '[{"category": " skill", "job_side": "a"}]', '[{"category":"SKILL","job_side":" ","candidate_side":"b","job_importance":"odd"},{"category":"equity","job_side":"a","candidate_side":"b","candidate_priority":""}]']
    rows = spark.createDataFrame([(1, i, t, "fits", "2024-01-20") for i, t in enumerate(texts)] + [(1, 99, "[]", None, "2024-01-20"), (1, 98, "[]", "fits", "2023-01-01")], "profile_id int, job_key int, pairs_json string, match_notes string, effective_date string")
    told = {(r["job_key"], r["pos"]): (r["perspective"], r["matched"], r["label"], r["level"], r["job_text"], r["candidate_text"]) for r in stored_pairs.breakdown(rows).collect()}
    assert told == {(7, 0): ("mgr", False, "Skill", "odd", "—", "b"), (7, 1): ("cand", True, "Equity", None, "a", "b")}
    scores = {r["job_key"]: (r["manager_score"], r["candidate_score"], r["match_score"]) for r in stored_pairs.rescore(rows, spark.createDataFrame([(1, 2)], "profile_id int, n int"), F.lit("2024-01-01")).collect()}
    assert set(scores) == {1, 2, 3, 4, 5, 6, 7} and {scores[i] for i in range(1, 6)} == {(100, 100, 1.0)} and scores[6][0] == 0 and scores[7][1] == 150


def test_last_success_over_slices_ties_and_open_runs(spark):
    rng = random.Random(4)
    runs = [(p, i, f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d} 0{rng.randrange(3)}:00:00", rng.choice(["f", None]) and f"f{i}", rng.choice(["success", "failed"])) for p in (1, 2) for i in range(80)] + [(3, 0, None, "x", "success"), (3, 1, "2024-01-01 00:00:00", None, "failed")]
    frame = spark.createDataFrame(runs, "profile_id int, run_id int, s string, finished string, status string").select("profile_id", "run_id", F.to_timestamp("s").alias("started"), "finished", "status").repartition(4)
    got = {(r["profile_id"], r["run_id"]): r["last_finished"] for r in reports.last_success(frame).collect()}
    for p, i, s, _, _ in runs:
        before = [(t or "", j, f) for q, j, t, f, status in runs if q == p and status == "success" and (t or "", j) < (s or "", i)]
        assert got[p, i] == (max(before)[2] if before else None)
    assert reports.last_success(frame.where("false")).count() == 0


def test_rebalanced_state_keeps_ranks_and_clears_stamps(spark):
    rows = [(1, "a", "new", False, None, "2024-01-01", "fits", 90, 90, 0.9, 7), (1, "b", "new", False, None, "2024-01-02", "fits", 50, 50, 0.9, 2), (1, "c", "new", True, None, None, None, 80, 80, 0.9, None), (1, "d", "applied", False, None, "2024-01-03", "fits", 99, 99, 0.9, 1), (1, "e", "new", True, None, "2024-01-03", "fits", 99, 99, 0.9, 5)]
    verdicts = spark.createDataFrame(rows, "profile_id int, job_key string, status string, hidden boolean, saved boolean, status_updated string, match_notes string, manager_score int, candidate_score int, match_score double, rank int")
    got = {r["job_key"]: (r["hidden"], r["rank"], r["status_updated"]) for r in scoring.rebalanced_state(verdicts, 2, 0.4).collect()}
    assert got == {"a": (False, 1, "2024-01-01"), "b": (True, 2, None), "c": (False, 2, None), "d": (False, 1, "2024-01-03"), "e": (True, 5, "2024-01-03")}
