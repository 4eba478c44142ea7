"""Unit cases of feeds, planning, the verdict lifecycle and the landing stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from hirelake.operators import lifecycle, location, planning
from hirelake.sources import feeds
from hirelake.streaming import landing

POSTS = "seq long, profile_id long, source_rank long, title string, company string, location string, date_posted string"


def test_broken_feed_bodies_give_no_rows(spark):
    dumps = spark.createDataFrame([("a", "{"), ("b", None), ("c", '{"jobs":[]}'), ("d", '{"jobs":[{"title":"T","location":"x"}]}')], "slug string, body string")
    row, = feeds.board_dump(dumps).collect()
    assert (row["company"], row["location"], row["date_posted"], row["apply_url"]) == ("d", "", None, "")
    assert feeds.postings_list(spark.createDataFrame([("a", "[]"), ("b", None), ("c", "no")], "slug string, body string")).count() == 0


@pytest.mark.parametrize(("day", "reset", "expected"), [("2024-01-15", 31, "2024-02-29"), ("2023-01-15", 31, "2023-02-28"), ("2024-12-31", 1, "2025-01-01")])
def test_quota_boundary_is_clamped(spark, day, reset, expected):
    assert str(spark.range(1).select(planning.reset_after(F.lit(day).cast("date"), F.lit(reset)).alias("x")).first()["x"]) == expected


def test_quota_starts_over_at_the_boundary(spark):
    d = datetime.date
    usage = spark.createDataFrame([("s", d(2024, 1, 20), 15, 40), ("s", d(2024, 2, 14), 15, 15), ("s", d(2024, 2, 15), 15, 3)], "service string, day date, reset_day int, n long")
    got = [(r["used"], r["remaining"], r["exhausted"]) for r in planning.quota_ledger(usage, 50).orderBy("day").collect()]
    assert got == [(40, 10, False), (55, 0, True), (3, 47, False)]


def test_no_budget_gives_no_queries(spark):
    rows = spark.createDataFrame([(1, "A", 1)], "profile_id int, company string, place int")
    assert planning.budgeted_queries(rows, 0, F.lit("t"), F.lit("")).count() == 0


def test_responses_that_are_no_arrays_give_no_pairs(spark):
    texts = ['[{"job_key":1,"match_pairs":[{"category":"skill"}]}]', '```json\n[{"job_key":2,"match_pairs":[{"category":"x"}]}]\n```', '{"job_key":3}', "", None, '[{"match_pairs":[{"category":"x"}]}]']
    got = lifecycle.parse_match_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "batch_id int, response string"))
    assert sorted(r["job_key"] for r in got.collect()) == [1, 2]


def test_actions_keep_the_last_word(spark):
    at = lambda h: datetime.datetime(2024, 1, 2, h)
    verdict = spark.createDataFrame([(1, 7, "new", False, None, None), (1, 8, "new", False, True, None)], "profile_id int, job_key int, status string, hidden boolean, saved boolean, status_updated date")
    log = [(1, at(1), 7, "status", "offer"), (2, at(2), 7, "status", "bogus"), (3, at(3), 7, "hide", ""), (4, at(4), 7, "promote", ""), (5, at(5), 7, "save", ""), (6, at(6), 8, "save", "")]
    got = {r["job_key"]: r for r in lifecycle.apply_user_actions(verdict, spark.createDataFrame(log, "event_id int, ts timestamp, job_key int, action string, value string")).collect()}
    assert (got[7]["status"], got[7]["hidden"], got[7]["saved"], got[7]["status_updated"], got[7]["touched"]) == ("offer", False, True, None, True)
    assert got[8]["saved"] is False


def test_stream_stores_each_key_once_over_restarts(spark, tmp_path):
    cutoff = F.lit("2024-01-01").cast("date")
    source, table, progress = (str(tmp_path / x) for x in ("in", "table", "progress"))
    first = [(1, 1, 0, "A", "c", "x", None), (2, 1, 0, "B", "c", "x", "2023-01-01"), (3, 1, 0, "a!", "c", "x", "2024-01-05")]
    for batch in (first, [(4, 1, 0, "A", "C", "x", None), (5, 1, 0, "D", "c", "x", "soon")]):
        spark.createDataFrame(batch, POSTS).coalesce(1).write.mode("append").parquet(source)
        landing.start_ingest(spark.readStream.schema(POSTS).parquet(source), table, progress, cutoff).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(table).collect()) == [1, 5]


@pytest.mark.parametrize(
    ("place", "area", "expected"),
    [("McLean, VA", "Virginia", True), ("Savannah, GA", "va", False), ("Charleston, West Virginia", "virginia", True), ("Seattle, Washington", "dc", True), ("Austin, TX", " Texas ", True), ("", "va", False), (None, "va", False), ("Bonn", "", False), ("Anacostia DC", "District of Columbia", True)],
)
def test_places(spark, place, area, expected):
    assert spark.range(1).select(location.location_matches(F.lit(place).cast("string"), F.lit(area)).alias("x")).first()["x"] is expected


def test_any_verdict_keeps_an_expired_job(spark):
    d = datetime.date
    jobs = spark.createDataFrame([(1, d(2024, 1, 1)), (2, d(2024, 1, 1)), (3, d(2024, 1, 1)), (4, d(2024, 1, 20))], "job_key int, date_found date")
    verdicts = spark.createDataFrame([(1, 90), (1, 70), (2, None)], "job_key int, manager_score int")
    assert sorted(r["job_key"] for r in lifecycle.expire_jobs(jobs, verdicts, F.lit(d(2024, 1, 10))).collect()) == [1, 2, 4]


def test_uncovered_companies_have_keyword_queries(spark):
    profiles = spark.createDataFrame([(1, ["Nurse"], ["Clerk"], [], ["Bonn", "Ulm"], "remote"), (2, [], [], [], [], "remote")], "profile_id int, hard_titles array<string>, soft_titles array<string>, keywords array<string>, locations array<string>, remote_type string")
    companies = spark.createDataFrame([(1, "A", 1), (2, "B", 1)], "profile_id int, company string, place int")
    plan = lambda budget: sorted(map(tuple, planning.keyword_plan(profiles, planning.uncovered(companies, budget)).collect()))
    general = [(1, "Nurse", "Bonn"), (2, "Software Engineer", "remote")]
    assert plan(1) == general
    assert plan(0) == sorted([*general, (1, "Nurse at A", "Bonn"), (2, "Software Engineer at B", "remote")])
