"""Each matching query against its DuckDB oracle, and unit cases of the expressions."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hirelake.operators import ingest, prefilter, scoring
from hirelake.plans.catalog import ORACLES, QUERIES
from hirelake.sources import normalize

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[tuple]:
    plain = lambda v: "" if pd.isna(v) else str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    mine, other = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_relative_dates(spark):
    day = F.lit("2024-03-31").cast("date")
    cases = {"2 days ago": "2024-03-29", "1 month ago": "2024-03-01", "3+ days ago": None, "": None, "Just posted": "2024-03-31", "2024-99-99": None, "2024-02-03T01:00": "2024-02-03"}
    for text, expected in cases.items():
        assert one(spark, normalize.parse_relative_date(F.lit(text), day)) == expected


def test_job_key_ignores_case_space_and_punctuation(spark):
    key = lambda *x: one(spark, ingest.job_key(*map(F.lit, x)))
    assert key("Data Base", "A.", "X") == key("database!", "a", "x") != key("database", "a", "y")
    assert key(None, "a", "x") == key("", "a", "x")


def test_title_exclusion_keeps_to_word_bounds(spark):
    hit = lambda title: one(spark, prefilter.excluded_title(F.lit(title), F.array(F.lit("lead"), F.lit("c++"))))
    assert hit("Team Lead") == "lead" and hit("Leading Nurse") is None and hit(None) is None


def test_all_matched_pairs_score_the_maximum(spark):
    pairs = spark.createDataFrame([("a", "Skill", "x", "y", "required", None), ("a", "skill", "x", "y", "required", None), ("b", "skill", "x", None, "required", None)], "job_key string, category string, job_side string, candidate_side string, job_importance string, candidate_priority string")
    got = {r["job_key"]: r for r in scoring.compute_scores(pairs, 4).collect()}
    assert got["a"]["manager_score"] == 200 and got["a"]["match_score"] == 1.0 and got["b"]["manager_score"] == 0


def test_rebalance_is_idempotent(spark):
    v = spark.createDataFrame([(1, i, "new", i % 2 == 0, None, None, "fits", 100 + i % 5, 100, 0.5) for i in range(20)], "profile_id int, job_key int, status string, hidden boolean, saved boolean, status_updated date, match_notes string, manager_score int, candidate_score int, match_score double")
    first = scoring.rebalance_visible(v, 5, 0.4)
    assert first.where("not hidden").count() == 5
    again = v.drop("hidden").join(first.select("job_key", "hidden"), "job_key")
    assert scoring.rebalance_visible(again, 5, 0.4).where("moved <> 'same'").count() == 0


def test_pairs_of_all_profiles_without_any_verdict(spark):
    jobs = spark.createDataFrame([(1, 1), (2, 1)], "seq int, profile_id int")
    profiles = spark.createDataFrame([(1,), (2,), (3,)], "profile_id int")
    verdicts = spark.createDataFrame([(1, 1, 90), (2, 1, None)], "profile_id int, seq int, manager_score int")
    got = prefilter.unjudged_pairs(jobs, profiles, verdicts).select("profile_id", "seq").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 2), (3, 1), (3, 2)]
