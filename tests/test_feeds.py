"""Landed feeds: broken lines, nulls, odd amounts and periods, numbers as texts."""

import json

from pyspark.sql import functions as F

from hirelake.sources import feeds

AS_OF = "2024-01-31"


def lines(spark, *bodies):
    return spark.createDataFrame([(b if b is None or isinstance(b, str) else json.dumps(b),) for b in bodies], "body string")


def test_search_lines_keep_pay_as_stated_and_the_line_itself(spark):
    jobs = [
        {"job_title": "A", "job_min_salary": 35.5, "job_max_salary": "40", "job_salary_period": "HOURLY", "extra": {"x": [1]}},
        {"job_title": "B", "job_min_salary": 0, "job_max_salary": None, "job_salary_period": "weekly"},
        {"job_title": "C", "job_min_salary": None, "job_max_salary": 900, "job_salary_period": "Weekly", "job_salary_currency": "EUR"},
        {"job_title": None, "job_city": "Bonn", "job_state": None, "job_country": "DE", "job_min_salary": "lots"},
    ]
    got = feeds.search_lines(lines(spark, *jobs, None, "", "{", "[1]", "7"), F.lit(AS_OF).cast("date")).collect()
    by = {r["title"]: r for r in got}
    assert len(got) == 4 and set(got[0].asDict()) == set(feeds.WHOLE)
    pay = {t: tuple(by[t][c] for c in feeds.PAY) for t in by}
    assert pay["A"] == (73840, 83200, "USD", "annual", "35.5-40 USD hourly")
    assert pay["B"] == (None, None, "USD", "weekly", None)
    assert pay["C"] == (None, 900, "EUR", "weekly", "None-900 EUR weekly")
    assert pay[""] == (None, None, "USD", "annual", None) and by[""]["location"] == "Bonn, DE"
    assert json.loads(by["A"]["raw_data"]) == jobs[0]


def test_scraped_lines_keep_zero_and_their_own_words(spark):
    jobs = [
        {"title": "A", "job_type": "in-office", "min_amount": "$1,000", "max_amount": 0, "interval": "monthly", "currency": "EUR"},
        {"title": "B", "job_type": "in office", "min_amount": "nan", "max_amount": None, "description": "NaN", "site": None},
        {"title": "C", "min_amount": 0, "max_amount": 0, "interval": "HOURLY", "description": None, "site": "x"},
    ]
    by = {r["title"]: r for r in feeds.scraped_lines(lines(spark, *jobs)).collect()}
    assert [by[t]["remote_type"] for t in "ABC"] == ["unknown", "on-site", "unknown"]
    assert tuple(by["A"][c] for c in feeds.PAY) == (12000, 0, "USD", "annual", "12000-0 EUR monthly")
    assert tuple(by["B"][c] for c in feeds.PAY) == (None, None, "USD", "annual", None)
    assert tuple(by["C"][c] for c in feeds.PAY) == (0, 0, "USD", "annual", None)
    assert [by[t]["description"] for t in "ABC"] == ["", "", ""] and [by[t]["source"] for t in "ABC"] == ["jobspy_jobspy", "jobspy_jobspy", "jobspy_x"]


def test_boards_keep_each_job_and_survive_what_is_broken(spark):
    jobs = [{"title": "A", "location": {"name": "Ulm"}, "more": None}, {"title": None, "location": "no object", "updated_at": "soon"}]
    dumps = spark.createDataFrame([("s", json.dumps({"jobs": jobs})), ("s", json.dumps({"jobs": []})), ("s", "{}"), ("s", "["), (None, None)], "slug string, body string")
    got = sorted(feeds.board_dump(dumps).collect(), key=lambda r: r["title"])
    assert [(r["title"], r["company"], r["location"], r["date_posted"], r["source_company_slug"]) for r in got] == [("", "s", "", None, "s"), ("A", "s", "Ulm", None, "s")]
    assert json.loads(got[1]["raw_data"]) == jobs[0]


def test_a_feed_that_has_not_landed_gives_no_rows(spark, tmp_path):
    frame = spark.createDataFrame([("greenhouse", "s", json.dumps({"jobs": [{"title": "A"}]}))], "feed string, slug string, body string")
    frame.write.partitionBy("feed", "slug").text(str(tmp_path / "landed"))
    got = feeds.read_landed(spark, str(tmp_path / "landed"), F.lit(AS_OF).cast("date"))
    assert [(r["title"], r["source_rank"]) for r in got.collect()] == [("A", 0)]
    assert got._jdf.queryExecution().toString().count("PartitionFilters: [isnotnull(feed") == 4
