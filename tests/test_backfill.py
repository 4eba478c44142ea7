"""Backfill on hand-made verdicts: dismissed rows, nulls, repeated pairs, the last filled text, no postings at all."""

from hirelake.operators import descriptions

JOBS = "job_key long, apply_url string, source string, company string, title string, location string, remote_type string, salary_min long, description string"
PROFILES = "profile_id long, company_exclude array<string>, has_clearance boolean, hard_remote string, hard_salary_min long, exclude_industries array<string>, exclude_company_types array<string>, exclude_titles array<string>, countries array<string>, areas array<string>, job_titles array<string>, preferred_locations array<string>"
VERDICTS = "profile_id long, job_key long, status string, hidden boolean, status_updated date, match_notes string, manager_score int, candidate_score int, match_score double, rank int"
DUMP = "apply_url string, description string, raw_data string, turn int"


def test_backfill_resets_what_is_new_accepted_and_not_dismissed(spark):
    import datetime

    day = datetime.date(2024, 1, 2)
    jobs = spark.createDataFrame([(1, "u1", "b", "Acme", "Nurse", None, None, None, None), (2, "u2", "b", "Bad Co", "Nurse", None, None, None, ""), (3, "u3", "b", "Acme", None, "", "", 1, "has text"), (4, None, "b", "Acme", "Nurse", None, None, None, ""), (5, "u5", "other", "Acme", "Nurse", None, None, None, ""), (6, "u6", "b", None, None, None, None, None, None)], JOBS)
    profiles = spark.createDataFrame([(1, ["bad co"], None, None, None, None, None, None, None, None, None, None), (2, *[None] * 11)], PROFILES)
    v = lambda p, j, status="new", hidden=False, at=None: (p, j, status, hidden, at, "note", 7, 8, 0.5, 3)
    verdicts = spark.createDataFrame([v(1, 1), v(2, 1, hidden=True), v(2, 1, hidden=True, at=day), v(1, 2), v(2, 2), v(1, 3), v(1, 4), v(1, 5), v(1, 6, "applied"), v(2, 6, None), v(9, 1)], VERDICTS)
    dump = spark.createDataFrame([("u1", "old", "{1}", 1), ("u1", "new", "{2}", 2), ("u1", "", "{3}", 3), ("u1", None, "{4}", 4), ("u2", "two", None, 1), ("u3", "x", "", 1), (None, "x", "", 1), ("u5", "x", "", 1), ("u6", "x", "", 1)], DUMP)
    texts, state = descriptions.backfill(verdicts, jobs, profiles, dump, ["b"])
    assert sorted(map(tuple, texts.collect())) == [(1, "new", "{2}"), (2, "two", None)]
    got = state.collect()
    assert len(got) == 11
    over = sorted((r["profile_id"], r["job_key"], r["status_updated"]) for r in got if r["started_over"])
    assert over == [(1, 1, None), (2, 1, None), (2, 2, None)]
    assert all((r["hidden"], r["match_notes"], r["manager_score"], r["candidate_score"], r["match_score"], r["rank"]) == (False, None, None, None, 0.0, None) for r in got if r["started_over"])
    assert all((r["match_notes"], r["manager_score"], r["rank"]) == ("note", 7, 3) for r in got if not r["started_over"])
    texts, state = descriptions.backfill(verdicts, jobs.limit(0), profiles, dump, ["b"])
    assert texts.count() == 0 and state.where("started_over").count() == 0 and state.count() == 11
