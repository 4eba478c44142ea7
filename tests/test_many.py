"""The prefilter for many profiles against judging every pair, and phrases against a search of every text."""

import random

from hirelake.operators import many, phrases, prefilter

POSTING = "seq long, company string, title string, location string, remote_type string, salary_min long, description string, needs_clearance boolean, pay array<struct<lo:bigint,hi:bigint,zones:array<string>>>"
PROFILE = "profile_id long, company_exclude array<string>, has_clearance boolean, hard_remote string, hard_salary_min long, exclude_industries array<string>, exclude_company_types array<string>, exclude_titles array<string>, countries array<string>, areas array<string>, job_titles array<string>, preferred_locations array<string>"


def test_occurrences_equal_a_search_of_every_text(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, text(rng.randrange(0, 40))) for i in range(300)] + [(900, None), (901, "")] + [(1000 + i, "aaa aaa") for i in range(100)]
    wanted = [text(rng.randrange(1, 7)) for _ in range(80)] + ["", "aaa", "aaa", "zzz", "é"]
    got = {r["id"]: set(r["hits"]) for r in phrases.occurrences(spark.createDataFrame([(i % 1, i, t) for i, t in texts], "kind int, id long, text string"), spark.createDataFrame([(0, p) for p in [*wanted, None]] + [(1, "a")], "kind int, phrase string")).collect()}
    want = {i: {p for p in wanted if p and p in (t or "")} for i, t in texts}
    assert got == {i: h for i, h in want.items() if h}


def test_many_profiles_get_the_reasons_of_every_pair(spark):
    rng = random.Random(2)
    pick = lambda values, most: rng.sample(values, rng.randrange(0, most + 1))
    titles = ["Senior Data Engineer", "data analyst", "Sales Director", "Nurse", "", None, "QA, Lead (Remote)", "c++ developer"]
    companies = ["Acme", "Acme Data Labs", "data", "", None, "Big Co", "Zed"]
    places = ["Austin, TX", "Remote", "Toronto, Canada", "", None, "London, UK"]
    jobs = [(i, rng.choice(companies), rng.choice(titles), rng.choice(places), rng.choice(["remote", "hybrid", "unknown", None]), rng.choice([None, 50_000, 150_000]), rng.choice(["We do DATA work", None, "Nursing home", "x" * 400 + " data"]), rng.random() < 0.3, [(70_000, 90_000, [])] if rng.random() < 0.5 else []) for i in range(120)]
    people = [
        (i, pick(["acme", " DATA ", "big co of all", "zed"], 2), rng.choice([True, False, None]), rng.choice(["remote", "flexible", "", None]), rng.choice([0, 80_000, None]), pick(["data", "nurs", "x"], 2), pick(["nursing", "Sales", "labs"], 2), pick(["data", "lead", "c++", "director "], 2), pick(["us", "canada"], 1), pick(["tx", "Toronto"], 1), pick(["Data Engineer", "nurse", "qa", "sales lead", "C++"], 3) or rng.choice([None, []]), pick(["Austin"], 1))
        for i in range(60)
    ]
    postings, profiles = spark.createDataFrame(jobs, POSTING), spark.createDataFrame(people, PROFILE)
    got = {(r["profile_id"], r["seq"]): r["reason"] for r in many.match_many(postings, profiles).collect()}
    every = prefilter.judge(postings.crossJoin(profiles)).where("title_ok").select("profile_id", "seq", "reason").collect()
    assert got == {(r["profile_id"], r["seq"]): r["reason"] for r in every} and len(set(got.values())) > 20
    assert many.match_many(postings.where("false"), profiles).count() == 0
    plan = many.match_many(postings, profiles)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
