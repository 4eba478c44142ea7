"""The prefilter for many profiles: what a pair costs, common words, pay by zone, repeated rows and phrases in passes."""

import random

from hirelake.operators import many, phrases, prefilter
from hirelake.plans import catalog

from .test_many import POSTING, PROFILE


def pairs(df):
    return sorted((r["profile_id"], r["seq"], r["reason"] or "") for r in df.collect())


def every(postings, profiles):
    return pairs(prefilter.judge(postings.crossJoin(profiles)).where("title_ok").select("profile_id", "seq", "reason"))


def profile(i, titles, **of):
    own = {"company_exclude": [], "has_clearance": None, "hard_remote": "", "hard_salary_min": 0, "exclude_industries": [], "exclude_company_types": [], "exclude_titles": [], "countries": [], "areas": [], "job_titles": titles, "preferred_locations": []} | of
    return (i, *own.values())


def test_a_pair_runs_no_lambda_and_does_not_travel(spark):
    """The pairs stand at the top of the plan: above their join only comparisons and texts, no shuffle and no lambda."""
    text = catalog.QUERIES["pre_filter_many"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, join, below = text.partition("Join Inner")
    assert join and "lambda" not in above and "Union" not in text and "Aggregate" not in above
    assert "Join Inner" in below and "Distinct" not in text


def test_common_words_and_pay_by_zone_equal_every_pair(spark, monkeypatch):
    """Tiles of a few rows: each pair once, however many keys it shares; each pay for its zones alone."""
    monkeypatch.setattr(many, "TILE", 5)
    monkeypatch.setattr(many, "PARTS", 4)
    rng = random.Random(3)
    by_zone = [(60_000, 80_000, ["texas"]), (120_000, 150_000, ["boston", "ny"]), (90_000, 95_000, [])]
    titles = ["Data Engineer", "Data Platform Engineer", "Engineer", "QA", "", None, "C++ engineers"]
    jobs = [(i, rng.choice(["Acme", None, "Data Co", "ac"]), rng.choice(titles), rng.choice(["Austin, TX", "Paris, France", "Remote", None, ""]), rng.choice(["Remote", "on-site", None, "unknown", ""]), rng.choice([None, None, 0, 75_000]), rng.choice(["data work", None]), rng.random() < 0.3, rng.choice([by_zone, by_zone[:1], [], None])) for i in range(60)]
    people = [profile(i, rng.choice([["data engineer", "engineer"], ["QA"], ["c++"], ["ngineer"], ["Data Platform"], [], None]), hard_salary_min=rng.choice([0, 70_000, 100_000]), preferred_locations=rng.choice([["Austin"], ["Boston", "Austin"], ["Boston"], [], None]), hard_remote=rng.choice(["remote", "On-Site", "flexible", None]), company_exclude=rng.choice([["acme labs", "zed"], ["data"], []]), countries=rng.choice([["US", " uk"], ["France"], None]), areas=rng.choice([["tx", None], ["london"], []]), has_clearance=rng.choice([True, False, None])) for i in range(40)]
    postings, profiles = spark.createDataFrame(jobs, POSTING), spark.createDataFrame(people, PROFILE)
    got, want = pairs(many.match_many(postings, profiles)), every(postings, profiles)
    assert got == want and len({r for _, _, r in got}) > 15


def test_repeated_rows_are_judged_each(spark, monkeypatch):
    """Rows of one profile_id with other titles suit by their own titles; repeated postings give repeated pairs."""
    monkeypatch.setattr(many, "PARTS", 4)
    postings = spark.createDataFrame([(1, "Acme", "Nurse", "Remote", None, None, None, False, []), (1, "Acme", "Nurse", "Remote", None, None, None, False, []), (2, "Acme", "Engineer", "Remote", None, None, None, False, [])], POSTING)
    profiles = spark.createDataFrame([profile(7, ["nurse"]), profile(7, ["engineer"], company_exclude=["acme"]), profile(8, ["nurse", "engineer nurse"])], PROFILE)
    got = pairs(many.match_many(postings, profiles))
    assert got == every(postings, profiles) and len(got) == 6


def test_phrases_in_several_passes_equal_one(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(0, i, text(rng.randrange(0, 30))) for i in range(80)] + [(1, 0, "aab"), (2, 0, "aab")]
    wanted = [(rng.randrange(2), text(rng.randrange(1, 8))) for _ in range(60)]
    texts, wanted = spark.createDataFrame(texts, "kind int, id long, text string"), spark.createDataFrame(wanted, "kind int, phrase string")
    read = lambda: sorted((r["kind"], r["id"], tuple(sorted(r["hits"]))) for r in phrases.occurrences(texts, wanted).collect())
    one = read()
    want = sorted((k, i, h) for k, i, t in ((r["kind"], r["id"], r["text"]) for r in texts.collect()) if (h := tuple(sorted({r["phrase"] for r in wanted.collect() if r["kind"] == k and r["phrase"] in t}))))
    monkeypatch.setattr(phrases, "PART", 9)
    assert one == want == read()
