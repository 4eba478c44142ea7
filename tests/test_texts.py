"""Unit cases of descriptions, pay, clearance, countries and edits."""

import html
import random

import pytest
from pyspark.sql import functions as F

from hirelake.functions import clearance, pay, sections
from hirelake.operators import country, descriptions, lifecycle, prefilter, scoring
from hirelake.sources import normalize

BODY = "Keep the lights on. " * 12


@pytest.mark.parametrize(
    ("text", "expected"),
    [(None, ""), ("", ""), ("a &amp;amp;lt; b", "a < b"), ("<p>x</p><script>y</script>z", "x\nz"), ("a\\*b\\_c", "a*b_c"), ("a<br/>\n\n\n\nb", "a\n\nb"), ("x  \ty", "x y")],
)
def test_sanitize(spark, text, expected):
    assert one(spark, text, lambda c: sections.sanitized(c)) == expected


def one(spark, text, of):
    return spark.createDataFrame([(text,)], "text string").select(of(F.col("text")).alias("x")).first()["x"]


def test_references_equal_the_standard_library(spark):
    rng = random.Random(3)
    parts = ["&amp;", "&lt;", "&nbsp;", "&#38;", "&#x26;", "&#97;", "&amp", "&notit;", "&mdash;", "&#0;", "&#128;", "&#129;", "&#x110000;", "&#xD800;", "&#xFFFE;", "&#127;", "&bogus;", "&&num;38;", "amp;", "lt;", "#", "&", "&#13;", "&#11;", "&#x1F600;", "&AMP;", "&copy", "&frac12", "&#99999999999;", "&#;", "&#x;", "&NotEqualTilde;", ";", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1500)] + ["&" + "amp;" * 40 + "lt;", "&amp" * 30, "&#38" * 20 + "num;38;" * 9]
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", sections.decoded(F.col("t")).alias("x")).collect()}
    for text in texts:
        plain = text
        while (now := html.unescape(plain)) != plain:
            plain = now
        assert got[text] == plain, text


def test_sections_skip_company_text_and_keep_pay(spark):
    read = lambda t, **k: one(spark, t, lambda c: sections.text_features(c, **k))
    f = read(f"About us\n\nWe exist.\n\nRequirements\n{BODY}\n\nEqual opportunity employer\n\n$90,000 - $120,000")
    assert (f.has_work, f.has_reqs, f.has_comp, f.scoreable) == (False, True, True, True)
    assert "We exist" not in f.extract and "Equal" not in f.extract and f.extract.endswith("$90,000 - $120,000")
    long = read("Requirements\n" + "x" * 5000 + "\n\nBenefits\n" + "y" * 5000)
    assert len(long.extract) == sections.MAX_CHARS + 1 and long.extract.count("y") == sections.PAY_CHARS - len("Benefits\n") and long.full_chars > 5000
    head = read(" ".join(f"word{i}" for i in range(2000)))
    assert not (head.has_work or head.has_reqs or head.has_comp or head.scoreable) and "\n...\n" in head.extract
    assert tuple(read(None)) == tuple(read("")) == ("", "", 0, False, False, False, False)
    glued = read("Intro line\n**REQUIREMENTS**\nuse tools\n**What you\u2019ll do**  \nbuild\n# Pay range\nfair")
    assert glued.extract == "**REQUIREMENTS**\nuse tools\n**What you\u2019ll do**  \nbuild\n# Pay range\nfair".replace("do**  ", "do**")
    assert not read("Please sign in to view\n\nRequirements\n" + BODY).scoreable


@pytest.mark.parametrize("kind", sections.HEADERS)
def test_every_wording_has_its_needed_word(kind):
    words = [sections._needed(w) for w in sections.HEADERS[kind] if not w.startswith("^")]
    assert all(len(w) > 2 for w in words)


def test_pay_candidates_and_choice(spark):
    assert pay.candidates("pays $1.5M to $2M") == [(1_500_000, 2_000_000, [])]
    assert [c[:2] for c in pay.candidates("$109,000 &mdash; $115,000")] == [(109_000, 115_000)]
    assert [c[:2] for c in pay.candidates("from $129,300/year in our lowest market up to $223,600/year")] == [(129_300, 223_600)]
    assert pay.candidates("a $5 - $9 lunch") == pay.candidates(None) == [] and pay.candidates("$70k a year") == [(70_000, 70_000, [])]
    rows = spark.createDataFrame([("$80k-$90k here" + "z" * 500 + "$100k-$110k in Boston",)], "text string")
    best = lambda *places: rows.select(pay.choose(pay.pay_candidates("text"), F.array(*map(F.lit, places)).cast("array<string>"))["lo"].alias("x")).first()["x"]
    assert best("Boston") == 100_000 and best() == best("Oslo") == 80_000


def test_clearance_wording():
    assert clearance.requires("Engineer", "A security clearance is needed") and clearance.requires(None, "TS/SCI")
    assert not clearance.requires("x", "A security clearance is a plus") and not clearance.requires(None, None)
    assert clearance.requires("x", "security clearance is a plus" + " " * 200 + "secret clearance")


@pytest.mark.parametrize(
    ("place", "countries", "expected"),
    [("Remote, Mexico", ["us"], True), ("Santa Fe, New Mexico", ["us"], False), ("Indianapolis, Indiana", ["us"], False), ("Toronto, Canada", ["us", "canada"], False), ("London, UK", ["US"], True), ("Remote", ["us"], False), (None, ["us"], False), ("Paris", [], False), ("Paris, France", None, False), ("Remote - US", ["canada"], True)],
)
def test_countries(spark, place, countries, expected):
    row = spark.createDataFrame([(place, countries)], "place string, countries array<string>")
    assert row.select(country.outside(F.col("place"), F.col("countries")).alias("x")).first()["x"] is expected


def test_rules_let_unknown_values_pass(spark):
    row = spark.createDataFrame([(None, None, None)], "kind string, title string, company string")
    got = row.select(prefilter.wrong_remote_type(F.col("kind"), F.lit("remote")).alias("a"), prefilter.title_matches(F.col("title"), F.array(F.lit("nurse"))).alias("b"), prefilter.excluded_company(F.col("company"), F.array(F.lit("acme"))).alias("c")).first()
    assert tuple(got) == (False, True, True)


def test_scores_of_two_profiles_stay_apart(spark):
    pairs = spark.createDataFrame([(1, "a", "Skill", "x", "y", "required", None), (2, "a", "skill", "x", None, "required", None), (1, "a", "compensation", "TBD", "y", None, "must_have")], "profile_id int, job_key string, category string, job_side string, candidate_side string, job_importance string, candidate_priority string")
    got = {r["profile_id"]: r for r in scoring.compute_scores(pairs, 1).collect()}
    assert got[1]["manager_score"] == 200 and got[2]["manager_score"] == 0 and got[1]["candidate_score"] == 0


def test_dates_and_scraped_pay(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    cutoff = F.lit("2024-01-10").cast("date")
    assert [one(normalize.is_fresh(F.lit(t).cast("string"), cutoff)) for t in ("2020-01-05T10:00:00Z", "2024-01-11T00:00:00Z", "soon", None)] == [False, True, True, True]
    assert one(normalize.parse_relative_date(F.lit("99999999999 days ago"), cutoff)) is None and one(normalize.parse_relative_date(F.lit("3days"), cutoff)) is None
    assert [one(normalize.scraped_pay(F.lit(t), F.lit("hourly"))) for t in ("$1,000", "nan", "much")] == [2_080_000, None, None]


def test_batches_start_over_at_the_budget(spark):
    jobs = spark.createDataFrame([(1, i, i, 35) for i in range(7)] + [(2, 0, 9, 0)], "profile_id int, turn int, job_key int, n_chars int")
    got = {(r["profile_id"], r["job_key"]): r["batch"] for r in scoring.token_batches(jobs, 30, 50).collect()}
    assert [got[1, i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2] and got[2, 9] == 0


def test_missing_descriptions_of_empty_tables(spark):
    rows = spark.createDataFrame([], "job_key string, title string, company string, apply_url string, description string")
    pages = spark.createDataFrame([], "url string, html string")
    assert descriptions.validate_descriptions(rows, rows.select("job_key", "description"), pages).count() == 0


def test_list_edits_keep_their_order(spark):
    log = spark.createDataFrame([(1, 3, "skills", "add", "a"), (1, 1, "skills", "add", "b"), (1, 2, "skills", "remove", "x"), (1, 4, "skills", "add", "a")], "profile_id int, event_id long, field string, action string, value string")
    before = spark.createDataFrame([(1, "skills", ["x", "y", "x"]), (2, "skills", None)], "profile_id int, field string, items array<string>")
    assert {r["profile_id"]: r["items"] for r in lifecycle.apply_list_edits(before, log).collect()} == {1: ["y", "b", "a"], 2: []}
