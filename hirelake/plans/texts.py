"""Registered queries of descriptions: clean text, sections, pay, clearance, and postings short of content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pay
from ..functions.clearance import requires_clearance
from ..functions.sections import sanitized, text_features
from ..operators import descriptions
from .fixtures import FILLER, view
from .queries import query

K, T, TRIMMED = "seq", "seq % 8", f"rtrim({FILLER})"
LOW, HIGH = "(60 + seq % 90)", "(80 + seq % 90)"
BENEFITS = f"concat('**Benefits**', chr(10), 'Pay of $', 60 + seq % 30, ',000 to $', 80 + seq % 30, ',000 in Boston ', repeat('z', 450), ' $', 90 + seq % 9, ',000 to $', 110 + seq % 9, ',000 in Austin')"
LISTED = f"concat('Responsibilities', chr(10), 'Build & run unit ', seq, chr(10), {TRIMMED})"
RANGE = f"concat('Salary range', chr(10), '$', {LOW}, ',000 — $', {HIGH}, ',000')"
WANTED = f"concat('**Required Qualifications**', chr(10), {TRIMMED})"
#: The parts of the fixture's eight kinds of descriptions that are plain already.
SAME = f"WHEN 1 THEN description WHEN 4 THEN concat('Please sign in to view this job ', seq, chr(10), 'Requirements') WHEN 5 THEN concat('What you will do', chr(10), 'Plan unit ', seq, '. ', {TRIMMED}, chr(10), CASE WHEN seq % 16 = 5 THEN 'A security clearance is a plus.' ELSE 'A secret clearance is needed for all of the work we do here.' END) WHEN 7 THEN description ELSE '' END"
PLAIN = f"CASE {T} WHEN 0 THEN concat('About us', chr(10), chr(10), 'We make things ', seq, chr(10), chr(10), {LISTED}, chr(10), chr(10), {RANGE}) WHEN 2 THEN concat('**About the role**', chr(10), 'Some words ', seq, chr(10), {WANTED}, chr(10), chr(10), {BENEFITS}) {SAME}"
EXTRACT = f"CASE {T} WHEN 0 THEN concat({LISTED}, chr(10), {RANGE}) WHEN 2 THEN concat({WANTED}, chr(10), left({BENEFITS}, 700)) {SAME}"
COMPLETE = f"{T} IN (0, 2, 5)"
#: The lower and upper bound read from a description by the profile's places.
PLACED = "preferred_locations LIKE '%Austin%' AND preferred_locations NOT LIKE '%Boston%'"
READ_LOW = f"CASE WHEN {T} = 0 THEN {LOW} * 1000 WHEN {T} = 1 THEN {LOW} * 1000 WHEN {T} = 2 AND {PLACED} THEN (90 + seq % 9) * 1000 WHEN {T} = 2 THEN (60 + seq % 30) * 1000 END"
READ_HIGH = f"CASE WHEN {T} = 0 THEN {HIGH} * 1000 WHEN {T} = 1 THEN {LOW} * 1000 WHEN {T} = 2 AND {PLACED} THEN (110 + seq % 9) * 1000 WHEN {T} = 2 THEN (80 + seq % 30) * 1000 END"
LISTS = ["company_exclude", "exclude_industries", "exclude_company_types", "exclude_titles", "countries", "areas", "job_titles", "preferred_locations", "must_haves", "nice_to_haves"]


def seekers(spark, d) -> DataFrame:
    """Profiles with arrays for their lists."""
    return view(spark, d, "seekers").withColumns({c: F.filter(F.split(c, r"\|"), lambda x: x != "") for c in LISTS})


@query("sanitize_html", f"SELECT seq, {PLAIN} AS plain FROM described")
def sanitize_html(spark, d):
    return view(spark, d, "described").select("seq", sanitized(F.col("description")).alias("plain"))


@query("extract_sections", f"SELECT seq, {EXTRACT} AS extract, {T} IN (0, 5) AS has_work, {T} IN (2, 7) AS has_reqs, {T} IN (0, 2) AS has_comp FROM described")
def extract_sections(spark, d):
    found = view(spark, d, "described").select("seq", text_features("description").alias("f"))
    return found.select("seq", "f.extract", "f.has_work", "f.has_reqs", "f.has_comp")


@query("is_scoreable", f"SELECT seq, {T} IN (0, 2, 5, 7) AS scoreable FROM described")
def is_scoreable(spark, d):
    return view(spark, d, "described").select("seq", text_features("description")["scoreable"].alias("scoreable"))


@query("parse_salary_text", f"SELECT seq, profile_id, {READ_LOW} AS lo, {READ_HIGH} AS hi FROM (SELECT * EXCLUDE (profile_id) FROM described) CROSS JOIN seekers")
def parse_salary_text(spark, d):
    read = view(spark, d, "described").select("seq", pay.pay_candidates("description").alias("found"))
    each = read.crossJoin(F.broadcast(seekers(spark, d).select("profile_id", "preferred_locations")))  # eight profiles
    return each.select("seq", "profile_id", pay.choose(F.col("found"), F.col("preferred_locations")).alias("p")).select("seq", "profile_id", "p.lo", "p.hi")


@query("enrich_salary", f"SELECT seq, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN lo ELSE salary_min END AS salary_min, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN nullif(hi, lo) ELSE salary_max END AS salary_max FROM (SELECT seq, salary_min, salary_max, {READ_LOW} AS lo, CASE WHEN {READ_HIGH} = {READ_LOW} THEN NULL ELSE {READ_HIGH} END AS hi FROM described JOIN seekers USING (profile_id))")
def enrich_salary(spark, d):
    return descriptions.enrich_salary(view(spark, d, "described"), seekers(spark, d)).select("seq", "salary_min", "salary_max")


@query("filter_completeness", f"SELECT seq, {COMPLETE} AS complete FROM described")
def filter_completeness(spark, d):
    return descriptions.filter_completeness(view(spark, d, "described")).select("seq", "complete")


@query("filter_clearance", "SELECT seq, profile_id FROM (SELECT seq FROM described) CROSS JOIN seekers WHERE NOT (seq % 16 = 13 AND coalesce(NOT has_clearance, false))")
def filter_clearance(spark, d):
    told = view(spark, d, "described").select("seq", requires_clearance("title", "description").alias("needs"))
    pairs = told.crossJoin(F.broadcast(seekers(spark, d).select("profile_id", "has_clearance")))
    return pairs.where(~(F.col("needs") & F.coalesce(~F.col("has_clearance"), F.lit(False)))).select("seq", "profile_id")


def linked_postings(spark, d) -> DataFrame:
    """Postings with the link of their page; a page that isn't there leaves no link."""
    links = view(spark, d, "linked").select("page_id", F.col("url").alias("apply_url"))
    return view(spark, d, "described").join(links, "page_id", "left").withColumn("job_key", F.col("seq"))


PAGES = "(SELECT url, min(html) AS html FROM linked GROUP BY url)"
LINKED = f"(SELECT d.*, l.url AS apply_url, p.html AS html FROM described d LEFT JOIN linked l USING (page_id) LEFT JOIN {PAGES} p ON p.url = l.url)"
OUTCOME = f"CASE WHEN {T} = 0 THEN 'stored' WHEN {T} IN (2, 5) THEN 'ok' WHEN html LIKE '<h2>%' THEN 'fetched' ELSE 'missing_info' END"


@query("validate_descriptions", f"SELECT seq, {OUTCOME} AS outcome, CASE WHEN {OUTCOME} = 'fetched' THEN html WHEN seq % 4 = 0 THEN '' ELSE description END AS description FROM {LINKED} WHERE coalesce(title, '') <> '' AND coalesce(company, '') <> ''")
def validate_descriptions(spark, d):
    """Every fourth posting comes without a text, but has an earlier copy."""
    rows = linked_postings(spark, d)
    stored = rows.where("seq % 4 = 0").select("job_key", "description")
    fresh = rows.withColumn("description", F.when(F.col("seq") % 4 != 0, F.col("description")).otherwise(""))
    return descriptions.validate_descriptions(fresh, stored, view(spark, d, "linked")).select("seq", "outcome", "description")


@query("record_missing_info", f"SELECT profile_id, job_key, status, hidden, match_score FROM shared_verdicts UNION ALL SELECT profile_id, seq, 'missing_info', true, 0.0 FROM {LINKED} x WHERE coalesce(title, '') <> '' AND coalesce(company, '') <> '' AND {OUTCOME} = 'missing_info' AND NOT EXISTS (SELECT 1 FROM shared_verdicts v WHERE v.profile_id = x.profile_id AND v.job_key = x.seq)")
def record_missing_info(spark, d):
    rows = linked_postings(spark, d)
    stored = rows.where("seq % 4 = 0").select("job_key", "description")
    judged = descriptions.validate_descriptions(rows.withColumn("description", F.when(F.col("seq") % 4 != 0, F.col("description")).otherwise("")), stored, view(spark, d, "linked"))
    kept = view(spark, d, "shared_verdicts").select("profile_id", "job_key", "status", "hidden", "match_score")
    return descriptions.record_missing_info(kept, judged)


@query("recover_missing_info", f"SELECT profile_id, job_key, coalesce(html LIKE '<h2>%', false) AS recovered, CASE WHEN html LIKE '<h2>%' THEN html ELSE description END AS description FROM shared_verdicts JOIN (SELECT seq AS job_key, html, description FROM {LINKED}) USING (job_key) WHERE status = 'missing_info'")
def recover_missing_info(spark, d):
    return descriptions.recover_missing_info(view(spark, d, "shared_verdicts"), linked_postings(spark, d), view(spark, d, "linked"))


@query("backfill_descriptions", f"SELECT profile_id, job_key, concat('text of ', apply_url, ' 2') AS description FROM shared_verdicts JOIN (SELECT seq AS job_key, apply_url FROM {LINKED} WHERE source IN ('greenhouse', 'lever') AND coalesce(description, '') = '' AND apply_url IS NOT NULL AND page_id % 3 = 0) USING (job_key) WHERE status = 'new' AND job_key % 7 <> 0 AND NOT (hidden AND status_updated IS NOT NULL)")
def backfill_descriptions(spark, d):
    """The dump tells each third page's text twice; a seventh of the pairs is rejected now. One row for each pair that starts over."""
    verdicts = view(spark, d, "shared_verdicts")
    reasons = verdicts.select("profile_id", "job_key", F.when(F.col("job_key") % 7 == 0, "no").alias("reason"))
    pages = view(spark, d, "linked").where("page_id % 3 = 0").select(F.col("url").alias("apply_url"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("turn"))
    dump = pages.withColumn("description", F.when(F.col("turn") < 3, F.concat(F.lit("text of "), "apply_url", F.lit(" "), "turn")).otherwise(""))
    filled, again = descriptions.backfill_descriptions(linked_postings(spark, d), verdicts, reasons, dump, ["greenhouse", "lever"])
    return again.join(filled, "job_key").select("profile_id", "job_key", "description")
