"""Registered queries of reports with all their options, of nested merges, and of responses by profile and batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, lifecycle, reports
from .fixtures import AS_OF, RETENTION_DAYS, view
from .queries import EFFECTIVE, KEY, NOW, OLDEST, SHOWN, effective_date, query

GONE = 3
_TALK = "('phone_screen', 'interview_1', 'interview_2', 'interview_3')"
_RECENT = f"(status NOT IN ('new', 'missing_info') OR effective >= concat('', {NOW} - {RETENTION_DAYS}))"
_SEEN = f"NOT hidden AND {SHOWN}"
_JOINED = f"(SELECT v.*, title, company, date_posted, date_found, {EFFECTIVE} AS effective FROM shared_verdicts v JOIN (SELECT * EXCLUDE (profile_id) FROM postings) p ON p.seq = v.job_key)"
_TABS = {
    "'all'": f"{_RECENT} AND {_SEEN}",
    "'saved'": f"{_RECENT} AND {_SEEN} AND coalesce(saved, false)",
    "'interviewing'": f"{_RECENT} AND {_SEEN} AND status IN {_TALK}",
    "status": f"{_RECENT} AND {_SEEN} AND status <> 'missing_info'",
    "'missing_info'": f"{_RECENT} AND status = 'missing_info'",
    "'show_all'": f"{_RECENT} AND manager_score IS NOT NULL",
    "'hidden'": "hidden AND manager_score IS NOT NULL",
}


def jobs_of(spark, d):
    return view(spark, d, "postings").select(F.col("seq").alias("job_key"), "title", "company", "date_posted", "date_found", effective_date().alias("effective"))


@query("list_match_tabs", " UNION ALL ".join(f"SELECT {tab} AS tab, profile_id, job_key, title, status FROM {_JOINED} WHERE {rule}" for tab, rule in _TABS.items()))
def list_match_tabs(spark, d):
    return reports.matches_by_tab(view(spark, d, "shared_verdicts"), jobs_of(spark, d), OLDEST).select("tab", "profile_id", "job_key", "title", "status")


_ORDERS = {"score": "coalesce(manager_score, 0) + coalesce(candidate_score, 0) DESC", "date": "date_posted DESC NULLS LAST, date_found DESC", "found": "date_found DESC", "company": "company, title", "status": "status"}
_FIRST = " UNION ALL ".join(f"SELECT * FROM (SELECT '{sort}' AS sort, job_key FROM {_JOINED} WHERE profile_id = 2 AND {_TABS["'all'"]} ORDER BY {by}, job_key LIMIT 40)" for sort, by in _ORDERS.items())


@query("list_matches_sorted", _FIRST)
def list_matches_sorted(spark, d):
    """The first page of one profile's matches in each order."""
    rows = reports.matches_by_tab(view(spark, d, "shared_verdicts").where("profile_id = 2"), jobs_of(spark, d), OLDEST).where("tab = 'all'")
    pages = [reports.in_order(rows, sort).limit(40).select(F.lit(sort).alias("sort"), "job_key") for sort in _ORDERS]
    first = pages[0]
    for page in pages[1:]:
        first = first.unionByName(page)
    return first


@query("stage_totals", f"SELECT profile_id, count(*) FILTER ({_SEEN}) AS total, count(*) FILTER (NOT hidden AND coalesce(saved, false)) AS saved, count(*) FILTER ({_SEEN} AND status IN {_TALK}) AS interviewing, count(*) FILTER (status = 'missing_info') AS missing_info, count(*) FILTER (hidden AND manager_score IS NOT NULL) AS hidden_scored FROM shared_verdicts GROUP BY 1")
def stage_totals(spark, d):
    return reports.stage_totals(view(spark, d, "shared_verdicts"))


_WANTED = {
    "of_profile": ("seq IN (SELECT job_key FROM shared_verdicts WHERE profile_id = 2) AND source = 'lever'", {"profile": 2, "source": "lever"}),
    "of_none": ("seq NOT IN (SELECT job_key FROM shared_verdicts) AND contains(lower(concat(title, '|', company)), 'data')", {"profile": "none", "text": " Data "}),
    "missing": ("seq IN (SELECT job_key FROM shared_verdicts WHERE status = 'missing_info') AND coalesce(salary_min, salary_max) IS NOT NULL", {"missing_info": True, "paid": True}),
    "scored": ("seq IN (SELECT job_key FROM shared_verdicts WHERE manager_score IS NOT NULL) AND remote_type = 'remote'", {"scored": True, "remote_type": "remote"}),
}


def searched(spark, d):
    jobs, verdicts = view(spark, d, "postings").withColumnRenamed("seq", "job_key"), view(spark, d, "shared_verdicts")
    found = [reports.found_jobs(jobs, verdicts, **options).select(F.lit(name).alias("search"), "job_key", F.col("profile_id").alias("fetched_for")) for name, (_, options) in _WANTED.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


_SEARCHED = " UNION ALL ".join(f"SELECT '{name}' AS search, seq AS job_key, profile_id AS fetched_for FROM postings WHERE {rule}" for name, (rule, _) in _WANTED.items())


@query("search_jobs_by_verdict", _SEARCHED)
def search_jobs_by_verdict(spark, d):
    return searched(spark, d)


@query("search_totals", f"SELECT search, count(*) AS n FROM ({_SEARCHED}) GROUP BY 1")
def search_totals(spark, d):
    return searched(spark, d).groupBy("search").agg(F.count("*").alias("n"))


@query("named_associations", "SELECT job_key, string_agg(concat(name, ': ', CASE WHEN starts_with(match_notes, '[') THEN split_part(match_notes, '] ', 2) WHEN manager_score IS NULL THEN 'unscored' ELSE concat(manager_score, '/', coalesce(candidate_score, 0), ' ', CAST(round(match_score * 100) AS INT), '%') END), '; ' ORDER BY name, status) AS chips FROM (SELECT *, concat('Seeker ', 9 - profile_id) AS name FROM shared_verdicts) GROUP BY 1")
def named_associations(spark, d):
    names = view(spark, d, "profiles").select("profile_id", F.concat(F.lit("Seeker "), 9 - F.col("profile_id")).alias("name"))
    return reports.associations(view(spark, d, "shared_verdicts"), names)


@query("source_counts", "SELECT 'source' AS facet, source AS value, count(*) AS n FROM postings GROUP BY 2 UNION ALL SELECT DISTINCT 'remote_type', remote_type, CAST(NULL AS BIGINT) FROM postings WHERE remote_type IS NOT NULL")
def source_counts(spark, d):
    rows = view(spark, d, "postings")
    kinds = rows.where("remote_type is not null").select(F.lit("remote_type").alias("facet"), F.col("remote_type").alias("value"), F.lit(None).cast("long").alias("n")).distinct()
    return rows.groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n")).select(F.lit("source").alias("facet"), "value", "n").orderBy(F.desc("n")).unionByName(kinds)


_ENDED = f"CASE WHEN run_id % 7 = 0 THEN 'broken' WHEN run_id % 11 = 0 THEN NULL ELSE strftime(CAST({NOW} AS TIMESTAMP) - to_hours(CAST(hours_ago AS BIGINT)), '%Y-%m-%d %H:%M:%S') END"
_LAST = f"SELECT profile_id, profile_id % 3 AS own, finished, CASE WHEN finished IS NULL OR finished = 'broken' THEN 9999 ELSE date_diff('hour', CAST(finished AS TIMESTAMP), CAST({NOW} AS TIMESTAMP)) END AS h FROM (SELECT profile_id, run_id, hours_ago, {_ENDED} AS finished FROM runs WHERE status = 'success') QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY hours_ago, run_id DESC) = 1"


@query("search_mode_choices", f"SELECT profile_id, CASE WHEN f THEN 'full' ELSE 'incremental' END AS mode, CAST(CASE WHEN f THEN 720 ELSE least(h + 24, 720) END AS BIGINT) AS hours FROM (SELECT *, profile_id = 4 OR own = 1 OR (own <> 2 AND h > 720) AS f FROM ({_LAST}))")
def search_mode_choices(spark, d):
    """Settings by profile: automatic, full, incremental; a forced run; and last runs whose time is null or broken."""
    as_of, k, p = F.lit(AS_OF).cast("date"), F.col("run_id"), F.col("profile_id")
    at = (as_of.cast("timestamp") - F.make_interval(hours=F.col("hours_ago").cast("int"))).cast("string")
    ended = F.when(k % 7 == 0, "broken").when(k % 11 == 0, F.lit(None)).otherwise(at)
    last = view(spark, d, "runs").where("status = 'success'").groupBy("profile_id").agg(F.max_by(ended, F.struct(-F.col("hours_ago"), "run_id")).alias("finished"))
    override = F.when(p % 3 == 1, "full").when(p % 3 == 2, "incremental").otherwise("auto")
    mode, hours = reports.search_mode(F.col("finished"), as_of, override, p == 4)
    return last.select("profile_id", mode.alias("mode"), hours.alias("hours"))


_ORDERED = f"SELECT *, run_id - hours_ago * 1000000000000 AS o, {_ENDED} AS finished FROM runs"
_EACH = f"SELECT a.profile_id, a.run_id, a.profile_id % 3 AS own, CASE WHEN s.finished IS NULL OR s.finished = 'broken' THEN 9999 ELSE date_diff('hour', CAST(s.finished AS TIMESTAMP), CAST({NOW} AS TIMESTAMP) - to_hours(CAST(a.hours_ago AS INTEGER))) END AS h FROM ({_ORDERED}) a ASOF LEFT JOIN (SELECT * FROM ({_ORDERED}) WHERE status = 'success') s ON a.profile_id = s.profile_id AND a.o > s.o"


@query("search_mode_history", f"SELECT profile_id, run_id, CASE WHEN f THEN 'full' ELSE 'incremental' END AS mode, CAST(CASE WHEN f THEN 720 ELSE least(h + 24, 720) END AS BIGINT) AS hours FROM (SELECT *, profile_id = 4 OR own = 1 OR (own <> 2 AND h > 720) AS f FROM ({_EACH}))")
def search_mode_history(spark, d):
    """Mode and hours of every run in the log, as each was chosen when it began."""
    now, k, p = F.lit(AS_OF).cast("date").cast("timestamp"), F.col("run_id"), F.col("profile_id")
    at = now - F.make_interval(hours=F.col("hours_ago").cast("int"))
    ended = F.when(k % 7 == 0, "broken").when(k % 11 == 0, F.lit(None)).otherwise(at.cast("string"))
    log = reports.last_success(view(spark, d, "runs").select("profile_id", "run_id", "status", at.alias("started"), ended.alias("finished")))
    override = F.when(p % 3 == 1, "full").when(p % 3 == 2, "incremental").otherwise("auto")
    mode, hours = reports.search_mode(F.col("last_finished"), F.col("started"), override, p == 4)
    return log.select("profile_id", "run_id", mode.alias("mode"), hours.alias("hours"))


@query("clear_counts", f"SELECT scope, name, n FROM (SELECT 'profile' AS scope, 'verdicts' AS name, count(*) AS n FROM verdicts WHERE profile_id = {GONE} UNION ALL SELECT 'profile', 'runs', count(*) FROM runs WHERE profile_id = {GONE} UNION ALL SELECT 'profile', 'jobs', count(*) FROM postings WHERE seq NOT IN (SELECT job_key FROM verdicts WHERE profile_id <> {GONE}) UNION ALL SELECT 'all', 'verdicts', count(*) FROM verdicts UNION ALL SELECT 'all', 'runs', count(*) FROM runs UNION ALL SELECT 'all', 'jobs', count(*) FROM postings)")
def clear_counts(spark, d):
    jobs, verdicts, runs = view(spark, d, "postings").select(F.col("seq").alias("job_key")), view(spark, d, "verdicts"), view(spark, d, "runs")
    scopes = [reports.cleared(jobs, verdicts, runs, who).select(F.lit(scope).alias("scope"), "name", "n") for scope, who in (("profile", GONE), ("all", None))]
    return scopes[0].unionByName(scopes[1])


_NEWKEY = f"(SELECT *, {KEY} AS key FROM postings WHERE title <> '' AND company <> '')"


@query("run_audit_rows", f"SELECT profile_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS found, count(*) FILTER (rn = 1 AND key NOT IN (SELECT {KEY} FROM postings WHERE seq % 17 = 0)) AS added, count(*) FILTER (source = 'jsearch') AS credits, CASE WHEN bool_or(source = 'lever') THEN 'success' ELSE 'failed' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY profile_id, source_rank, seq) AS rn FROM {_NEWKEY}) GROUP BY 1")
def run_audit_rows(spark, d):
    """An audit row for each profile's run: a request of the search service for each of its rows, and success if the last feed gave rows."""
    rows = view(spark, d, "postings").where("title <> '' and company <> ''")
    stored = view(spark, d, "postings").where("seq % 17 = 0").select(ingest.job_key(F.col("title"), F.col("company"), F.col("location")).alias("job_key"))
    added = ingest.first_wins(rows, stored).groupBy("profile_id").agg(F.count("*").alias("added"))
    runs = rows.groupBy("profile_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("found"), F.count_if(F.col("source") == "jsearch").alias("credits"), F.when(F.bool_or(F.col("source") == "lever"), "success").otherwise("failed").alias("status"))
    return runs.join(added, "profile_id", "left").select("profile_id", "sources", "found", F.coalesce("added", F.lit(0)).alias("added"), "credits", "status")


@query("merge_nested_profiles", "SELECT seq, 'old' AS profile_name, concat('Sql, spark', CASE WHEN seq % 2 = 0 THEN '' ELSE ', Rust' END) AS skills, CASE WHEN location = '' THEN 'Bonn' ELSE location END AS place, CASE WHEN seq % 3 = 0 THEN 'de' ELSE 'EN, fr' END AS langs, CAST(seq % 2 + CASE WHEN location = '' THEN 1 ELSE 0 END + 1 AS BIGINT) AS additions FROM postings")
def merge_nested_profiles(spark, d):
    k, names = F.col("seq"), lambda *x: F.array(*map(F.lit, x))
    old = F.struct(F.lit("old").alias("profile_name"), names("Sql", "spark").alias("skills"), F.struct("location", F.when(k % 3 != 0, names("EN")).alias("langs")).alias("contact"))
    new = F.struct(F.lit("new").alias("profile_name"), F.array(F.lit("SQL"), F.when(k % 2 == 0, "SPARK").otherwise("Rust")).alias("skills"), F.struct(F.lit("Bonn").alias("location"), F.when(k % 3 == 0, names("de")).otherwise(names("en", "fr")).alias("langs")).alias("contact"))
    rows = view(spark, d, "postings").select("seq", old.alias("old"), new.alias("new"))
    merged, additions = lifecycle.merged_struct(F.col("old"), F.col("new"), rows.schema["old"].dataType)
    return rows.select("seq", merged.alias("m"), additions.cast("long").alias("additions")).select("seq", "m.profile_name", F.array_join("m.skills", ", ").alias("skills"), F.col("m.contact.location").alias("place"), F.array_join("m.contact.langs", ", ").alias("langs"), "additions")


@query("parse_responses_by_batch", "SELECT profile_id, job_key // 10 AS batch_id, job_key, category, job_side, candidate_side FROM own_matches WHERE (profile_id + job_key // 10) % 7 <> 0 AND job_key % 9 <> 0 UNION ALL SELECT DISTINCT profile_id, job_key // 10, job_key, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM own_matches WHERE (profile_id + job_key // 10) % 7 <> 0 AND job_key % 9 = 0")
def parse_responses_by_batch(spark, d):
    """Responses of ten jobs each; every ninth job came back without pairs."""
    pair = F.struct("category", "job_side", "candidate_side", "job_importance", "candidate_priority")
    batch = F.expr("job_key div 10")
    jobs = view(spark, d, "own_matches").groupBy("profile_id", "job_key").agg(F.collect_list(F.when(F.col("job_key") % 9 != 0, pair)).alias("match_pairs"))
    bodies = jobs.groupBy("profile_id", batch.alias("batch_id")).agg(F.to_json(F.collect_list(F.struct("job_key", "match_pairs"))).alias("body"))
    text = F.when((F.col("profile_id") + F.col("batch_id")) % 7 == 0, F.concat(F.lit("No. "), "body")).otherwise(F.concat(F.lit("```json\n"), "body", F.lit("\n```")))
    told = lifecycle.parse_match_responses(bodies.select("profile_id", "batch_id", text.alias("response")), ("profile_id", "batch_id"), True)
    return told.select("profile_id", "batch_id", "job_key", "category", "job_side", "candidate_side")
