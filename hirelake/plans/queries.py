"""Registered queries of the matching library, each beside its DuckDB oracle."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, lifecycle, prefilter, scoring
from ..sources import normalize
from .fixtures import AS_OF, RETENTION_DAYS, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOP, LEAST, IDEAL = 50, 0.4, 4
SHOWN = "(manager_score IS NOT NULL OR coalesce(saved, false) OR status NOT IN ('new', 'missing_info'))"
ACTIVE = "status IN ('applied', 'phone_screen', 'interview_1', 'interview_2', 'interview_3', 'offer')"
NOW = f"DATE '{AS_OF}'"


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, with_views(oracle)
        return f

    return keep


def effective_date() -> F.Column:
    """date_posted if it has the shape of a date, else the day it was found, as text."""
    return F.when(F.col("date_posted").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date_posted")).otherwise(F.col("date_found").cast("string"))


EFFECTIVE = "CASE WHEN regexp_matches(date_posted, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN date_posted ELSE concat('', date_found) END"
OLDEST = (datetime.date.fromisoformat(AS_OF) - datetime.timedelta(RETENTION_DAYS)).isoformat()


@query("infer_remote_type", "SELECT seq, CASE WHEN contains(t, 'remote') THEN 'remote' WHEN contains(t, 'hybrid') THEN 'hybrid' WHEN regexp_matches(t, 'on-site|onsite|in office|in-office') THEN 'on-site' ELSE 'unknown' END AS kind FROM (SELECT seq, lower(concat(title, ' ', location, ' ', CASE WHEN seq % 3 = 0 THEN 'Hybrid' WHEN seq % 3 = 1 THEN 'In Office' ELSE '' END)) AS t FROM postings)")
def infer_remote_type(spark, d):
    extra = F.when(F.col("seq") % 3 == 0, "Hybrid").when(F.col("seq") % 3 == 1, "In Office")
    return view(spark, d, "postings").select("seq", normalize.infer_remote_type(F.col("title"), F.col("location"), extra).alias("kind"))


@query("annualize_salary", "SELECT seq, nullif(pay_low * f, 0) AS low, nullif(pay_high * f, 0) AS high, concat(pay_low, '-', CASE WHEN pay_high = 0 THEN 'None' ELSE concat('', pay_high) END, ' USD ', pay_period) AS salary_raw FROM (SELECT *, CASE pay_period WHEN 'hourly' THEN 2080 WHEN 'monthly' THEN 12 ELSE 1 END AS f FROM postings)")
def annualize_salary(spark, d):
    low, high, period = F.col("pay_low"), F.col("pay_high"), F.col("pay_period")
    return view(spark, d, "postings").select("seq", normalize.annualize(low, period).alias("low"), normalize.annualize(high, period).alias("high"), normalize.salary_raw(low, high, period).alias("salary_raw"))


@query("parse_relative_date", f"SELECT seq, CASE posted_text WHEN '3 days ago' THEN '2024-01-28' WHEN 'today' THEN '{AS_OF}' WHEN '2 weeks ago' THEN '2024-01-17' WHEN '1 month ago' THEN '2024-01-01' WHEN '5 hours ago' THEN '{AS_OF}' WHEN '2024-01-05T10:00:00' THEN '2024-01-05' END AS posted FROM postings")
def parse_relative_date(spark, d):
    return view(spark, d, "postings").select("seq", normalize.parse_relative_date(F.col("posted_text"), F.lit(AS_OF).cast("date")).alias("posted"))


@query("filter_fresh", f"SELECT seq FROM postings WHERE try_cast(date_posted AS DATE) IS NULL OR try_cast(date_posted AS DATE) >= {NOW} - 10")
def filter_fresh(spark, d):
    return view(spark, d, "postings").where(normalize.is_fresh(F.col("date_posted"), F.date_sub(F.lit(AS_OF).cast("date"), 10))).select("seq")


_LAST_OK = "SELECT profile_id, min(hours_ago) FILTER (status = 'success') AS h FROM runs GROUP BY 1"
_OLDEST_TS = f"CAST({NOW} - 10 AS TIMESTAMP)"
#: Every fourth profile's last run is stored as what is no time.
_CUTOFF = f"CASE WHEN h IS NULL OR profile_id % 4 = 3 THEN {_OLDEST_TS} ELSE greatest({_OLDEST_TS}, CAST({NOW} AS TIMESTAMP) - to_hours(CAST(h AS BIGINT))) END"


@query(
    "filter_fresh_since_run",
    f"SELECT seq FROM postings LEFT JOIN ({_LAST_OK}) USING (profile_id) WHERE try_cast(date_posted AS TIMESTAMP) IS NULL OR try_cast(date_posted AS TIMESTAMP) >= {_CUTOFF}",
)
def filter_fresh_since_run(spark, d):
    as_of = F.lit(AS_OF).cast("date")
    ok = view(spark, d, "runs").where("status = 'success'").groupBy("profile_id").agg(F.min("hours_ago").cast("int").alias("h"))
    last = F.when(F.col("profile_id") % 4 == 3, "never").otherwise((as_of.cast("timestamp") - F.make_interval(hours=F.col("h"))).cast("string"))
    cutoffs = ok.select("profile_id", normalize.fresh_since(as_of, 10, last).alias("cutoff"))
    dated = view(spark, d, "postings").join(F.broadcast(cutoffs), "profile_id", "left")  # profiles are a fixed few
    return dated.where(normalize.is_fresh(F.col("date_posted"), F.coalesce("cutoff", normalize.fresh_since(as_of, 10, F.lit(None))))).select("seq")


KEY = "substr(md5(concat(regexp_replace(lower(title), '[^\\p{L}\\p{N}_|]', '', 'g'), '|', regexp_replace(lower(company), '[^\\p{L}\\p{N}_|]', '', 'g'), '|', regexp_replace(lower(location), '[^\\p{L}\\p{N}_|]', '', 'g'))), 1, 16)"


@query("make_job_key", f"SELECT seq, {KEY} AS job_key FROM postings")
def make_job_key(spark, d):
    return view(spark, d, "postings").select("seq", ingest.job_key(F.col("title"), F.col("company"), F.col("location")).alias("job_key"))


@query("dedupe_insert_new", f"SELECT job_key, seq, profile_id AS fetched_for FROM (SELECT *, {KEY} AS job_key, row_number() OVER (PARTITION BY {KEY} ORDER BY profile_id, source_rank, seq) AS rn FROM postings WHERE title <> '' AND company <> '') WHERE rn = 1 AND job_key NOT IN (SELECT {KEY} FROM postings WHERE seq % 17 = 0)")
def dedupe_insert_new(spark, d):
    rows = view(spark, d, "postings")
    stored = rows.where("seq % 17 = 0").select(ingest.job_key(F.col("title"), F.col("company"), F.col("location")).alias("job_key"))
    return ingest.first_wins(rows, stored).select("job_key", "seq", F.col("profile_id").alias("fetched_for"))


@query(
    "ingest_counts",
    f"""SELECT profile_id, count(*) AS seen, count(*) FILTER (rn = 1 AND job_key NOT IN (SELECT {KEY} FROM postings WHERE seq % 17 = 0)) AS new
    FROM (SELECT *, CASE WHEN usable THEN row_number() OVER (PARTITION BY usable, job_key ORDER BY profile_id, source_rank, seq) END AS rn
          FROM (SELECT *, coalesce(title <> '' AND company <> '', false) AS usable, coalesce({KEY}, '') AS job_key FROM postings))
    GROUP BY 1""",
)
def ingest_counts(spark, d):
    rows = view(spark, d, "postings")
    stored = rows.where("seq % 17 = 0").select(ingest.job_key(F.col("title"), F.col("company"), F.col("location")).alias("job_key"))
    return ingest.counts(rows, ingest.first_wins(rows, stored))


def matched(spark, d) -> DataFrame:
    """Postings beside the requirements of the profile that fetched them; the profiles are a fixed few."""
    return view(spark, d, "postings").join(view(spark, d, "profiles"), "profile_id")


@query("filter_company_exclude", "SELECT seq, profile_id FROM postings JOIN profiles USING (profile_id) WHERE NOT coalesce(list_bool_or(list_transform(list_filter(string_split(company_exclude, '|'), lambda x: x <> ''), lambda x: contains(lower(company), x) OR contains(x, lower(company)))), false)")
def filter_company_exclude(spark, d, pairs=matched):
    return pairs(spark, d).where(~prefilter.excluded_company(F.col("company"), prefilter.items(F.col("company_exclude")))).select("seq", "profile_id")


@query("filter_remote_type", "SELECT seq, profile_id FROM postings JOIN profiles USING (profile_id) WHERE remote_pref IN ('', 'flexible') OR remote_type IN ('unknown', remote_pref)")
def filter_remote_type(spark, d, pairs=matched):
    return pairs(spark, d).where(~prefilter.wrong_remote_type(F.col("remote_type"), F.col("remote_pref"))).select("seq", "profile_id")


@query("filter_salary_floor", "SELECT seq, profile_id FROM postings JOIN profiles USING (profile_id) WHERE salary_min IS NULL OR salary_min = 0 OR salary_min >= salary_floor")
def filter_salary_floor(spark, d, pairs=matched):
    return pairs(spark, d).where(~prefilter.below_floor(F.col("salary_min"), F.col("salary_floor"))).select("seq", "profile_id")


@query("filter_title_exclude", "SELECT seq, profile_id, list_filter(string_split(exclude_titles, '|'), lambda x: x <> '' AND regexp_matches(lower(title), concat('\\b', x, '\\b')))[1] AS hit FROM postings JOIN profiles USING (profile_id)")
def filter_title_exclude(spark, d, pairs=matched):
    return pairs(spark, d).select("seq", "profile_id", prefilter.excluded_title(F.col("title"), prefilter.items(F.col("exclude_titles"))).alias("hit"))


_STOP = ", ".join(f"'{w}'" for w in prefilter.TITLE_STOPWORDS)
_WORDS = lambda c: f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[\\s/,\\-]+'), lambda w: trim(w, '().,')), lambda w: len(w) >= 4 AND w NOT IN ({_STOP}))"


@query("title_filter", f"SELECT seq, profile_id FROM postings JOIN profiles USING (profile_id) WHERE job_titles = '' OR title = '' OR list_has_any({_WORDS('title')}, {_WORDS('replace(job_titles, chr(124), chr(32))')}) OR list_bool_or(list_transform(string_split(lower(job_titles), '|'), lambda x: contains(lower(title), x)))")
def title_filter(spark, d, pairs=matched):
    return pairs(spark, d).where(prefilter.title_matches(F.col("title"), prefilter.items(F.col("job_titles")))).select("seq", "profile_id")


@query("select_unscored", f"SELECT p.profile_id, seq FROM postings p WHERE {EFFECTIVE} >= concat('', {NOW} - {RETENTION_DAYS}) AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.profile_id = p.profile_id AND v.job_key = p.seq AND v.manager_score IS NOT NULL)")
def select_unscored(spark, d):
    scored = view(spark, d, "verdicts").where("manager_score is not null").select("profile_id", F.col("job_key").alias("seq"))
    return view(spark, d, "postings").where(effective_date() >= OLDEST).join(scored, ["profile_id", "seq"], "left_anti").select("profile_id", "seq")


@query("compute_scores", f"""SELECT job_key, CAST(least(greatest(round_even(100 + (CASE WHEN mb > 0 THEN CAST(mr AS DOUBLE) / mb * 200 ELSE 100 END - 100) * md, 0), 0), 200) AS INTEGER) AS manager_score,
 CAST(least(greatest(round_even(100 + (CASE WHEN cb > 0 THEN CAST(cr AS DOUBLE) / cb * 200 ELSE 100 END - 100) * least(CAST(n AS DOUBLE) / {IDEAL}, 1.0), 0), 0), 200) AS INTEGER) AS candidate_score,
 CASE WHEN t > 0 THEN CAST(m AS DOUBLE) / t ELSE 1.0 END AS match_score
FROM (SELECT job_key, coalesce(sum(CASE WHEN man AND j AND c THEN p WHEN man AND NOT j THEN 1 END), 0) AS mr, coalesce(sum(p) FILTER (man AND j), 0) AS mb, max(CAST(man AND j AS INT)) AS md, count(*) FILTER (man AND j AND job_importance = 'required') AS t, count(*) FILTER (man AND j AND c AND job_importance = 'required') AS m,
  coalesce(sum(q) FILTER (NOT man AND j AND c), 0) AS cr, coalesce(sum(q) FILTER (NOT man AND c), 0) AS cb, count(*) FILTER (NOT man) AS n
 FROM (SELECT *, trim(lower(category)) IN ('skill', 'experience', 'domain') AS man, job_side IS NOT NULL AND NOT (trim(lower(category)) = 'compensation' AND job_side = 'Salary not disclosed') AS j, candidate_side IS NOT NULL AS c,
   CASE job_importance WHEN 'required' THEN 10 WHEN 'preferred' THEN 6 WHEN 'nice_to_have' THEN 3 ELSE 5 END AS p, CASE candidate_priority WHEN 'must_have' THEN 10 WHEN 'nice_to_have' THEN 5 ELSE 7 END AS q FROM pairs) GROUP BY job_key)""")
def compute_scores(spark, d):
    return scoring.compute_scores(view(spark, d, "pairs"), IDEAL)


_RANK = "row_number() OVER (PARTITION BY profile_id ORDER BY manager_score + candidate_score DESC, manager_score DESC, candidate_score DESC, job_key)"


@query("promote_top_n", f"SELECT profile_id, job_key, CAST(rn AS INTEGER) AS rank FROM (SELECT *, {_RANK} AS rn FROM verdicts WHERE match_score >= {LEAST} AND manager_score IS NOT NULL) WHERE rn <= {TOP} AND status = 'new' AND (NOT hidden OR status_updated IS NULL)")
def promote_top_n(spark, d):
    return scoring.promote_top_n(view(spark, d, "verdicts"), TOP, LEAST)


@query("rebalance_visible", f"""SELECT profile_id, job_key, NOT t AS hidden, CASE WHEN t THEN CAST(rn AS INTEGER) END AS rank, CASE WHEN hidden AND t THEN 'promoted' WHEN NOT hidden AND NOT t THEN 'demoted' ELSE 'same' END AS moved
FROM (SELECT *, fits AND rn <= {TOP} AS t FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, fits ORDER BY manager_score + candidate_score DESC, manager_score DESC, candidate_score DESC, job_key) AS rn
 FROM (SELECT *, match_score >= {LEAST} AS fits FROM verdicts WHERE status = 'new' AND coalesce(saved, false) = false AND manager_score IS NOT NULL AND (match_notes IS NULL OR NOT (starts_with(match_notes, '[Hard') OR starts_with(match_notes, '[Title'))) AND (NOT hidden OR status_updated IS NULL))))""")
def rebalance_visible(spark, d):
    return scoring.rebalance_visible(view(spark, d, "verdicts"), TOP, LEAST)


@query("expire_jobs", f"SELECT seq FROM postings WHERE date_found >= {NOW} - {RETENTION_DAYS} OR seq IN (SELECT job_key FROM verdicts WHERE manager_score IS NULL)")
def expire_jobs(spark, d):
    jobs = view(spark, d, "postings")
    old = jobs.where(F.col("date_found") < F.date_sub(F.lit(AS_OF).cast("date"), RETENTION_DAYS)).select("seq")
    gone = old.join(view(spark, d, "verdicts").where("manager_score is null").select(F.col("job_key").alias("seq")), "seq", "left_anti")
    return jobs.select("seq").join(gone, "seq", "left_anti")


@query("expire_unreferenced_jobs", f"SELECT seq FROM postings WHERE date_found >= {NOW} - {RETENTION_DAYS} OR seq IN (SELECT job_key FROM recorded)")
def expire_unreferenced_jobs(spark, d):
    jobs = view(spark, d, "postings").select(F.col("seq").alias("job_key"), "date_found")
    return lifecycle.expire_jobs(jobs, view(spark, d, "recorded"), F.date_sub(F.lit(AS_OF).cast("date"), RETENTION_DAYS)).select(F.col("job_key").alias("seq"))


@query("purge_stale_verdicts", f"SELECT profile_id, job_key FROM verdicts WHERE NOT ((hidden OR status = 'new') AND NOT coalesce(saved, false) AND NOT {ACTIVE})")
def purge_stale_verdicts(spark, d):
    stale = (F.col("hidden") | (F.col("status") == "new")) & ~F.coalesce("saved", F.lit(False)) & ~F.expr(ACTIVE)
    return view(spark, d, "verdicts").where(~stale).select("profile_id", "job_key")


@query("profile_dashboard", f"SELECT p.profile_id, count(v.job_key) AS total, count(*) FILTER ({ACTIVE}) AS active, count(*) FILTER (status = 'new') AS fresh FROM profiles p LEFT JOIN verdicts v ON v.profile_id = p.profile_id AND NOT hidden GROUP BY 1")
def profile_dashboard(spark, d):
    seen = view(spark, d, "verdicts").where("not hidden").groupBy("profile_id").agg(F.count("*").alias("total"), F.count_if(F.expr(ACTIVE)).alias("active"), F.count_if(F.col("status") == "new").alias("fresh"))
    return view(spark, d, "profiles").select("profile_id").join(seen, "profile_id", "left").na.fill(0)


@query("stage_counts", f"SELECT profile_id, status, count(*) AS n, count(*) FILTER (saved) AS n_saved FROM verdicts WHERE NOT hidden AND {SHOWN} GROUP BY ALL")
def stage_counts(spark, d):
    return view(spark, d, "verdicts").where(~F.col("hidden") & F.expr(SHOWN)).groupBy("profile_id", "status").agg(F.count("*").alias("n"), F.count_if("saved").alias("n_saved"))


@query("list_matches", f"SELECT profile_id, job_key, title, company, status, manager_score FROM verdicts v JOIN (SELECT * EXCLUDE (profile_id) FROM postings) p ON p.seq = v.job_key WHERE NOT hidden AND {SHOWN} AND ({EFFECTIVE} >= concat('', {NOW} - {RETENTION_DAYS}) OR status NOT IN ('new', 'missing_info') OR coalesce(saved, false))")
def list_matches(spark, d):
    jobs = view(spark, d, "postings").select(F.col("seq").alias("job_key"), "title", "company", effective_date().alias("eff"))
    kept = view(spark, d, "verdicts").where(~F.col("hidden") & F.expr(SHOWN))
    return kept.join(jobs, "job_key").where((F.col("eff") >= OLDEST) | ~F.col("status").isin("new", "missing_info") | F.coalesce("saved", F.lit(False))).select("profile_id", "job_key", "title", "company", "status", "manager_score")


@query("list_hidden", "SELECT profile_id, job_key, title FROM verdicts v JOIN (SELECT seq, title FROM postings) p ON p.seq = v.job_key WHERE hidden AND manager_score IS NOT NULL")
def list_hidden(spark, d):
    return view(spark, d, "verdicts").where("hidden and manager_score is not null").join(view(spark, d, "postings").select(F.col("seq").alias("job_key"), "title"), "job_key").select("profile_id", "job_key", "title")


@query("search_jobs", f"SELECT seq, title, company FROM postings WHERE (contains(lower(title), 'engineer') OR contains(lower(company), 'engineer')) AND remote_type = 'remote' AND salary_min IS NOT NULL AND date_posted >= concat('', {NOW} - 20) AND date_posted < '3' ORDER BY date_posted DESC, seq LIMIT 50 OFFSET 50")
def search_jobs(spark, d):
    found = view(spark, d, "postings").where((F.contains(F.lower("title"), F.lit("engineer")) | F.contains(F.lower("company"), F.lit("engineer"))) & (F.col("remote_type") == "remote") & F.col("salary_min").isNotNull())
    dated = found.where(F.col("date_posted").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("date_posted") >= F.date_sub(F.lit(AS_OF).cast("date"), 20).cast("string")))
    return dated.orderBy(F.desc("date_posted"), "seq").offset(50).limit(50).select("seq", "title", "company")


@query("source_facets", "SELECT source, remote_type, count(*) AS n FROM postings GROUP BY ALL")
def source_facets(spark, d):
    return view(spark, d, "postings").groupBy("source", "remote_type").agg(F.count("*").alias("n"))


@query("profile_stats", "SELECT v.profile_id, source, status, count(*) AS n FROM verdicts v JOIN postings p ON p.seq = v.job_key WHERE NOT hidden GROUP BY ALL")
def profile_stats(spark, d):
    return view(spark, d, "verdicts").where("not hidden").join(view(spark, d, "postings").select(F.col("seq").alias("job_key"), "source"), "job_key").groupBy("profile_id", "source", "status").agg(F.count("*").alias("n"))


@query("recent_runs", "SELECT profile_id, run_id, jobs_added FROM runs QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY hours_ago, run_id DESC) <= 10")
def recent_runs(spark, d):
    w = scoring.Window.partitionBy("profile_id").orderBy("hours_ago", F.desc("run_id"))
    return view(spark, d, "runs").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("profile_id", "run_id", "jobs_added")


@query("search_mode", "SELECT profile_id, CASE WHEN h > 720 THEN 'full' ELSE 'incremental' END AS mode, CAST(CASE WHEN h > 720 THEN 720 ELSE least(h + 24, 720) END AS BIGINT) AS hours FROM (SELECT profile_id, min(hours_ago) FILTER (status = 'success') AS h FROM runs GROUP BY 1)")
def search_mode(spark, d):
    last = view(spark, d, "runs").groupBy("profile_id").agg(F.min(F.when(F.col("status") == "success", F.col("hours_ago"))).alias("h"))
    full = F.col("h").isNull() | (F.col("h") > 720)
    return last.select("profile_id", F.when(full, "full").otherwise("incremental").alias("mode"), F.when(full, 720).otherwise(F.least(F.col("h") + 24, F.lit(720))).cast("long").alias("hours"))


@query("pre_filter_reasons", """SELECT seq, profile_id, coalesce(CASE WHEN company_exclude <> '' AND list_bool_or(list_transform(string_split(company_exclude, '|'), lambda x: contains(lower(company), x) OR contains(x, lower(company)))) THEN 'company' END,
 CASE WHEN remote_pref NOT IN ('', 'flexible') AND remote_type NOT IN ('unknown', remote_pref) THEN concat('remote: ', remote_type) END, CASE WHEN salary_floor > 0 AND salary_min < salary_floor THEN 'salary' END,
 CASE WHEN exclude_types <> '' AND contains(lower(concat(company, ' ', title)), exclude_types) THEN concat('type: ', exclude_types) END,
 'title: ' || list_filter(string_split(exclude_titles, '|'), lambda x: x <> '' AND regexp_matches(lower(title), concat('\\b', x, '\\b')))[1]) AS reason FROM postings JOIN profiles USING (profile_id)""")
def pre_filter_reasons(spark, d, pairs=matched):
    return pairs(spark, d).select("seq", "profile_id", prefilter.first_reason().alias("reason"))


def unjudged(spark, d) -> DataFrame:
    """Postings within retention beside every profile that has recorded no verdict on them."""
    verdicts = view(spark, d, "recorded").withColumnRenamed("job_key", "seq")
    return prefilter.unjudged_pairs(view(spark, d, "postings").where(effective_date() >= OLDEST), view(spark, d, "profiles"), verdicts)


_UNJUDGED = f"(SELECT * FROM (SELECT * EXCLUDE (profile_id) FROM postings) p CROSS JOIN profiles r WHERE {EFFECTIVE} >= concat('', {NOW} - {RETENTION_DAYS}) AND NOT EXISTS (SELECT 1 FROM recorded v WHERE v.profile_id = r.profile_id AND v.job_key = p.seq))"


@query("select_unscored_all", f"SELECT profile_id, seq FROM {_UNJUDGED}")
def select_unscored_all(spark, d):
    return unjudged(spark, d).select("profile_id", "seq")


# The rules over every unjudged pair, beside the same rules over each posting and the profile that fetched it.
for _rule in (filter_company_exclude, filter_remote_type, filter_salary_floor, filter_title_exclude, title_filter, pre_filter_reasons):
    _sql = "SELECT seq, " + ORACLES[_rule.__name__].split(") SELECT seq, ", 1)[1]
    query(f"{_rule.__name__}_all", _sql.replace("postings JOIN profiles USING (profile_id)", _UNJUDGED))(partial(_rule, pairs=unjudged))
