"""Registered queries of verdicts over time, and of the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, lifecycle, prefilter, scoring
from ..streaming import landing
from .fixtures import AS_OF, RETENTION_DAYS, view
from .queries import EFFECTIVE, IDEAL, KEY, NOW, OLDEST, ORACLES, effective_date, query

QUEUE, GONE = 40, 3
_STATUS = ", ".join(f"'{s}'" for s in lifecycle.USER_STATUSES)
_UNFILTERED = "NOT (starts_with(match_notes, '[Hard') OR starts_with(match_notes, '[Title'))"
_REASONS = ORACLES["pre_filter_reasons"].split(") SELECT seq, profile_id, coalesce(", 1)[1]


@query("refilter", f"SELECT profile_id, outcome, count(*) AS n FROM (SELECT profile_id, CASE WHEN reason IS NOT NULL AND (status <> 'new' OR coalesce(saved, false)) THEN 'skipped' WHEN reason IS NOT NULL AND coalesce(starts_with(match_notes, '[Hard filter] '), false) AND hidden THEN 'already_filtered' WHEN reason IS NOT NULL THEN 'updated' WHEN coalesce(starts_with(match_notes, '[Hard filter] '), false) THEN 'deleted' ELSE 'kept' END AS outcome FROM verdicts JOIN (SELECT profile_id, seq AS job_key, coalesce({_REASONS}) USING (profile_id, job_key)) GROUP BY ALL")
def refilter(spark, d):
    found = view(spark, d, "postings").join(view(spark, d, "profiles"), "profile_id").select("profile_id", F.col("seq").alias("job_key"), prefilter.first_reason().alias("reason"))
    return lifecycle.refilter(view(spark, d, "verdicts"), found).groupBy("profile_id", "outcome").agg(F.count("*").alias("n"))


@query("record_verdicts", "SELECT profile_id, job_key, match_score FROM verdicts WHERE job_key % 4 > 0 UNION ALL SELECT profile_id, job_key, 0.0 FROM verdicts WHERE job_key % 4 = 0 AND job_key % 2 = 0")
def record_verdicts(spark, d):
    rows = view(spark, d, "verdicts").select("profile_id", "job_key", "match_score")
    fresh = rows.where("job_key % 2 = 0").withColumn("match_score", F.lit(0.0))
    return lifecycle.record_verdicts(rows.where("job_key % 4 > 0"), fresh.unionByName(fresh))


@query("apply_user_actions", f"""SELECT profile_id, v.job_key, coalesce(s, status) AS status, coalesce(h, hidden) AS hidden, (CAST(coalesce(saved, false) AS INT) + coalesce(k, 0)) % 2 = 1 AS saved, CAST(CASE WHEN m > 0 THEN stamp ELSE status_updated END AS VARCHAR) AS status_updated, notes,
 coalesce(w, 0) > 0 AND (status = 'new' OR coalesce(s, status) = 'new') AS touched
FROM verdicts v LEFT JOIN (SELECT job_key, arg_max(value, o) FILTER (action = 'status') AS s, arg_max(action = 'hide', o) FILTER (action IN ('hide', 'promote')) AS h, count(*) FILTER (action = 'save') AS k, count(*) FILTER (action IN ('status', 'hide', 'promote')) AS m,
  nullif(arg_max(CASE WHEN action = 'promote' THEN DATE '1900-01-01' ELSE CAST(ts AS DATE) END, o) FILTER (action IN ('status', 'hide', 'promote')), DATE '1900-01-01') AS stamp, arg_max(value, o) FILTER (action = 'notes') AS notes, count(*) FILTER (action <> 'notes') AS w
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM actions WHERE action <> 'status' OR value IN ({_STATUS})) GROUP BY 1) a USING (job_key)""")
def apply_user_actions(spark, d):
    return lifecycle.apply_user_actions(view(spark, d, "verdicts"), view(spark, d, "actions")).withColumn("status_updated", F.col("status_updated").cast("string"))


@query("clear_profile", f"SELECT seq AS job_key, title FROM postings WHERE seq IN (SELECT job_key FROM verdicts WHERE profile_id <> {GONE})")
def clear_profile(spark, d):
    return lifecycle.clear_profile(view(spark, d, "postings").select(F.col("seq").alias("job_key"), "title"), view(spark, d, "verdicts"), GONE)


@query("merge_profiles", "SELECT seq, concat('Sql, spark', CASE WHEN seq % 2 = 0 THEN '' ELSE ', Rust' END) AS skills, CASE WHEN location = '' THEN 'Bonn' ELSE location END AS place FROM postings")
def merge_profiles(spark, d):
    new = F.array(F.lit("SQL"), F.when(F.col("seq") % 2 == 0, "SPARK").otherwise("Rust"))
    return view(spark, d, "postings").select("seq", F.array_join(lifecycle.merged_list(F.array(F.lit("Sql"), F.lit("spark")), new), ", ").alias("skills"), lifecycle.merged_value(F.col("location"), F.lit("Bonn")).alias("place"))


@query("score_queue", f"SELECT profile_id, seq AS job_key, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY CASE WHEN {EFFECTIVE} = date_posted THEN date_posted ELSE concat('', date_found) END DESC, seq) AS INTEGER) AS turn FROM postings QUALIFY turn <= {QUEUE}")
def score_queue(spark, d):
    return lifecycle.score_queue(view(spark, d, "postings").withColumnRenamed("seq", "job_key"), QUEUE)


@query("parse_match_responses", "SELECT job_key, CASE WHEN job_key % 2 = 1 THEN 4 END AS total_job_requirements, category, job_side, candidate_side, job_importance, candidate_priority FROM pairs WHERE job_key % 7 <> 0")
def parse_match_responses(spark, d):
    k = F.col("job_key")
    jobs = view(spark, d, "pairs").groupBy("job_key").agg(F.collect_list(F.struct("category", "job_side", "candidate_side", "job_importance", "candidate_priority")).alias("match_pairs"))
    body = F.to_json(F.array(F.struct("job_key", "match_pairs", F.when(k % 2 == 1, 4).otherwise(0).alias("total_job_requirements"))))
    text = F.when(k % 7 == 0, F.concat(F.lit("Sorry: "), body)).when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return lifecycle.parse_match_responses(jobs.select(k.alias("batch_id"), text.alias("response")))


@query("rescore_from_pairs", f"SELECT profile_id, job_key, s.manager_score, s.candidate_score, s.match_score FROM verdicts v JOIN ({ORACLES['compute_scores']}) s USING (job_key) JOIN (SELECT seq AS job_key, {EFFECTIVE} AS eff FROM postings) p USING (job_key) WHERE match_notes IS NOT NULL AND {_UNFILTERED} AND eff >= concat('', {NOW} - {RETENTION_DAYS})")
def rescore_from_pairs(spark, d):
    recent = view(spark, d, "postings").where(effective_date() >= OLDEST).select(F.col("seq").alias("job_key"))
    kept = view(spark, d, "verdicts").where("match_notes is not null and not (match_notes like '[Hard filter]%' or match_notes like '[Title filter]%')").select("profile_id", "job_key")
    return kept.join(recent, "job_key").join(scoring.compute_scores(view(spark, d, "pairs"), IDEAL), "job_key").select("profile_id", "job_key", "manager_score", "candidate_score", "match_score")


@query("pair_breakdown", "SELECT job_key, kind AS category, count(*) FILTER (j AND c) AS n_match, count(*) FILTER (j AND NOT c) AS n_gap, count(*) FILTER (NOT j) AS n_extra FROM (SELECT job_key, trim(lower(category)) AS kind, job_side IS NOT NULL AS j, candidate_side IS NOT NULL AS c FROM pairs) GROUP BY ALL")
def pair_breakdown(spark, d):
    there = lambda c: F.btrim(F.coalesce(c, F.lit(""))) != ""
    job, own = there(F.col("job_side")), there(F.col("candidate_side"))
    return view(spark, d, "pairs").groupBy("job_key", F.lower(F.btrim("category")).alias("category")).agg(F.count_if(job & own).alias("n_match"), F.count_if(job & ~own).alias("n_gap"), F.count_if(~job).alias("n_extra"))


@query("job_associations", "SELECT job_key, string_agg(concat(profile_id, ': ', CASE WHEN starts_with(match_notes, '[') THEN split_part(match_notes, '] ', 2) WHEN manager_score IS NULL THEN 'unscored' ELSE concat(manager_score, '/', candidate_score) END), '; ' ORDER BY profile_id, status) AS chips FROM verdicts GROUP BY 1")
def job_associations(spark, d):
    scores = F.coalesce(F.concat("manager_score", F.lit("/"), "candidate_score"), F.lit("unscored"))
    chip = F.concat("profile_id", F.lit(": "), F.when(F.startswith("match_notes", F.lit("[")), F.split_part("match_notes", F.lit("] "), F.lit(2))).otherwise(scores))
    rows = view(spark, d, "verdicts").groupBy("job_key").agg(F.sort_array(F.collect_list(F.struct("profile_id", "status", chip.alias("chip")))).alias("r"))
    return rows.select("job_key", F.array_join(F.col("r.chip"), "; ").alias("chips"))


@query("run_audit", f"SELECT profile_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS found, count(DISTINCT {KEY}) AS n_keys FROM postings WHERE title <> '' AND company <> '' GROUP BY 1")
def run_audit(spark, d):
    rows = view(spark, d, "postings").where("title <> '' and company <> ''")
    key = ingest.job_key(F.col("title"), F.col("company"), F.col("location"))
    return rows.groupBy("profile_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("found"), F.countDistinct(key).alias("n_keys"))


@query("stream_ingest", f"SELECT DISTINCT {KEY} AS job_key FROM postings WHERE title <> '' AND company <> '' AND (try_cast(date_posted AS DATE) IS NULL OR try_cast(date_posted AS DATE) >= {NOW} - {RETENTION_DAYS})")
def stream_ingest(spark, d):
    return landing.ingest_orders(spark, d, AS_OF, RETENTION_DAYS).select("job_key")
