"""Registered queries over every posting and every profile, by (profile_id, job_key): requirements, scores and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pay
from ..functions.clearance import requires_clearance
from ..operators import country, descriptions, lifecycle, location, prefilter, scoring
from ..sources.folders import shared_folder
from ..streaming import actions as action_stream
from .fixtures import derive, view
from .places import _TABLE
from .queries import LEAST, TOP, _STOP, query
from .texts import PLACED, READ_LOW, seekers

PAIRS = "(SELECT * FROM (SELECT * EXCLUDE (profile_id) FROM described) CROSS JOIN seekers)"
_names = lambda of: "[" + ", ".join(f"'{x}'" for x in of) + "]"
_OWN = "MAP {" + ", ".join(f"'{c}': {_names(t)}" for c, t in country.OWN.items()) + "}"
_HOME = "MAP {" + ", ".join(f"'{c}': '{country._home(c)}'" for f in country.FAMILIES for c in f) + "}"
_NAMED = ", ".join(f"CASE WHEN regexp_matches(place, '(^|[^a-z])({'|'.join(n)})([^a-z]|$)') THEN '{c}' END" for c, n in country.REGISTRY.items())
_CONFLICT = f"lambda c: NOT list_bool_or(list_transform(coalesce({_OWN}[c], [c]), lambda t: contains(place, t))) AND list_bool_or(list_transform(found, lambda k: k IS NOT NULL AND k <> coalesce({_HOME}[c], c)))"
ABROAD = f"(SELECT seq, profile_id, countries <> '' AND place <> '' AND place NOT IN ('remote', 'anywhere', 'worldwide', 'global') AND list_bool_and(list_transform(string_split(lower(countries), '|'), {_CONFLICT})) AS abroad FROM (SELECT *, [{_NAMED}] AS found FROM (SELECT *, lower(coalesce(location, '')) AS place FROM {PAIRS})))"


def pairs_of(spark, d) -> DataFrame:
    """Every posting, read once, beside every profile; the profiles are eight."""
    read = prefilter.read_postings(view(spark, d, "described").drop("profile_id")).withColumns({"needs_clearance": requires_clearance("title", "description"), "pay": pay.pay_candidates("description")})
    return read.crossJoin(F.broadcast(prefilter.read_profiles(seekers(spark, d))))


@query("filter_country", f"SELECT seq, profile_id FROM {ABROAD} WHERE NOT abroad")
def filter_country(spark, d):
    """Each posting's place is read once and stays where it is; the profiles are eight."""
    read = view(spark, d, "described").select("seq", country.place_read(F.col("location")).alias("place"))
    pairs = read.crossJoin(F.broadcast(seekers(spark, d).select("profile_id", country.wishes_read(F.col("countries")).alias("wishes"))))
    return pairs.where(~country.conflicts(F.col("place"), F.col("wishes"))).select("seq", "profile_id")


_hit = lambda names, text: f"list_filter(string_split(lower({names}), '|'), lambda x: x <> '' AND contains({text}, x))[1]"
_START = "left(coalesce(description, ''), 300)"
_ANY = f"list_bool_or(list_transform(string_split(lower(areas), '|'), lambda a: list_bool_or(list_transform([a, coalesce({_TABLE}[a], CASE a WHEN 'dc' THEN 'washington d.c.' ELSE a END)], lambda f: list_contains(regexp_split_to_array(p, '[\\s,]+'), f) OR (len(f) >= 4 AND (contains(p, f) OR list_bool_or(list_transform(string_split(p, ','), lambda x: len(trim(x)) >= 4 AND contains(f, trim(x))))))))))"
_FAR = f"areas <> '' AND coalesce(remote_type, '') <> 'remote' AND p <> '' AND p NOT IN ('remote', 'anywhere') AND NOT {_ANY}"
_MONEY = lambda c: f"format('{{:,}}', CAST({c} AS BIGINT))"
_LOW = f"coalesce(salary_min, {READ_LOW})"
REASON = f"""coalesce(
 CASE WHEN company_exclude <> '' AND list_bool_or(list_transform(string_split(company_exclude, '|'), lambda x: contains(lower(coalesce(company, '')), x) OR contains(x, lower(coalesce(company, ''))))) THEN concat('Company ''', coalesce(company, ''), ''' is on the exclude list') END,
 CASE WHEN seq % 16 = 13 AND NOT has_clearance THEN 'Job requires federal security clearance but candidate has none' END,
 CASE WHEN hard_remote NOT IN ('', 'flexible') AND coalesce(remote_type, 'unknown') NOT IN ('unknown', lower(hard_remote)) THEN concat('Remote type ''', remote_type, ''' does not match required ''', lower(hard_remote), '''') END,
 CASE WHEN hard_salary_min > 0 AND {_LOW} < hard_salary_min THEN concat('Salary $', {_MONEY(_LOW)}, ' is below required minimum $', {_MONEY("hard_salary_min")}) END,
 'Industry exclusion matched: ''' || {_hit("exclude_industries", f"lower(concat(coalesce(company, ''), ' ', {_START}))")} || '''',
 'Company type exclusion matched: ''' || {_hit("exclude_company_types", f"lower(concat(coalesce(company, ''), ' ', coalesce(title, ''), ' ', {_START}))")} || '''',
 'Title exclusion matched: ''' || list_filter(string_split(exclude_titles, '|'), lambda x: x <> '' AND regexp_matches(lower(coalesce(title, '')), concat('\\b', x, '\\b')))[1] || '''',
 CASE WHEN abroad THEN concat('Location ''', location, ''' is outside required country') END,
 CASE WHEN {_FAR} THEN concat('Job in ''', location, ''' is outside allowed locations and does not offer remote') END)"""
_SIGNIFICANT = lambda c: f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[\\s/,\\-]+'), lambda w: trim(w, '().,')), lambda w: len(w) >= 4 AND w NOT IN ({_STOP}))"
TITLE_OK = f"(job_titles = '' OR coalesce(title, '') = '' OR list_has_any({_SIGNIFICANT('title')}, {_SIGNIFICANT('replace(job_titles, chr(124), chr(32))')}) OR list_bool_or(list_transform(string_split(lower(job_titles), '|'), lambda x: contains(lower(title), x))))"
JUDGED = f"(SELECT *, {REASON} AS reason, {TITLE_OK} AS title_ok FROM (SELECT *, lower(trim(coalesce(location, ''))) AS p FROM {PAIRS}) JOIN {ABROAD} USING (seq, profile_id))"


@query("filter_company_type", f"SELECT seq, profile_id, {_hit('exclude_company_types', 'lower(concat(coalesce(company, chr(32)), chr(32), coalesce(title, chr(32)), chr(32), ' + _START + '))')} AS hit FROM {PAIRS}")
def filter_company_type(spark, d):
    pairs = view(spark, d, "described").select("seq", "company", "title", "description").crossJoin(F.broadcast(seekers(spark, d).select("profile_id", "exclude_company_types")))
    text = F.concat_ws(" ", F.coalesce("company", F.lit("")), F.coalesce("title", F.lit("")), F.substring(F.coalesce("description", F.lit("")), 1, prefilter.SNIPPET))
    return pairs.select("seq", "profile_id", prefilter.first_contained(text, F.transform("exclude_company_types", F.lower)).alias("hit"))


@query("pre_filter", f"SELECT seq, profile_id, reason, title_ok FROM {JUDGED}")
def pre_filter(spark, d):
    return prefilter.judge(pairs_of(spark, d)).select("seq", "profile_id", "reason", "title_ok")


@query("pre_filter_verdicts", f"SELECT seq, profile_id, true AS hidden, 0.0 AS match_score, CASE WHEN reason IS NOT NULL THEN concat('[Hard filter] ', reason) ELSE concat('[Title filter] Title ''', title, ''' contains no target-role keywords') END AS match_notes FROM {JUDGED} WHERE reason IS NOT NULL OR NOT title_ok")
def pre_filter_verdicts(spark, d):
    return prefilter.filter_verdicts(prefilter.judge(pairs_of(spark, d)))


_OUT = "CASE WHEN reason IS NOT NULL AND (status <> 'new' OR coalesce(saved, false)) THEN 'skipped' WHEN reason IS NOT NULL AND was AND hidden THEN 'already_filtered' WHEN reason IS NOT NULL THEN 'updated' WHEN was THEN 'deleted' ELSE 'kept' END"
REFILTERED = f"(SELECT *, {_OUT} AS outcome FROM (SELECT v.*, j.reason, coalesce(starts_with(match_notes, '[Hard filter] '), false) AS was FROM shared_verdicts v JOIN (SELECT profile_id, seq AS job_key, reason FROM {JUDGED}) j USING (profile_id, job_key)))"


def refiltered(spark, d) -> DataFrame:
    judged = prefilter.judge(pairs_of(spark, d)).select("profile_id", F.col("seq").alias("job_key"), "reason")
    return lifecycle.refilter(view(spark, d, "shared_verdicts"), judged)


@query("refilter_next", f"SELECT profile_id, job_key, outcome, CASE outcome WHEN 'updated' THEN true ELSE hidden END AS hidden, CASE outcome WHEN 'updated' THEN concat('[Hard filter] ', reason) ELSE match_notes END AS match_notes, CASE outcome WHEN 'updated' THEN NULL ELSE manager_score END AS manager_score, CASE outcome WHEN 'updated' THEN 0.0 ELSE match_score END AS match_score FROM {REFILTERED} WHERE outcome <> 'deleted'")
def refilter_next(spark, d):
    """The verdicts that re-filtering leaves."""
    return lifecycle.refiltered_state(refiltered(spark, d)).select("profile_id", "job_key", "outcome", "hidden", "match_notes", "manager_score", "match_score")


_LIST = lambda c: f"list_filter(string_split({c}, '|'), lambda x: x <> '')"
_SPEAKS = lambda of: f"list_bool_or(list_transform({_names(of)}, lambda w: contains(lower(must_haves), w)))"
PREFERENCES = f"SELECT profile_id, CAST(greatest(1, len({_LIST('must_haves')}) + len({_LIST('nice_to_haves')}) + CAST(pay_wish <> 0 AND NOT {_SPEAKS(scoring.PAY_WORDS)} AS INT) + CAST(work_style NOT IN ('', 'flexible', 'unknown') AND NOT {_SPEAKS(scoring.PLACE_WORDS)} AS INT) + CAST(work_style <> 'remote' AND (areas <> '' OR list_bool_or(list_transform(string_split(preferred_locations, '|'), lambda x: x <> '' AND lower(x) <> 'remote'))) AS INT)) AS INTEGER) AS n FROM seekers"


@query("count_candidate_preferences", PREFERENCES)
def count_candidate_preferences(spark, d):
    p = F.struct("must_haves", "nice_to_haves", F.col("pay_wish").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"), "work_style", "preferred_locations", F.col("areas").alias("hard_locations"))
    return seekers(spark, d).select("profile_id", scoring.count_preferences(p).alias("n"))


_CLOSED = "regexp_matches(lower(job_side), '(^|[^a-z])(not\\s+disclosed|not\\s+stated|n/?a|confidential|tbd)([^a-z]|$)')"
SCORES = f"""SELECT profile_id, job_key, CAST(least(greatest(round_even(100 + (CASE WHEN mb > 0 THEN CAST(mr AS DOUBLE) / mb * 200 ELSE 100 END - 100) * md, 0), 0), 200) AS INTEGER) AS manager_score,
 CAST(least(greatest(round_even(100 + (CASE WHEN cb > 0 THEN CAST(cr AS DOUBLE) / cb * 200 ELSE 100 END - 100) * least(CAST(k AS DOUBLE) / ideal, 1.0), 0), 0), 200) AS INTEGER) AS candidate_score, CASE WHEN t > 0 THEN CAST(m AS DOUBLE) / t ELSE 1.0 END AS match_score
FROM (SELECT profile_id, job_key, max(x.n) AS ideal, coalesce(sum(CASE WHEN man AND j AND c THEN p WHEN man AND NOT j THEN 1 END), 0) AS mr, coalesce(sum(p) FILTER (man AND j), 0) AS mb, coalesce(max(CAST(man AND j AS INT)), 0) AS md, count(*) FILTER (man AND j AND job_importance = 'required') AS t, count(*) FILTER (man AND j AND c AND job_importance = 'required') AS m,
  coalesce(sum(q) FILTER (own AND j AND c), 0) AS cr, coalesce(sum(q) FILTER (own AND c), 0) AS cb, count(*) FILTER (own) AS k
 FROM (SELECT *, coalesce(kind IN ('skill', 'experience', 'domain'), false) AS man, coalesce(kind IN ('compensation', 'equity', 'benefits', 'work_arrangement', 'culture_growth'), false) AS own, coalesce(job_side, '') <> '' AND NOT (coalesce(kind = 'compensation', false) AND {_CLOSED}) AS j, coalesce(candidate_side, '') <> '' AS c,
   CASE job_importance WHEN 'required' THEN 10 WHEN 'preferred' THEN 6 WHEN 'nice_to_have' THEN 3 ELSE 5 END AS p, CASE candidate_priority WHEN 'must_have' THEN 10 WHEN 'nice_to_have' THEN 5 ELSE 7 END AS q FROM (SELECT *, trim(lower(category)) AS kind FROM own_matches)) JOIN ({PREFERENCES}) x USING (profile_id) GROUP BY ALL)"""


@query("compute_scores_all", SCORES)
def compute_scores_all(spark, d):
    ideal = F.broadcast(count_candidate_preferences(spark, d).withColumnRenamed("n", "ideal"))
    return scoring.compute_scores(view(spark, d, "own_matches").join(ideal, "profile_id"), F.col("ideal"))


_ORDER = "manager_score + coalesce(candidate_score, 0) DESC, manager_score DESC, coalesce(candidate_score, 0) DESC, job_key"
SHOWN_AFTER = lambda state: f"""(SELECT profile_id, job_key, NOT t AS shown_hidden, CASE WHEN t THEN CAST(rn AS INTEGER) END AS rank FROM (SELECT *, fits AND rn <= {TOP} AS t FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, fits ORDER BY {_ORDER}) AS rn
 FROM (SELECT *, coalesce(match_score, 0) >= {LEAST} AS fits FROM {state} WHERE status = 'new' AND NOT coalesce(saved, false) AND manager_score IS NOT NULL AND NOT coalesce(starts_with(match_notes, '[Hard filter]') OR starts_with(match_notes, '[Title filter]'), false) AND NOT (hidden AND status_updated IS NOT NULL)))))"""  # noqa: E731
_STATUS = ", ".join(f"'{s}'" for s in lifecycle.USER_STATUSES)
FOLDED = f"""(SELECT profile_id, v.job_key, coalesce(s, status) AS status, coalesce(h, hidden) AS hidden, (CAST(coalesce(saved, false) AS INT) + coalesce(k, 0)) % 2 = 1 AS saved, CASE WHEN m > 0 THEN stamp ELSE status_updated END AS status_updated, notes, coalesce(w, 0) > 0 AND (status = 'new' OR coalesce(s, status) = 'new') AS touched, match_notes, manager_score, candidate_score, match_score
FROM shared_verdicts v LEFT JOIN (SELECT profile_id, job_key, arg_max(value, o) FILTER (action = 'status') AS s, arg_max(action = 'hide', o) FILTER (action IN ('hide', 'promote')) AS h, count(*) FILTER (action = 'save') AS k, count(*) FILTER (action IN ('status', 'hide', 'promote')) AS m,
  nullif(arg_max(CASE WHEN action = 'promote' THEN DATE '1900-01-01' ELSE CAST(ts AS DATE) END, o) FILTER (action IN ('status', 'hide', 'promote')), DATE '1900-01-01') AS stamp, arg_max(value, o) FILTER (action = 'notes') AS notes, count(*) FILTER (action <> 'notes') AS w
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM own_actions WHERE action <> 'status' OR value IN ({_STATUS})) GROUP BY 1, 2) a USING (profile_id, job_key))"""
AFTER = f"WITH folded AS {FOLDED}, shown AS {SHOWN_AFTER('(SELECT * FROM folded WHERE profile_id IN (SELECT profile_id FROM folded WHERE touched))')} SELECT profile_id, job_key, status, coalesce(shown_hidden, hidden) AS hidden, saved, CAST(CASE WHEN coalesce(shown_hidden, false) THEN NULL ELSE status_updated END AS VARCHAR) AS status_updated, notes FROM folded LEFT JOIN shown USING (profile_id, job_key)"


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status_updated", F.col("status_updated").cast("string"))


@query("after_actions", f"SELECT * FROM ({AFTER})")
def after_actions(spark, d):
    return _dated(lifecycle.after_actions(view(spark, d, "shared_verdicts"), view(spark, d, "own_actions"), TOP, LEAST))


@query("stream_actions", f"SELECT * FROM ({AFTER})")
def stream_actions(spark, d):
    """The state that the stream of the events leaves; it has to equal the batch's."""
    folder, path = shared_folder(spark), f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    action_stream.start_actions(derive(spark, "own_actions", {"events": events}), f"{folder}/changes", f"{folder}/progress").awaitTermination()
    return _dated(action_stream.current(spark, view(spark, d, "shared_verdicts"), f"{folder}/progress", TOP, LEAST))


@query("apply_profile_edits", """SELECT profile_id, 'skills' AS field, array_to_string(list_sort(list(value)), ',') AS value FROM (SELECT profile_id, value, arg_max(action, event_id) AS last FROM edits WHERE field = 'skills' GROUP BY 1, 2) WHERE last = 'add' GROUP BY 1
UNION ALL SELECT profile_id, field, CASE field WHEN 'salary_min' THEN CAST(TRY_CAST(value AS BIGINT) AS VARCHAR) WHEN 'work_style' THEN nullif(value, 'null') ELSE CASE WHEN value = '' THEN NULL WHEN value IN ('yes', 'true') THEN 'true' ELSE 'false' END END FROM (SELECT profile_id, field, arg_max(value, event_id) AS value FROM edits WHERE action = 'set' GROUP BY 1, 2)""")
def apply_profile_edits(spark, d):
    log = view(spark, d, "edits")
    none = log.where("false").select("profile_id", "field", F.array("value").alias("items"))
    lists = lifecycle.apply_list_edits(none, log).where(F.size("items") > 0)
    return lists.select("profile_id", "field", F.array_join(F.sort_array("items"), ",").alias("value")).unionByName(lifecycle.apply_scalar_edits(log))


RECENT = "(SELECT seq AS job_key FROM described WHERE date_found >= DATE '2024-01-31' - 30)"
STATE = f"""(SELECT profile_id, job_key, status, saved, match_notes, hidden, status_updated, CASE WHEN failed THEN NULL WHEN told AND s.manager_score IS NOT NULL THEN s.manager_score ELSE x.manager_score END AS manager_score, CASE WHEN failed THEN NULL WHEN told AND s.manager_score IS NOT NULL THEN s.candidate_score ELSE x.candidate_score END AS candidate_score, CASE WHEN failed THEN NULL WHEN told AND s.manager_score IS NOT NULL THEN s.match_score ELSE x.match_score END AS match_score
FROM (SELECT profile_id, job_key, status, saved, outcome = 'updated' AS failed, CASE WHEN outcome = 'updated' THEN '[Hard filter] ' ELSE match_notes END AS match_notes, NOT coalesce(starts_with(CASE WHEN outcome = 'updated' THEN '[Hard filter] ' ELSE match_notes END, '[Hard') OR starts_with(match_notes, '[Title'), true) AS told, hidden OR outcome = 'updated' OR status = 'new' AS hidden, CASE WHEN status = 'new' AND NOT hidden AND outcome <> 'updated' THEN NULL ELSE status_updated END AS status_updated, manager_score, candidate_score, match_score FROM {REFILTERED} WHERE outcome <> 'deleted') x
LEFT JOIN (SELECT * FROM ({SCORES}) JOIN {RECENT} USING (job_key)) s USING (profile_id, job_key))"""


@query("repromote", f"SELECT * FROM (WITH state AS {STATE}, shown AS {SHOWN_AFTER('state')} SELECT profile_id, job_key, coalesce(shown_hidden, hidden) AS hidden, rank, manager_score, candidate_score, match_score FROM state LEFT JOIN shown USING (profile_id, job_key))")
def repromote(spark, d):
    recent = view(spark, d, "described").where("date_found >= date'2024-01-31' - 30").select(F.col("seq").alias("job_key"))
    return scoring.repromote(view(spark, d, "shared_verdicts"), refiltered(spark, d), compute_scores_all(spark, d), recent, TOP, LEAST)


_SIZED = "(SELECT profile_id, seq AS job_key, turn, CAST(greatest(1, round_even((length(coalesce(description, '')) + length(coalesce(title, ''))) / 3.5, 0)) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY date_found DESC, seq) AS turn FROM described) WHERE turn <= 200)"


@query("token_batches", f"""SELECT profile_id, job_key, tokens, batch FROM (WITH RECURSIVE sized AS {_SIZED}, packed AS (
 SELECT profile_id, job_key, turn, tokens, CAST(0 AS BIGINT) AS batch, 1 AS held, tokens AS total FROM sized WHERE turn = 1
 UNION ALL SELECT s.profile_id, s.job_key, s.turn, s.tokens, p.batch + CAST(p.total + s.tokens > 300 OR p.held >= 6 AS BIGINT), CASE WHEN p.total + s.tokens > 300 OR p.held >= 6 THEN 1 ELSE p.held + 1 END, CASE WHEN p.total + s.tokens > 300 OR p.held >= 6 THEN s.tokens ELSE p.total + s.tokens END
 FROM packed p JOIN sized s ON s.profile_id = p.profile_id AND s.turn = p.turn + 1) SELECT * FROM packed)""")
def token_batches(spark, d):
    """Each profile's 200 newest postings in batches of 300 tokens or six postings at most."""
    queue = lifecycle.score_queue(view(spark, d, "described").withColumnRenamed("seq", "job_key"), 200)
    size = F.char_length(F.coalesce("description", F.lit(""))) + F.char_length(F.coalesce("title", F.lit("")))
    jobs = queue.join(view(spark, d, "described").select(F.col("seq").alias("job_key"), size.alias("n_chars")), "job_key")
    return scoring.token_batches(jobs, 300, 6)


_REFILLED = f"(SELECT v.*, coalesce(status = 'new' AND reason IS NULL AND source = 'greenhouse' AND coalesce(description, '') = '' AND job_key % 43 > 0 AND job_key % 3 <> 1 AND NOT (hidden AND status_updated IS NOT NULL), false) AS started_over, job_key % 3 AS turns FROM verdicts v JOIN {JUDGED} j ON j.seq = v.job_key AND j.profile_id = v.profile_id)"


def refilled(spark, d) -> tuple[DataFrame, DataFrame]:
    """The board's dump tells two thirds of the postings, some of them twice, and ends with an empty text for each."""
    jobs = view(spark, d, "described").withColumn("job_key", F.col("seq")).withColumn("apply_url", F.when(F.col("seq") % 43 > 0, F.concat(F.lit("https://jobs/"), "seq")))
    turns = jobs.where("seq % 3 <> 1").select("seq", "apply_url", F.explode(F.sequence(F.lit(1), F.col("seq") % 3 + 2)).alias("turn"))
    dump = turns.withColumns({"description": F.when(F.col("turn") < F.col("seq") % 3 + 2, F.concat(F.lit("text "), "seq", F.lit(" "), "turn")).otherwise(""), "raw_data": F.concat(F.lit("{"), "turn", F.lit("}"))})
    return descriptions.backfill(view(spark, d, "verdicts"), jobs, seekers(spark, d), dump, ["greenhouse"])


@query("backfill_judged", f"SELECT profile_id, job_key, status, started_over, CASE WHEN started_over THEN false ELSE hidden END AS hidden, CASE WHEN NOT started_over THEN manager_score END AS manager_score, CASE WHEN NOT started_over THEN candidate_score END AS candidate_score, CASE WHEN NOT started_over THEN match_notes END AS match_notes, CASE WHEN started_over THEN 0.0 ELSE match_score END AS match_score FROM {_REFILLED}")
def backfill_judged(spark, d):
    """Every verdict after a backfill that judges by all nine rules."""
    return refilled(spark, d)[1].select("profile_id", "job_key", "status", "started_over", "hidden", "manager_score", "candidate_score", "match_notes", "match_score")


@query("backfill_texts", f"SELECT DISTINCT job_key, concat('text ', job_key, ' ', job_key % 3 + 1) AS description, concat('{{', job_key % 3 + 1, '}}') AS raw_data FROM verdicts v JOIN {JUDGED} j ON j.seq = v.job_key AND j.profile_id = v.profile_id WHERE status = 'new' AND reason IS NULL AND source = 'greenhouse' AND coalesce(description, '') = '' AND job_key % 43 > 0 AND job_key % 3 <> 1")
def backfill_texts(spark, d):
    return refilled(spark, d)[0]
