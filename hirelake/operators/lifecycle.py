"""Verdicts over time: re-filtering, user actions, clearing, and what is stored after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scoring

#: Statuses that a user may set.
USER_STATUSES = "new applied phone_screen interview_1 interview_2 interview_3 offer rejected withdrawn".split()
HARD = "[Hard filter] "


def refilter(verdicts: DataFrame, reasons: DataFrame) -> DataFrame:
    """Verdicts (profile_id, job_key, status, saved, hidden, match_notes) with outcome, beside the reason (null: passes)
    of the hard requirements now.

    skipped: fails but is saved or has a status; already_filtered: fails and is hidden as such; updated: fails now;
    deleted: passes and was filtered; kept: passes.
    """
    was = F.coalesce(F.startswith("match_notes", F.lit(HARD)), F.lit(False))
    fails = F.col("reason").isNotNull()
    outcome = (
        F.when(fails & ((F.col("status") != "new") | F.coalesce("saved", F.lit(False))), "skipped")
        .when(fails & was & F.col("hidden"), "already_filtered")
        .when(fails, "updated")
        .when(was, "deleted")
        .otherwise("kept")
    )
    return verdicts.join(reasons.select("profile_id", "job_key", "reason"), ["profile_id", "job_key"]).withColumn("outcome", outcome)


def refiltered_state(found: DataFrame) -> DataFrame:
    """The verdicts that refilter's result leaves: those that fail now are hidden with their reason and without scores,
    those that pass and were filtered are gone, to be judged anew."""
    now = F.col("outcome") == "updated"
    values = {"hidden": F.when(now, True).otherwise(F.col("hidden")), "match_notes": F.when(now, F.concat(F.lit(HARD), "reason")).otherwise(F.col("match_notes")), "match_score": F.when(now, 0.0).otherwise(F.col("match_score"))}
    values |= {c: F.when(~now, F.col(c)) for c in ("manager_score", "candidate_score") if c in found.columns}
    return found.where("outcome <> 'deleted'").withColumns(values)


def record_verdicts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with the rows of fresh whose (profile_id, job_key) it lacks; of equal keys in fresh the least row."""
    key = ["profile_id", "job_key"]
    rest = [c for c in stored.columns if c not in key]
    new = fresh.select(stored.columns).join(stored.select(key), key, "left_anti")
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*")
    return stored.unionByName(one)


def valid_actions(actions: DataFrame) -> DataFrame:
    """The actions without those that set a status which users can't set."""
    return actions.where((F.col("action") != "status") | F.coalesce(F.col("value").isin(USER_STATUSES), F.lit(False)))


def fold_actions(actions: DataFrame) -> DataFrame:
    """What a log of actions says of each key: the last word of each field by event time and id, and counts."""
    keys = [k for k in ("profile_id", "job_key") if k in actions.columns]
    done, at = F.col("action"), F.struct("ts", "event_id")

    def last(value: Column, *kinds: str) -> Column:
        return F.max(F.when(done.isin(*kinds), F.struct(at.alias("at"), value.alias("v"))))["v"]

    return valid_actions(actions).groupBy(*keys).agg(
        last(F.col("value"), "status").alias("_status"),
        last(F.when(done == "hide", True).otherwise(False), "hide", "promote").alias("_hidden"),
        last(F.when(done != "promote", F.to_date("ts")), "status", "hide", "promote").alias("_stamp"),
        F.count_if(done.isin("status", "hide", "promote")).alias("_stamps"),
        F.count_if(done == "save").alias("_saves"),
        last(F.col("value"), "notes").alias("_notes"),
        F.count_if(done != "notes").alias("_moves"),
    )


def with_folds(verdicts: DataFrame, folds: DataFrame) -> DataFrame:
    """Verdicts after what fold_actions or the stream's state says of them, with notes and touched."""
    keys = [k for k in ("profile_id", "job_key") if k in folds.columns]
    status = F.coalesce("_status", "status")
    notes = F.coalesce("_notes", "notes") if "notes" in verdicts.columns else F.col("_notes")
    return verdicts.join(folds, keys, "left").select(
        "profile_id",
        "job_key",
        status.alias("status"),
        F.coalesce("_hidden", "hidden").alias("hidden"),
        (F.coalesce("saved", F.lit(False)).cast("int") + F.coalesce("_saves", F.lit(0)) % 2 == 1).alias("saved"),
        F.when(F.col("_stamps") > 0, F.col("_stamp")).otherwise(F.col("status_updated")).alias("status_updated"),
        notes.alias("notes"),
        ((F.coalesce("_moves", F.lit(0)) > 0) & ((F.col("status") == "new") | (status == "new"))).alias("touched"),
    )


def apply_user_actions(verdicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Verdicts after a batch of actions (profile_id, job_key, event_id, ts, action, value), with notes and touched.

    status sets a valid status and the stamp, save toggles, hide hides and stamps, promote shows and clears the stamp,
    notes overwrite. Each field depends on its last action alone, so the batch pre-aggregates before the shuffle.
    touched: an action fell on a row that was or becomes new, whose profile then needs a rebalance.
    An action is one profile's; only a log without profile_id speaks of a job for all of them.
    """
    return with_folds(verdicts, fold_actions(actions))


def rebalanced(folded: DataFrame, verdicts: DataFrame, top_n: int, least: float) -> DataFrame:
    """folded verdicts with one rebalance of what is shown for each profile that an action touched; verdicts also hold
    scores and notes of the match."""
    key = ["profile_id", "job_key"]
    touched = folded.where("touched").select("profile_id").distinct()
    state = folded.join(verdicts.select(*key, "match_notes", "manager_score", "candidate_score", "match_score"), key)
    shown = scoring.rebalance_visible(state.join(touched, "profile_id", "left_semi"), top_n, least)
    moved = shown.select(*key, F.col("hidden").alias("_hidden"))
    out = folded.join(moved, key, "left")
    stamp = F.when(F.coalesce("_hidden", F.lit(False)), F.lit(None)).otherwise(F.col("status_updated"))
    return out.select(*key, "status", F.coalesce("_hidden", "hidden").alias("hidden"), "saved", stamp.alias("status_updated"), "notes")


def after_actions(verdicts: DataFrame, actions: DataFrame, top_n: int, least: float) -> DataFrame:
    """profile_id, job_key, status, hidden, saved, status_updated, notes after a batch of actions and, for each profile
    that it touched, one rebalance of what is shown."""
    return rebalanced(apply_user_actions(verdicts, actions), verdicts, top_n, least)


#: Profile fields that hold whole numbers, and truth values; texts that stand for yes.
NUMBER_FIELDS, TRUTH_FIELDS, YES = ["salary_min", "salary_max", "years_experience_total", "years_experience_primary"], ["has_clearance"], ["true", "True", "yes", "1"]


def apply_list_edits(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """(profile_id, field, items) of list fields after the edits (profile_id, event_id, field, action, value) in order:
    add appends what is not there, remove takes all equal items out. profiles has the items before (null: none)."""
    ordered = edits.where(F.col("action").isin("add", "remove")).groupBy("profile_id", "field").agg(F.sort_array(F.collect_list(F.struct("event_id", "action", "value"))).alias("_log"))
    none = F.array().cast("array<string>")

    def step(items: Column, e: Column) -> Column:
        without = F.filter(items, lambda x: x != e["value"])
        return F.when(e["action"] == "remove", without).when(F.array_contains(items, e["value"]), items).otherwise(F.concat(items, F.array(e["value"])))

    both = profiles.select("profile_id", "field", "items").join(ordered, ["profile_id", "field"], "full")
    return both.select("profile_id", "field", F.aggregate(F.coalesce("_log", F.array().cast("array<struct<event_id:bigint,action:string,value:string>>")), F.coalesce("items", none), step).alias("items"))


def apply_scalar_edits(edits: DataFrame) -> DataFrame:
    """(profile_id, field, value) that the last set of each field leaves: numbers where the field holds numbers (else
    null), true or false where it holds truth values, and null for the text null."""
    last = edits.where("action = 'set'").groupBy("profile_id", "field").agg(F.max_by("value", "event_id").alias("value"))
    name, empty = F.substring_index("field", ".", -1), F.coalesce("value", F.lit("null")).isin("", "null")
    number = F.try_to_number(F.col("value"), F.lit("S9999999999")).cast("long").cast("string")
    value = (
        F.when(name.isin(NUMBER_FIELDS), F.when(~empty, number))
        .when(name.isin(TRUTH_FIELDS), F.when(~empty, F.col("value").isin(YES).cast("string")))
        .otherwise(F.when(F.col("value") != "null", F.col("value")))
    )
    return last.select("profile_id", "field", value.alias("value"))


def clear_profile(jobs: DataFrame, verdicts: DataFrame, profile_id: int) -> DataFrame:
    """Jobs (job_key) that a verdict of another profile refers to; the others go with the profile."""
    left = verdicts.where(F.col("profile_id") != profile_id).select("job_key").distinct()
    return jobs.join(left, "job_key", "left_semi")


def merged_list(old: Column, new: Column) -> Column:
    """old, then the items of new that it lacks whatever their case."""
    old, low = F.coalesce(old, F.array().cast("array<string>")), F.transform(F.coalesce(old, F.array().cast("array<string>")), F.lower)
    return F.concat(old, F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: ~F.array_contains(low, F.lower(x))))


def merged_value(old: Column, new: Column) -> Column:
    """old unless it is null or empty and new is known."""
    return F.when(F.coalesce(old, F.lit("")) == "", F.coalesce(new, old)).otherwise(old)


#: Fields of a profile that a merge leaves alone.
UNMERGED = ["profile_name", "generated_at"]


def merged_struct(old: Column, new: Column, kind: T.StructType) -> tuple[Column, Column]:
    """(merged, additions) of two profile structs of the type kind: lists take the items they lack, empty fields are
    filled, structs are merged field by field; additions counts the items and fields taken over."""
    fields, added = [], F.lit(0)
    for f in kind.fields:
        mine, theirs = old[f.name], new[f.name]
        if f.name in UNMERGED:
            value, n = mine, F.lit(0)
        elif isinstance(f.dataType, T.StructType):
            value, n = merged_struct(mine, theirs, f.dataType)
        elif isinstance(f.dataType, T.ArrayType):
            value = merged_list(mine, theirs)
            n = F.size(value) - F.coalesce(F.array_size(mine), F.lit(0))
        else:
            empty = F.coalesce(mine.cast("string"), F.lit("")) == ""
            value, n = F.when(empty, F.coalesce(theirs, mine)).otherwise(mine), (empty & theirs.isNotNull()).cast("int")
        fields.append(value.alias(f.name))
        added = added + n
    return F.struct(*fields), added


def score_queue(candidates: DataFrame, limit: int) -> DataFrame:
    """Each profile's newest candidates, limit at most: (profile_id, job_key, turn).

    The date is the first ten characters of date_posted if they are cut by hyphens like a date, else the day found.
    """
    posted = F.col("date_posted")
    shaped = (F.char_length(posted) >= 10) & (F.substring(posted, 5, 1) == "-") & (F.substring(posted, 8, 1) == "-")
    dated = candidates.withColumn("_day", F.when(shaped, F.substring(posted, 1, 10)).otherwise(F.col("date_found").cast("string")))
    order = Window.partitionBy("profile_id").orderBy(F.desc("_day"), "job_key")
    return dated.select("profile_id", "job_key", F.row_number().over(order).alias("turn")).where(F.col("turn") <= limit)


PAIR = "struct<category:string,job_side:string,candidate_side:string,job_importance:string,candidate_priority:string>"


def parse_match_responses(responses: DataFrame, keep: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """One row for each pair in model outputs (batch_id, response): an array of objects with a job_key and pairs, bare or
    in a code fence at the start. Anything else gives no rows. keep names columns of responses to carry, such as the
    profile's and the batch's id; with empty, a job without pairs gives one row of nulls."""
    text = F.btrim("response", F.lit(" \n"))
    body = F.when(F.startswith(text, F.lit("```")), F.regexp_extract(text, r"(?s)^```[a-z]*\s*(.*?)```", 1)).otherwise(text)
    jobs = responses.where(F.startswith(F.btrim(body, F.lit(" \n")), F.lit("["))).select(*keep, F.explode(F.from_json(body, f"array<struct<job_key:bigint,match_pairs:array<{PAIR}>,total_job_requirements:int>>")).alias("j"))
    kept = jobs.where("j.job_key is not null")
    total = F.when(F.col("j.total_job_requirements") > 0, F.col("j.total_job_requirements"))
    pairs = (F.inline_outer if empty else F.inline)("j.match_pairs")
    return kept.select(*keep, F.col("j.job_key").alias("job_key"), total.alias("total_job_requirements"), pairs)


def expire_jobs(jobs: DataFrame, verdicts: DataFrame, oldest: Column) -> DataFrame:
    """jobs (job_key, date_found) without those found before oldest that no verdict, scored or not, refers to."""
    gone = jobs.where(F.col("date_found") < oldest).select("job_key").join(verdicts.select("job_key"), "job_key", "left_anti")
    return jobs.join(gone, "job_key", "left_anti")
