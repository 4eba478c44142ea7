"""Two-sided scores from match pairs, and the shortlists built on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a pair by the importance of its job side, or by the candidate's priority.
MANAGER = {"required": 10, "preferred": 6, "nice_to_have": 3}
CANDIDATE = {"must_have": 10, "nice_to_have": 5}
UNKNOWN_IMPORTANCE, EXTRA_SKILL, UNKNOWN_PRIORITY = 5, 1, 7
MANAGER_KINDS = ["skill", "experience", "domain"]
#: Wording of pay that isn't told.
UNDISCLOSED = r"(?i)\b(not\s+disclosed|not\s+stated|not\s+provided|undisclosed|not\s+available|n/?a|salary\s+range\s+not\s+listed|confidential|tbd|to\s+be\s+determined)\b"
#: Words of a must-have that speak of pay, and of the place of work.
PAY_WORDS = ["salary", "pay", "compensation", "comp", "usd", "$", "k/yr", "k/year", "per year", "annual"]
PLACE_WORDS = ["remote", "hybrid", "onsite", "on-site", "in-person", "office", "location", "timezone", "relocat"]
CANDIDATE_KINDS = ["compensation", "equity", "benefits", "work_arrangement", "culture_growth"]


def _weight(level: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, points in weights.items():
        out = F.when(level == name, points).otherwise(out)
    return out


def scale(raw: Column, base: Column, depth: Column) -> Column:
    """0 to 200 around 100, drawn to 100 by a depth under 1; halves round to even."""
    ratio = F.when(base > 0, raw / base * 200).otherwise(100.0)
    return F.least(F.greatest(F.bround(100 + (ratio - 100) * depth, 0), F.lit(0.0)), F.lit(200.0)).cast("int")


def compute_scores(pairs: DataFrame, ideal: int | Column) -> DataFrame:
    """profile_id, job_key, manager_score, candidate_score, match_score; sums alone, so pairs combine before the shuffle.

    Pairs of one job belong to a profile each; only pairs without profile_id are a job's alone.

    ideal is the number of a candidate's preferences: one for all, or a column of the pairs that is the same for a key.
    """
    keys = [k for k in ("profile_id", "job_key") if k in pairs.columns]
    kind = F.lower(F.btrim(F.coalesce("category", F.lit(""))))
    hidden = (kind == "compensation") & F.rlike(F.coalesce("job_side", F.lit("")), F.lit(UNDISCLOSED))
    job = (F.coalesce("job_side", F.lit("")) != "") & ~F.coalesce(hidden, F.lit(False))
    own = F.coalesce("candidate_side", F.lit("")) != ""
    p, q = _weight(F.col("job_importance"), MANAGER, UNKNOWN_IMPORTANCE), _weight(F.col("candidate_priority"), CANDIDATE, UNKNOWN_PRIORITY)
    for_manager, for_candidate, required = kind.isin(MANAGER_KINDS), kind.isin(CANDIDATE_KINDS), F.coalesce(F.col("job_importance") == "required", F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ideal = F.lit(ideal) if isinstance(ideal, int) else ideal
    sums = pairs.groupBy(*keys).agg(
        total(F.when(for_manager, F.when(job & own, p).when(job, 0).otherwise(EXTRA_SKILL))).alias("mraw"),
        total(F.when(for_manager & job, p)).alias("mbase"),
        F.max((for_manager & job).cast("int")).alias("mdepth"),
        F.count_if(for_manager & job & required).alias("needed"),
        F.count_if(for_manager & job & own & required).alias("met"),
        total(F.when(for_candidate & job & own, q)).alias("craw"),
        total(F.when(for_candidate & own, q)).alias("cbase"),
        F.count_if(for_candidate).alias("n"),
        F.max(ideal).alias("ideal"),
    )
    depth = F.when(F.col("ideal") > 0, F.least(F.col("n") / F.col("ideal"), F.lit(1.0))).when(F.col("n") > 0, 1.0).otherwise(0.0)
    return sums.select(
        *keys, scale(F.col("mraw"), F.col("mbase"), F.col("mdepth")).alias("manager_score"), scale(F.col("craw"), F.col("cbase"), depth).alias("candidate_score"), F.when(F.col("needed") > 0, F.col("met") / F.col("needed")).otherwise(1.0).alias("match_score")
    )


def best_first() -> Window:
    """Rank order within a profile."""
    mine = F.coalesce("candidate_score", F.lit(0))
    return Window.partitionBy("profile_id").orderBy(F.desc(F.col("manager_score") + mine), F.desc("manager_score"), F.desc(mine), "job_key")


def promote_top_n(verdicts: DataFrame, top_n: int, least: float) -> DataFrame:
    """profile_id, job_key, rank of what becomes visible: ranked first, then only new rows that no user dismissed."""
    scored = verdicts.where((F.col("match_score") >= least) & F.col("manager_score").isNotNull())
    top = scored.withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= top_n)
    return top.where("status = 'new' and (not hidden or status_updated is null)").select("profile_id", "job_key", "rank")


def rebalance_visible(verdicts: DataFrame, top_n: int, least: float) -> DataFrame:
    """Next state of the pool: profile_id, job_key, hidden, rank (null outside the top), moved (promoted, demoted or same)."""
    pool = verdicts.where("status = 'new' and not coalesce(saved, false) and manager_score is not null and not coalesce(match_notes like '[Hard filter]%' or match_notes like '[Title filter]%', false) and not (hidden and status_updated is not null)")
    slim = pool.select("profile_id", "job_key", "hidden", "manager_score", "candidate_score", (F.coalesce("match_score", F.lit(0.0)) >= least).alias("fits"))
    top = slim.where("fits").withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= top_n).select("profile_id", "job_key", "rank")
    return slim.join(top, ["profile_id", "job_key"], "left").select("profile_id", "job_key", F.col("rank").isNull().alias("hidden"), "rank", F.when(F.col("hidden") & F.col("rank").isNotNull(), "promoted").when(~F.col("hidden") & F.col("rank").isNull(), "demoted").otherwise("same").alias("moved"))


def rebalanced_state(verdicts: DataFrame, top_n: int, least: float) -> DataFrame:
    """All verdicts (profile_id, job_key, hidden, rank, status_updated) after a rebalance: the shown have their new rank,
    the others keep theirs, and a row that was shown and no longer is loses its stamp, so that it isn't taken for dismissed."""
    moved = rebalance_visible(verdicts, top_n, least).select("profile_id", "job_key", F.col("hidden").alias("_hidden"), F.col("rank").alias("_rank"), "moved")
    stamp = F.when(F.coalesce(F.col("moved") == "demoted", F.lit(False)), F.lit(None)).otherwise(F.col("status_updated"))
    return verdicts.join(moved, ["profile_id", "job_key"], "left").select("profile_id", "job_key", F.coalesce("_hidden", "hidden").alias("hidden"), F.coalesce("_rank", "rank").alias("rank"), stamp.alias("status_updated"))


def count_preferences(p: Column) -> Column:
    """How many preferences a profile (struct of must_haves, nice_to_haves, salary_min, salary_max, work_style,
    preferred_locations, hard_locations) may be matched on: at least 1."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    said = F.lower(F.array_join(some(p["must_haves"]), " "))
    speaks = lambda of: F.exists(F.array(*map(F.lit, of)), lambda w: F.contains(said, w))
    style = F.lower(F.btrim(F.coalesce(p["work_style"], F.lit(""))))
    pay = (F.coalesce(p["salary_min"], F.lit(0)) != 0) | (F.coalesce(p["salary_max"], F.lit(0)) != 0)
    places = F.filter(some(p["preferred_locations"]), lambda x: F.coalesce(x, F.lit("")) != "")
    located = F.exists(places, lambda x: F.lower(x) != "remote") | (F.size(some(p["hard_locations"])) > 0)
    extra = (pay & ~speaks(PAY_WORDS)).cast("int") + (~style.isin("", "flexible", "unknown") & ~speaks(PLACE_WORDS)).cast("int") + ((style != "remote") & located).cast("int")
    return F.greatest(F.size(some(p["must_haves"])) + F.size(some(p["nice_to_haves"])) + extra, F.lit(1))


def repromote(verdicts: DataFrame, outcomes: DataFrame, scores: DataFrame, recent: DataFrame, top_n: int, least: float) -> DataFrame:
    """Next state (profile_id, job_key, hidden, rank, manager_score, candidate_score, match_score) after a change of the
    requirements or weights: verdicts that pass again and were filtered go; those that now fail are hidden without
    scores; of the rest, those with stored pairs take the new scores; each profile's best are shown and ranked.

    outcomes is lifecycle.refilter's result, scores compute_scores', recent (job_key) the postings within retention.
    """
    key = ["profile_id", "job_key"]
    now = verdicts.join(outcomes.select(*key, "outcome"), key, "left").where("outcome is null or outcome <> 'deleted'")
    failed = F.col("outcome") == "updated"
    note = F.when(failed, "[Hard filter] ").otherwise(F.col("match_notes"))
    reset = (F.col("status") == "new") & ~F.col("hidden")
    state = now.withColumns({"match_notes": note, "hidden": failed | reset | F.col("hidden"), "status_updated": F.when(~reset | failed, F.col("status_updated"))}).na.fill(False, ["hidden"])
    told = ~F.coalesce(F.col("match_notes").like("[Hard filter]%") | F.col("match_notes").like("[Title filter]%"), F.lit(True))
    fresh = scores.select(*key, *(F.col(c).alias(f"_{c}") for c in ("manager_score", "candidate_score", "match_score"))).join(recent.select("job_key"), "job_key", "left_semi")
    joined = state.join(fresh, key, "left")
    renewed = {c: F.when(failed, F.lit(None)).when(told & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("manager_score", "candidate_score", "match_score")}
    scored = joined.withColumns(renewed).select(*verdicts.columns)
    shown = rebalance_visible(scored, top_n, least).select(*key, F.col("hidden").alias("_hidden"), "rank")
    return scored.join(shown, key, "left").select(*key, F.coalesce("_hidden", "hidden").alias("hidden"), "rank", "manager_score", "candidate_score", "match_score")


def token_batches(jobs: DataFrame, budget: int = 20_000, most: int = 50, chars_per_token: float = 3.5) -> DataFrame:
    """(profile_id, job_key, tokens, batch) of jobs (profile_id, turn, job_key, n_chars): in each profile's order a new
    batch starts where the tokens would pass the budget or the batch has most jobs.

    A profile's jobs are bounded by its score limit; only keys and numbers reach the worker.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows, batch, held, total = rows.sort_values(["turn", "job_key"]), 0, 0, 0
        out = []
        for tokens in rows["tokens"]:
            if held and (total + tokens > budget or held >= most):
                batch, held, total = batch + 1, 0, 0
            held, total = held + 1, total + tokens
            out.append(batch)
        return rows.assign(batch=out)[["profile_id", "job_key", "tokens", "batch"]]

    sized = jobs.select("profile_id", "turn", "job_key", F.greatest(F.lit(1), F.bround(F.col("n_chars") / F.lit(chars_per_token), 0)).cast("long").alias("tokens"))
    kind = sized.schema["job_key"].dataType.simpleString()
    own = sized.schema["profile_id"].dataType.simpleString()
    return sized.groupBy("profile_id").applyInPandas(pack, f"profile_id {own}, job_key {kind}, tokens long, batch long")
