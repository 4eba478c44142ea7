"""Postings whose descriptions are short of content: found, recorded, filled in again, and taken back.

Descriptions are read by functions.sections, in built-in functions; the columns of its result decide. Null titles,
companies, links and descriptions count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pay
from ..functions.clearance import requires_clearance
from ..functions.sections import LEAST_CHARS, complete, text_features
from . import prefilter

#: Notes and statuses of recorded verdicts.
MISSING, MISSING_NOTE, BLOCKED_HOST = "missing_info", "[Missing info] ", "linkedin.com"


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def enrich_salary(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """jobs with salary_min and salary_max from the description where both are null, by the preferred_locations of the
    profile that fetched the posting; a single figure is the lower bound alone."""
    places = F.broadcast(profiles.select("profile_id", F.col("preferred_locations").alias("_places")))
    read = jobs.withColumn("_found", pay.pay_candidates("description")).join(places, "profile_id", "left")
    best, none = pay.choose(F.col("_found"), F.col("_places")), F.col("salary_min").isNull() & F.col("salary_max").isNull()
    read = read.withColumn("_best", best)
    low = F.when(none, F.col("_best.lo")).otherwise(F.col("salary_min"))
    high = F.when(none, F.when(F.col("_best.hi") != F.col("_best.lo"), F.col("_best.hi"))).otherwise(F.col("salary_max"))
    return read.withColumns({"salary_min": low, "salary_max": high}).select(jobs.columns)


def validate_descriptions(rows: DataFrame, stored: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (job_key, title, company, apply_url, description) with a title and a company, and the columns description
    (the page's where only that is complete) and outcome: stored, ok, fetched or missing_info.

    stored (job_key, description) holds earlier copies, pages (url, html) what links lead to; only rows whose own text
    and stored copy fall short look a page up.
    """
    known = stored.groupBy("job_key").agg(F.min("description").alias("_old"))
    page = pages.where("url is not null").groupBy("url").agg(F.min("html").alias("_html")).withColumn("_whole", complete("_html")).withColumn("_html", F.when(F.col("_whole"), F.col("_html")))
    told = rows.where(_filled("title") & _filled("company")).join(known, "job_key", "left")
    told = told.withColumn("_known", F.when(complete("_old"), "stored").when(complete("description"), "ok")).drop("_old")
    read = told.withColumn("_link", F.when(F.col("_known").isNull() & _filled("apply_url"), F.col("apply_url")))
    found = read.join(page, F.col("_link") == F.col("url"), "left")
    outcome = F.coalesce("_known", F.when(F.col("_whole"), "fetched").otherwise(MISSING))
    description = F.when(F.col("_known").isNull() & F.col("_whole"), F.col("_html")).otherwise(F.col("description"))
    return found.withColumns({"description": description, "outcome": outcome}).select(*rows.columns, "outcome")


def record_missing_info(verdicts: DataFrame, judged: DataFrame) -> DataFrame:
    """verdicts with a hidden row (score 0, status missing_info) for each (profile_id, job_key) of judged of which any
    row has the outcome missing_info, where no verdict stands yet."""
    flagged = judged.groupBy("profile_id", "job_key").agg(F.bool_or(F.col("outcome") == MISSING).alias("_short")).where("_short").drop("_short")
    new = flagged.join(verdicts.select("profile_id", "job_key"), ["profile_id", "job_key"], "left_anti")
    values = {"status": F.lit(MISSING), "hidden": F.lit(True), "match_score": F.lit(0.0), "match_notes": F.lit(MISSING_NOTE + "description too short")}
    return verdicts.unionByName(new.select("profile_id", "job_key", *(values[c].alias(c) for c in verdicts.columns if c in values)), allowMissingColumns=True)


def filter_completeness(jobs: DataFrame) -> DataFrame:
    """jobs with complete: an extract of LEAST_CHARS characters or more (within its limit) that can be scored."""
    enough = F.get(F.transform(F.array(text_features("description")), lambda f: (F.char_length(f["extract"]) >= LEAST_CHARS) & f["scoreable"]), F.lit(0))
    return jobs.withColumn("complete", enough)


def recover_missing_info(verdicts: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(profile_id, job_key, description, recovered) of the verdicts with status missing_info: recovered where the page
    behind the posting's link has an extract that is long enough; the page then is the description and the verdict goes."""
    page = pages.where("url is not null").groupBy("url").agg(F.min("html").alias("_html"))
    link = jobs.select("job_key", "apply_url", "description")
    read = verdicts.where(F.col("status") == MISSING).select("profile_id", "job_key").join(link, "job_key").join(page, F.col("apply_url") == F.col("url"), "left")
    open_link = _filled("apply_url") & ~F.contains(F.coalesce("apply_url", F.lit("")), F.lit(BLOCKED_HOST)) & _filled("_html")
    long_enough = text_features(F.when(open_link, F.col("_html")))["full_chars"] >= LEAST_CHARS
    read = read.withColumn("recovered", open_link & long_enough)
    return read.select("profile_id", "job_key", F.when(F.col("recovered"), F.col("_html")).otherwise(F.col("description")).alias("description"), "recovered")


def backfill_descriptions(jobs: DataFrame, verdicts: DataFrame, reasons: DataFrame, dump: DataFrame, boards: list[str]) -> tuple[DataFrame, DataFrame]:
    """Board postings without a description that a profile has as new and accepts (reason null) take the description of
    the dump's last row (turn) with their link; gives (job_key, description) of these, and the verdicts that start over
    (profile_id, job_key): new and not dismissed."""
    empty = jobs.where(F.col("source").isin(boards) & ~_filled("description") & _filled("apply_url")).select("job_key", "apply_url")
    last = dump.where(_filled("description") & _filled("apply_url")).groupBy("apply_url").agg(F.max_by("description", "turn").alias("description"))
    wanted = verdicts.where("status = 'new'").join(reasons.where("reason is null").select("profile_id", "job_key"), ["profile_id", "job_key"])
    filled = empty.join(wanted.select("job_key").distinct(), "job_key", "left_semi").join(last, "apply_url").select("job_key", "description")
    again = wanted.where("not (hidden and status_updated is not null)").join(filled.select("job_key"), "job_key", "left_semi").select("profile_id", "job_key")
    return filled, again


def backfill(verdicts: DataFrame, jobs: DataFrame, profiles: DataFrame, dump: DataFrame, boards: list[str]) -> tuple[DataFrame, DataFrame]:
    """Empty board postings that a profile has as new are judged by prefilter.judge and take the description and raw_data
    of the dump's last row (turn) with their link, if any reason is null.

    jobs has job_key, apply_url, source and the columns judge reads of a posting (needs_clearance and pay are worked out
    here, for the empty ones alone); profiles those it reads of a profile. Gives the filled texts (job_key, description,
    raw_data) and all verdicts in their next state, with started_over: a new row of an accepted pair whose posting was
    filled, and that is not dismissed (hidden by a user, hence stamped), loses its scores, notes and rank and is shown.
    A pair without a verdict has nothing to reset: it is unscored anyway. A repeated pair is reset each time it stands.
    """
    named = ["job_key", "apply_url", "company", "title", "location", "remote_type", "salary_min", "description"]
    empty = jobs.where(F.col("source").isin(boards) & ~_filled("description") & _filled("apply_url")).select(named)
    last = dump.where(_filled("description") & _filled("apply_url")).groupBy("apply_url").agg(F.max_by(F.struct("description", "raw_data"), "turn").alias("_new"))
    found = empty.join(last, "apply_url").withColumns({"needs_clearance": requires_clearance("title", "description"), "pay": pay.pay_candidates("description")})
    new = verdicts.where("status = 'new'").select("profile_id", "job_key").distinct()
    accepted = prefilter.judge(new.join(found, "job_key").join(profiles, "profile_id")).where("reason is null").select("profile_id", "job_key", "_new")
    texts = accepted.groupBy("job_key").agg(F.first("_new").alias("_new")).select("job_key", "_new.*")
    kept = verdicts.join(accepted.select("profile_id", "job_key", F.lit(True).alias("_again")), ["profile_id", "job_key"], "left")
    dismissed = F.col("hidden") & F.col("status_updated").isNotNull()
    again = F.coalesce(F.col("_again") & (F.col("status") == "new") & ~F.coalesce(dismissed, F.lit(False)), F.lit(False))
    start = {c: F.lit(None) for c in ("manager_score", "candidate_score", "match_notes", "rank")} | {"match_score": F.lit(0.0), "hidden": F.lit(False)}
    reset = {c: F.when(F.col("started_over"), v).otherwise(F.col(c)) for c, v in start.items() if c in verdicts.columns}
    return texts, kept.withColumn("started_over", again).withColumns(reset).select(*verdicts.columns, "started_over")
