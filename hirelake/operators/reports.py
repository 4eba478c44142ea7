"""Reports on verdicts, postings and runs: tabs and sorts of matches, searches, facets and search modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses in the interviewing tab; statuses that no user has acted on; tabs besides the statuses.
INTERVIEWING = ["phone_screen", "interview_1", "interview_2", "interview_3"]
UNTOUCHED = ["new", "missing_info"]
#: Hours after which a search starts over, and hours that it looks back beyond the last run.
FULL_HOURS, OVERLAP = 720, 24


def _saved() -> Column:
    return F.coalesce("saved", F.lit(False))


def _shown() -> Column:
    return ~F.col("hidden") & (F.col("manager_score").isNotNull() | _saved() | ~F.col("status").isin(UNTOUCHED))


def matches_by_tab(verdicts: DataFrame, jobs: DataFrame, oldest: str) -> DataFrame:
    """verdicts joined with jobs (job_key, title, company, date_posted, date_found, effective), one row for each tab that
    shows it: all, saved, interviewing, the row's status, missing_info, show_all (hidden scored ones too) and hidden.

    Rows that nobody acted on stay for as long as their effective date is not before oldest; the hidden tab has no such limit.
    """
    scored, shown = F.col("manager_score").isNotNull(), _shown()
    recent = ~F.col("status").isin(UNTOUCHED) | (F.col("effective") >= oldest)
    tabs = F.array_compact(F.array(
        F.when(recent & shown, "all"),
        F.when(recent & shown & _saved(), "saved"),
        F.when(recent & shown & F.col("status").isin(INTERVIEWING), "interviewing"),
        F.when(recent & shown & (F.col("status") != "missing_info"), F.col("status")),
        F.when(recent & (F.col("status") == "missing_info"), "missing_info"),
        F.when(recent & scored, "show_all"),
        F.when(F.col("hidden") & scored, "hidden"),
    ))
    return verdicts.join(jobs, "job_key").withColumn("tab", F.explode(tabs))


def sort_keys(sort: str) -> list[Column]:
    """The order of matches by score, date, found, company or status (anything else: score); ties by job_key."""
    score = F.coalesce("manager_score", F.lit(0)) + F.coalesce("candidate_score", F.lit(0))
    orders = {"date": [F.desc("date_posted"), F.desc("date_found")], "found": [F.desc("date_found")], "company": [F.asc("company"), F.asc("title")], "status": [F.asc("status")]}
    return [*orders.get(sort, [score.desc()]), F.asc("job_key")]


def search_keys(sort: str) -> list[Column]:
    """The order of found jobs by date_found, date_posted (where it has no shape of a date: date_found), company or title
    (anything else: date_found); ties by job_key. Dates run backwards, and nulls come last there, first elsewhere."""
    dated = F.when(F.col("date_posted").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date_posted")).otherwise(F.col("date_found").cast("date").cast("string"))
    orders = {"date_posted": [dated.desc()], "company": [F.asc("company"), F.asc("title")], "title": [F.asc("title")]}
    return [*orders.get(sort, [F.desc("date_found")]), F.asc("job_key")]


def in_order(matches: DataFrame, sort: str) -> DataFrame:
    """matches in the order of sort_keys."""
    return matches.orderBy(*sort_keys(sort))


def stage_totals(verdicts: DataFrame) -> DataFrame:
    """profile_id, total, saved, interviewing (all three visible rows alone), missing_info and hidden_scored."""
    shown = _shown()
    return verdicts.groupBy("profile_id").agg(
        F.count_if(shown).alias("total"),
        F.count_if(~F.col("hidden") & _saved()).alias("saved"),
        F.count_if(shown & F.col("status").isin(INTERVIEWING)).alias("interviewing"),
        F.count_if(F.col("status") == "missing_info").alias("missing_info"),
        F.count_if(F.col("hidden") & F.col("manager_score").isNotNull()).alias("hidden_scored"),
    )


def found_jobs(jobs: DataFrame, verdicts: DataFrame, text: str = "", source: str = "", remote_type: str = "", paid: bool = False, posted_after: str = "", profile: int | str | None = None, missing_info: bool = False, scored: bool = False) -> DataFrame:
    """jobs (job_key and the columns of postings) that meet all given conditions.

    profile is a profile's id, or "none" for jobs that no verdict refers to; the verdicts enter by semi and anti joins.
    """
    low = text.strip().lower()
    if low:
        jobs = jobs.where(F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("company"), F.lit(low)))
    for column, wanted in (("source", source), ("remote_type", remote_type)):
        if wanted:
            jobs = jobs.where(F.col(column) == wanted)
    if paid:
        jobs = jobs.where(F.coalesce(*(F.col(c).cast("string") for c in ("salary_min", "salary_max", "salary_raw") if c in jobs.columns)).isNotNull())
    if posted_after:
        jobs = jobs.where(F.col("date_posted").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("date_posted") >= posted_after))
    if profile == "none":
        jobs = jobs.join(verdicts.select("job_key"), "job_key", "left_anti")
    elif profile is not None:
        jobs = jobs.join(verdicts.where(F.col("profile_id") == profile).select("job_key"), "job_key", "left_semi")
    if missing_info:
        jobs = jobs.join(verdicts.where("status = 'missing_info'").select("job_key"), "job_key", "left_semi")
    if scored:
        jobs = jobs.join(verdicts.where("manager_score is not null").select("job_key"), "job_key", "left_semi")
    return jobs


def associations(verdicts: DataFrame, names: DataFrame) -> DataFrame:
    """job_key, chips: its verdicts by profile name and status, each with the filter's reason, or scores and match in
    percent; names is (profile_id, name), some thousands at most, and Spark picks the join."""
    match = F.concat(F.lit(" "), F.round(F.col("match_score") * 100).cast("int"), F.lit("%"))
    scores = F.coalesce(F.concat("manager_score", F.lit("/"), F.coalesce("candidate_score", F.lit(0)), F.coalesce(match, F.lit(""))), F.lit("unscored"))
    chip = F.concat("name", F.lit(": "), F.when(F.startswith("match_notes", F.lit("[")), F.split_part("match_notes", F.lit("] "), F.lit(2))).otherwise(scores))
    rows = verdicts.join(names, "profile_id").groupBy("job_key").agg(F.sort_array(F.collect_list(F.struct("name", "status", chip.alias("chip")))).alias("r"))
    return rows.select("job_key", F.array_join("r.chip", "; ").alias("chips"))


def search_mode(finished: Column, as_of: Column, override: Column, force: Column) -> tuple[Column, Column]:
    """(mode, hours) of a profile whose last successful run ended at the text finished (null or empty: no run).

    A time that can't be read counts as long ago. override is full, incremental, or anything else for automatic.
    """
    none = F.coalesce(finished, F.lit("")) == ""
    at = F.try_to_timestamp(finished)
    hours = F.when(none | at.isNull(), FULL_HOURS + OVERLAP).otherwise(F.floor((as_of.cast("timestamp").cast("long") - at.cast("long")) / 3600))
    full = F.coalesce(force, F.lit(False)) | F.coalesce(override == "full", F.lit(False)) | (~F.coalesce(override == "incremental", F.lit(False)) & (none | (hours > FULL_HOURS)))
    return F.when(full, "full").otherwise("incremental"), F.when(full, FULL_HOURS).otherwise(F.least(hours + OVERLAP, F.lit(FULL_HOURS))).cast("long")


#: Seconds of a slice of the run log.
SLICE = 30 * 86_400


def last_success(runs: DataFrame) -> DataFrame:
    """runs (profile_id, run_id, started, finished, status) with last_finished: the finished of the profile's latest
    successful run before each run, by started and run_id; null where there is none, or where that run has none.

    An as-of join of the log with itself: slices of time are searched each for itself, and what each slice ends with is
    carried to the later ones, so a profile's whole log is never sorted as one group. Rows without a start come first.
    """
    at = F.struct("started", "run_id")
    ended = F.when(F.col("status") == "success", F.struct(F.col("finished").alias("f")))
    sliced = runs.withColumn("_slice", F.coalesce(F.floor(F.unix_timestamp("started") / SLICE), F.lit(-(1 << 62))))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(ended, ignorenulls=True).over(before("profile_id", "_slice").orderBy("started", "run_id"))
    ends = sliced.groupBy("profile_id", "_slice").agg(F.max_by(ended, F.when(ended.isNotNull(), at)).alias("_end"))
    carried = ends.select(F.col("profile_id").alias("_who"), F.col("_slice").alias("_then"), F.last("_end", ignorenulls=True).over(before("profile_id").orderBy("_slice")).alias("_carried"))
    same = F.col("profile_id").eqNullSafe(F.col("_who")) & (F.col("_slice") == F.col("_then"))
    return sliced.withColumn("_own", own).join(carried, same, "left").select(*runs.columns, F.coalesce("_own", "_carried")["f"].alias("last_finished"))


def cleared(jobs: DataFrame, verdicts: DataFrame, runs: DataFrame, profile_id: int | None) -> DataFrame:
    """(name, n): rows that clearing a profile removes from verdicts, runs and jobs (those that no verdict of another
    profile refers to); without a profile everything goes."""
    mine = F.lit(True) if profile_id is None else F.col("profile_id") == profile_id
    orphans = jobs if profile_id is None else jobs.join(verdicts.where(~mine).select("job_key"), "job_key", "left_anti")
    counts = {"verdicts": verdicts.where(mine), "runs": runs.where(mine), "jobs": orphans}
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
