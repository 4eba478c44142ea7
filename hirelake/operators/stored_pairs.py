"""Match pairs as verdicts store them, in JSON text: scored anew, and shown pair by pair from either side.

The text becomes a VARIANT once and its elements rows. Text that is no JSON, JSON that is no array, and elements that are
no objects have no pairs; a verdict without pairs still has its scores. Null text is no stored result: no rows. Missing
and null fields are null, numbers and truth values their text; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sections import BLANKS
from . import scoring

FIELDS = ["category", "job_side", "candidate_side", "job_importance", "candidate_priority"]
#: Names shown for categories and levels, and for a side that is absent.
CATEGORY_LABELS = {"skill": "Skill", "experience": "Experience", "domain": "Domain", "compensation": "Compensation", "equity": "Equity", "benefits": "Benefits", "work_arrangement": "Work Style", "culture_growth": "Culture & Growth"}
LEVEL_LABELS = {"required": "required", "preferred": "preferred", "nice_to_have": "nice to have", "must_have": "must have"}
NO_JOB_SIDE, NO_CANDIDATE_SIDE = "—", "not in profile"
PERSPECTIVES = {"mgr": scoring.MANAGER_KINDS, "cand": scoring.CANDIDATE_KINDS}


def pairs_of(verdicts: DataFrame) -> DataFrame:
    """profile_id, job_key, pos and the fields of each stored pair of verdicts(profile_id, job_key, pairs_json); a verdict
    without any pair has one row of nulls."""
    rows = verdicts.where("pairs_json is not null").select("profile_id", "job_key", F.try_parse_json("pairs_json").alias("stored"))
    each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("stored").outer()), how="inner")
    pair = F.when(F.col("key").isNull() & F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")), F.col("value"))
    return each.select("profile_id", "job_key", "pos", *(F.try_variant_get(pair, f"$.{name}", "string").alias(name) for name in FIELDS))


def rescore(verdicts: DataFrame, ideals: DataFrame, oldest: Column) -> DataFrame:
    """profile_id, job_key, manager_score, candidate_score, match_score of every verdict with stored pairs whose notes are
    known and of no filter and whose effective_date is not before oldest, whatever its status.

    ideals (profile_id, n) has each profile's number of preferences; a profile without one has none.
    """
    kept = verdicts.where(F.col("match_notes").isNotNull() & ~F.startswith("match_notes", F.lit("[Hard filter]")) & ~F.startswith("match_notes", F.lit("[Title filter]")) & (F.col("effective_date") >= oldest))
    told = pairs_of(kept).join(ideals.select("profile_id", F.col("n").alias("ideal")), "profile_id", "left")
    return scoring.compute_scores(told, F.coalesce("ideal", F.lit(0)))


def breakdown(verdicts: DataFrame) -> DataFrame:
    """A row for each stored pair of a perspective's categories: perspective (mgr or cand), pos, matched (both sides are
    there), label, level, job_text, candidate_text. A blank side counts as absent, an empty level as none."""
    side = lambda name: F.when(F.btrim(F.col(name), F.lit(BLANKS)) != "", F.col(name))
    level = lambda name: F.when(F.col(name) != "", F.coalesce(_label(F.col(name), LEVEL_LABELS), F.col(name)))
    kind = F.lower("category")
    perspective = F.when(kind.isin(PERSPECTIVES["mgr"]), "mgr").when(kind.isin(PERSPECTIVES["cand"]), "cand")
    told = pairs_of(verdicts).withColumn("perspective", perspective).where("perspective is not null")
    return told.select(
        "profile_id", "job_key", "perspective", "pos", (side("job_side").isNotNull() & side("candidate_side").isNotNull()).alias("matched"), _label(kind, CATEGORY_LABELS).alias("label"),
        F.when(F.col("perspective") == "mgr", level("job_importance")).otherwise(level("candidate_priority")).alias("level"),
        F.coalesce(side("job_side"), F.lit(NO_JOB_SIDE)).alias("job_text"), F.coalesce(side("candidate_side"), F.lit(NO_CANDIDATE_SIDE)).alias("candidate_text"),
    )


def _label(value: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), value)
