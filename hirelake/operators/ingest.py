"""Posting keys and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_key(title: Column, company: Column, location: Column) -> Column:
    """First 16 hex digits of the MD5 over the fields' letters, digits, underscores and bars; null counts as empty."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_|]", "")
    return F.substring(F.md5(F.concat_ws("|", plain(title), plain(company), plain(location))), 1, 16)


def first_wins(rows: DataFrame, stored_keys: DataFrame | None = None) -> DataFrame:
    """Rows with a title and company; the first row by (profile_id, source_rank, seq) of each key not yet stored.

    min_by is pre-aggregated, so a key that a hot feed repeats is one row for each task.
    """
    keyed = rows.where("title <> '' and company <> ''").withColumn("job_key", job_key(F.col("title"), F.col("company"), F.col("location")))
    fields = [c for c in keyed.columns if c != "job_key"]
    first = keyed.groupBy("job_key").agg(F.min_by(F.struct(*fields), F.struct("profile_id", "source_rank", "seq")).alias("r")).select("job_key", "r.*")
    return first if stored_keys is None else first.join(stored_keys.select("job_key").distinct(), "job_key", "left_anti")


def counts(rows: DataFrame, new: DataFrame) -> DataFrame:
    """profile_id, seen (rows, the skipped ones included) and new (first_wins' rows) of each profile that fetched rows."""
    added = new.groupBy("profile_id").agg(F.count("*").alias("new"))
    seen = rows.groupBy("profile_id").agg(F.count("*").alias("seen"))
    return seen.join(added, seen["profile_id"].eqNullSafe(added["profile_id"]), "left").select(seen["profile_id"], "seen", F.coalesce("new", F.lit(0)).alias("new"))
