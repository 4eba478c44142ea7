"""Search planning for many profiles: company lists, boards, packed queries and request quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of the kinds of wishes.
KIND_RANK = {"required": 0, "preferred": 1}


def company_search_list(wishes: DataFrame) -> DataFrame:
    """(profile_id, company, place) of wishes (profile_id, pos, kind, company): required first, the first of equal names
    wins whatever its case, without blank names and names that the profile excludes."""
    named = wishes.withColumn("company", F.btrim("company")).where("company <> ''").withColumn("low", F.lower("company"))
    rank = F.when(F.col("kind") == "required", KIND_RANK["required"]).otherwise(KIND_RANK["preferred"])
    wanted = named.where("kind <> 'excluded'").groupBy("profile_id", "low").agg(F.min(F.struct(rank.alias("rank"), "pos", "company")).alias("w"))
    kept = wanted.join(named.where("kind = 'excluded'").select("profile_id", "low").distinct(), ["profile_id", "low"], "left_anti")
    order = Window.partitionBy("profile_id").orderBy("w.rank", "w.pos")
    return kept.select("profile_id", F.col("w.company").alias("company"), F.row_number().over(order).alias("place"))


def board_coverage(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """companies with has_board: whether a board has the name as its company or slug, whatever the case."""
    names = boards.select(F.explode(F.array(F.lower("company"), F.lower("slug"))).alias("_name")).distinct().withColumn("_hit", F.lit(True))
    joined = companies.withColumn("_name", F.lower("company")).join(names, "_name", "left")
    return joined.select(*companies.columns, F.coalesce("_hit", F.lit(False)).alias("has_board"))


def budgeted_queries(companies: DataFrame, budget: int, titles: Column, suffix: Column) -> DataFrame:
    """(profile_id, bucket, query): each profile's companies packed in order into budget queries at most; none for no budget.

    titles and suffix are expressions over the columns of companies that are the same throughout a profile.
    """
    if budget <= 0:
        companies = companies.where("false")
    all_of = Window.partitionBy("profile_id")
    size = F.ceil(F.count("*").over(all_of) / F.lit(max(budget, 1)))
    packed = companies.withColumns({"_n": F.row_number().over(all_of.orderBy("place")) - 1, "_size": size, "_titles": titles, "_suffix": suffix})
    bucket = F.floor(F.col("_n") / F.col("_size")).cast("int")
    grouped = packed.groupBy("profile_id", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("_n", "company"))).alias("c"), F.first("_titles").alias("t"), F.first("_suffix").alias("s"))
    return grouped.select("profile_id", "bucket", F.concat_ws(" ", "t", F.lit("at"), F.array_join(F.col("c.company"), " OR "), F.nullif("s", F.lit(""))).alias("query"))


def query_titles(hard_titles: Column, soft_titles: Column) -> Column:
    """The first three hard titles, or soft ones where there are none, joined by OR; without titles Software Engineer."""
    some = lambda c: F.when(F.size(c) > 0, c)
    titles = F.coalesce(some(hard_titles), some(soft_titles), F.array(F.lit("Software Engineer")))
    return F.array_join(F.slice(titles, 1, 3), " OR ")


def keyword_queries(profiles: DataFrame) -> DataFrame:
    """(profile_id, query) of profiles (profile_id, hard_titles, soft_titles, keywords): the primary title, and the
    second soft title with the first keyword that the primary title lacks."""
    primary = F.coalesce(F.get("hard_titles", F.lit(0)), F.get("soft_titles", F.lit(0)), F.lit("Software Engineer"))
    word = F.get(F.filter("keywords", lambda k: ~F.contains(F.lower(primary), F.lower(k))), F.lit(0))
    second = F.concat(F.get("soft_titles", F.lit(1)), F.lit(" "), word)
    return profiles.select("profile_id", F.explode(F.array_compact(F.array(primary, second))).alias("query"))


def uncovered(companies: DataFrame, budget: int) -> DataFrame:
    """Those of companies that budgeted_queries leaves out: all without a budget, else none, as its packs grow to fit."""
    return companies if budget <= 0 else companies.where("false")


def keyword_plan(profiles: DataFrame, companies: DataFrame) -> DataFrame:
    """(profile_id, query, location): keyword_queries, and the primary title at each of companies (profile_id, company)
    that no budgeted query covers; the place is the first of locations, or remote if remote_type says so, or empty."""
    primary = F.coalesce(F.get("hard_titles", F.lit(0)), F.get("soft_titles", F.lit(0)), F.lit("Software Engineer"))
    place = F.coalesce(F.get("locations", F.lit(0)), F.when(F.col("remote_type") == "remote", "remote"), F.lit(""))
    own = profiles.select("profile_id", primary.alias("_title"), place.alias("location"))
    at = companies.join(own, "profile_id").select("profile_id", F.concat("_title", F.lit(" at "), "company").alias("query"), "location")
    return keyword_queries(profiles).join(own, "profile_id").select("profile_id", "query", "location").unionByName(at)


def reset_after(day: Column, reset_day: Column) -> Column:
    """The reset day in the month after day, clamped to that month's end."""
    last = F.last_day(F.add_months(day, 1))
    return F.least(last, F.date_add(F.trunc(last, "month"), reset_day - 1))


def quota_ledger(usage: DataFrame, limit: int) -> DataFrame:
    """(service, day, used, remaining, exhausted) of daily usage (service, day, reset_day, n).

    The fold runs over the days of a service. A day on or after the boundary starts a new cycle; its boundary is the
    reset day of the next month.
    """
    daily = usage.groupBy("service", "reset_day", "day").agg(F.sum("n").alias("n"))
    days = daily.groupBy("service", "reset_day").agg(F.sort_array(F.collect_list(F.struct("day", "n"))).alias("days"))
    start = F.struct(F.lit(None).cast("date").alias("until"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<day:date,used:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = s["until"].isNull() | (x["day"] >= s["until"])
        used = F.when(fresh, 0).otherwise(s["used"]) + x["n"]
        until = F.when(fresh, reset_after(x["day"], F.col("reset_day"))).otherwise(s["until"])
        return F.struct(until.alias("until"), used.alias("used"), F.concat(s["out"], F.array(F.struct(x["day"].alias("day"), used.alias("used")))).alias("out"))

    rows = days.select("service", F.inline(F.aggregate("days", start, step, lambda s: s["out"])))
    return rows.select("service", "day", "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0).cast("long")).alias("remaining"), (F.col("used") >= limit).alias("exhausted"))
