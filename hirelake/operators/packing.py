"""Jobs of a profile's queue in batches of a token budget, without walking the queue in one place.

A queue is cut into pieces of PIECE jobs. Each piece tells, for every job it could be entered at, where the next piece is
entered and how many batches begin meanwhile; those short maps alone are put together along a profile, and then each piece
numbers its own jobs. All of it is built-in functions; pieces are bounded, and a profile's row of maps has one entry for
each PIECE jobs.

Null fields, empty texts, zero and false count as not filled; a job without any field has one token. Turns are 1, 2, 3 ...
within a profile; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 256
BUDGET, MOST, CHARS_PER_TOKEN = 20_000, 50, 3.5


def estimated_tokens(*fields: Column) -> Column:
    """Tokens of the filled fields side by side with a blank between them, one at least."""
    filled = F.filter(F.array(*(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), lambda x: ~x.isin("", "0", "0.0", "false"))
    return F.greatest(F.lit(1), F.bround(F.char_length(F.array_join(filled, " ")) / F.lit(CHARS_PER_TOKEN), 0)).cast("long")


def numbered(jobs: DataFrame) -> DataFrame:
    """jobs with turn, their place within their profile by job_key."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy("profile_id").orderBy("job_key")))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fits(tokens: Column, budget: int) -> Column:
    """How many of the tokens a batch takes from the first on."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, t: Column) -> Column:
        more = s["open"] & ((s["n"] == 0) | (s["total"] + t <= budget))
        return F.struct((s["total"] + t).alias("total"), F.when(more, s["n"] + 1).otherwise(s["n"]).alias("n"), more.alias("open"))

    return F.aggregate(tokens, start, step, lambda s: s["n"])


def _exits(sizes: Column, most: int) -> Column:
    """For an entry at each of the first most jobs: jobs of the next piece that the last batch takes, and batches begun."""
    none = F.array().cast("array<struct<past:int,batches:int>>")

    def step(known: Column, n: Column) -> Column:
        left = F.size(known)  # jobs of the piece after this one
        here = F.when(n > left, F.struct((n - left - 1).alias("past"), F.lit(1).alias("batches"))).otherwise(_let(F.get(known, n - 1), lambda k: F.struct(k["past"].alias("past"), (k["batches"] + 1).alias("batches"))))
        return F.concat(F.array(here), known)

    return F.slice(F.aggregate(F.reverse(sizes), none, step), 1, most)


def token_batches(jobs: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(profile_id, job_key, tokens, batch) of jobs (profile_id, turn, job_key, tokens): in each profile's order a new batch,
    from 0, starts where the tokens would pass the budget or the batch has most jobs."""
    size = max(PIECE, most)
    dealt = jobs.select("profile_id", F.floor((F.col("turn") - 1) / size).cast("int").alias("piece"), F.struct("turn", "job_key", "tokens").alias("job"))
    pieces = dealt.groupBy("profile_id", "piece").agg(F.sort_array(F.collect_list("job")).alias("jobs"))  # size of them at most
    after = pieces.select("profile_id", (F.col("piece") - 1).alias("piece"), F.slice(F.col("jobs.tokens"), 1, most - 1).alias("ahead")) if most > 1 else pieces.select("profile_id", "piece", F.array().cast("array<bigint>").alias("ahead"))
    seen = pieces.join(after, ["profile_id", "piece"], "left").withColumn("seen", F.concat(F.col("jobs.tokens"), F.coalesce("ahead", F.array().cast("array<bigint>"))))
    sized = seen.withColumn("sizes", _let(F.col("seen"), lambda s: F.transform("jobs", lambda _, i: _fits(F.slice(s, i + 1, F.lit(most)), budget)))).drop("seen", "ahead")

    maps = sized.select("profile_id", F.struct("piece", _exits(F.col("sizes"), most).alias("exits"), F.size("jobs").alias("n")).alias("m"))
    start = F.struct(F.lit(0).alias("past"), F.lit(0).alias("batch"), F.array().cast("array<struct<piece:int,past:int,batch:int>>").alias("entries"))

    def along(s: Column, m: Column) -> Column:
        entries = F.concat(s["entries"], F.array(F.struct(m["piece"].alias("piece"), s["past"].alias("past"), s["batch"].alias("batch"))))
        onward = _let(F.get(m["exits"], s["past"]), lambda e: F.struct(F.coalesce(e["past"], s["past"] - m["n"]).alias("past"), (s["batch"] + F.coalesce(e["batches"], F.lit(0))).alias("batch")))
        return _let(onward, lambda o: F.struct(o["past"].alias("past"), o["batch"].alias("batch"), entries.alias("entries")))

    entered = maps.groupBy("profile_id").agg(F.sort_array(F.collect_list("m")).alias("ms")).select("profile_id", F.inline(F.aggregate("ms", start, along, lambda s: s["entries"])))
    first = F.struct(F.lit(0).alias("at"), F.col("past").alias("next"), (F.col("batch") - 1).alias("batch"), F.array().cast("array<int>").alias("out"))

    def number(s: Column, n: Column) -> Column:
        begins = s["at"] == s["next"]
        batch = F.when(begins, s["batch"] + 1).otherwise(s["batch"])
        return F.struct((s["at"] + 1).alias("at"), F.when(begins, s["at"] + n).otherwise(s["next"]).alias("next"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    told = sized.join(entered, ["profile_id", "piece"]).select("profile_id", F.explode(F.arrays_zip("jobs", F.aggregate("sizes", first, number, lambda s: s["out"]).alias("batches"))).alias("j"))
    return told.select("profile_id", F.col("j.jobs.job_key").alias("job_key"), F.col("j.jobs.tokens").alias("tokens"), F.col("j.batches").cast("long").alias("batch"))
