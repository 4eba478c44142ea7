"""Quality rules: base counts plus a hashed n-gram log-likelihood ratio, on DataFrame functions alone.

Words are hashed alone and in pairs into buckets. Two smoothed multinomials over the buckets, one of trusted target
documents and one of the raw corpus (all documents), give each bucket a log ratio; a document's score is the mean over
its n-grams, and it is kept when the score reaches the threshold.

The threshold is one number for all documents. It is fitted on all labelled documents that pass the base rule and that the
trusted ones leave out (TUNING_FOLD): of all cuts between two of their scores the one with the least sum of the share
of bad documents kept and of good ones lost, the lowest of equal ones, at the middle of its gap. Without a bad and a good
one among them it is THRESHOLD.

Cases: null and blank texts have no words, fail the base rule and score 0; without trusted documents both multinomials
are uniform and every score is 0, so the base rule decides; a score equal to the threshold is kept; repeated rows get
equal results, and a document labelled both good and bad counts as bad; very long texts are read whole (31 bits of word
positions); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, table, words

BUCKETS = 10_000
THRESHOLD = -0.12
#: Labelled documents that fit the threshold are those whose crc32 of doc_id as text has this remainder.
TUNING_FOLDS, TUNING_FOLD = 5, 1
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for a row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array.

    Hashes tell most documents apart at once. Where two agree, numbers that hold a window's hash above its position
    are sorted, so that equal windows stand side by side; their words are compared, and the union of their positions
    is counted. The position takes 16 bits in most documents and 31 in longer ones. Where windows of one shortened
    hash differ in their words, the windows' texts are sorted instead.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(1), n - 2)
    at = lambda i, k: F.element_at(w, i + k)
    bits = F.when(n < 1 << 16, 16).otherwise(31)
    up, down = (lambda x: F.call_function("shiftleft", x, bits)), (lambda x: F.call_function("shiftright", x, bits))
    place = lambda x: (x - up(down(x))).cast("int")
    equal = lambda i, j: (at(i, 0) == at(j, 0)) & (at(i, 1) == at(j, 1)) & (at(i, 2) == at(j, 2))

    def neighbours(s: Column, same, number) -> Column:
        follows = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(same(x, y), F.array(number(x), number(y))))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(follows, lambda p: p.isNotNull()))))

    def union(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(y - x, F.lit(3)))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(steps, F.lit(3), lambda a, d: a + d))

    def by_hash(s: Column) -> Column:
        clash = F.exists(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: (down(x) == down(y)) & ~equal(place(x), place(y))), lambda c: F.coalesce(c, F.lit(False)))
        plain = lambda: neighbours(s, lambda x, y: (down(x) == down(y)) & equal(place(x), place(y)), place)
        return F.when(clash, by_text()).otherwise(plain())

    def by_text() -> Column:
        texts = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("t"), i.alias("i"))))
        return _let(texts, lambda s: neighbours(s, lambda x, y: x["t"] == y["t"], lambda x: x["i"]))

    def count(h: Column) -> Column:
        exact = lambda: _let(_let(F.sort_array(F.zip_with(h, starts, lambda x, i: up(x) + i)), by_hash), union)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), exact()).otherwise(0)

    hashes = F.transform(starts, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    return F.when(n < 4, 0).otherwise(_let(hashes, count)).cast("long")


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _pairs(w: Column, f) -> Column:
    """f(word, next word) for each word; the last one has no next."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), f)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: array of the buckets' log ratio between the trusted and the raw multinomial, add-one smoothed, of docs
    (doc_id, text); texts meet the trusted ids before they are split up, in a shuffle at any size: ids are too many to be
    broadcast, and disk grows as the input."""
    flagged = docs.join(trusted.withColumn("trusted", F.lit(1)).hint("shuffle_merge"), "doc_id", "left").withColumn("w", words(F.col("text")))
    grams = _pairs(F.col("w"), lambda a, b: F.when(b.isNull(), F.array(_bucket(a))).otherwise(F.array(_bucket(a), _bucket(a, b))))
    counts = flagged.select("trusted", F.explode(F.flatten(grams)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    arrays = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("a"), F.sum("raw").alias("r"), F.sum("good").alias("g"))
    ratio = lambda x: F.log((x["good"] + 1.0) / (F.col("g") + BUCKETS)) - F.log((x["raw"] + 1.0) / (F.col("r") + BUCKETS))
    return arrays.select(F.when(F.col("g") > 0, F.transform("a", ratio)).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("weights"))


def _scored(split: DataFrame, weights: Column) -> DataFrame:
    """Base counts, base_failed and score of documents (doc_id, text, w)."""
    grams = _pairs(F.col("w"), lambda a, b: F.element_at(weights, _bucket(a) + 1) + F.when(b.isNull(), 0.0).otherwise(F.element_at(weights, _bucket(a, b) + 1)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        (F.aggregate(grams, F.lit(0.0), lambda a, x: a + x) / F.greatest(2 * F.size("w") - 1, F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def best_cut(scores: DataFrame) -> float | None:
    """The threshold by the rule above of (score, good), any number of rows; None without a good and a bad one.

    Scores are dealt by ranges, so that the counts below a score are those of the ranges before and those within its own.
    """
    tied = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    dealt = cut(tied.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("score").alias("last"))
    order = Window.orderBy("part")  # a row for each range
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("g").alias("good_before"), before("b").alias("bad_before"), F.lag("last").over(order).alias("last_before"))
    total = dealt.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    if not total["g"] or not total["b"]:
        return None
    up = Window.partitionBy("part").orderBy("score")
    below = lambda c: F.coalesce(F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"{c}_before")
    lost, kept = below("good") / F.lit(total["g"]), 1 - below("bad") / F.lit(total["b"])
    previous = F.coalesce(F.lag("score").over(up), "last_before")
    costs = dealt.join(F.broadcast(parts), "part").select("score", F.coalesce((previous + F.col("score")) / 2, "score").alias("cut"), (lost + kept).alias("cost"))
    return costs.agg(F.min_by("cut", F.struct("cost", "score")).alias("cut")).first()["cut"]


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, tuning: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    tuning (doc_id, good), distinct ids, fits the threshold; threshold is that without it.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ratios = log_ratios(docs, trusted.select("doc_id")).first()["weights"]  # BUCKETS numbers, whatever the input
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folds to one literal
    scored = _scored(docs.withColumn("w", words(F.col("text"))), weights)
    if tuning is not None:
        scored = cut(scored)  # a few numbers for each document: these meet the labels, texts don't
        known = scored.where("not base_failed").select("doc_id", "score").join(tuning.select("doc_id", "good"), "doc_id")
        fitted = best_cut(known.select("score", "good"))
        threshold = threshold if fitted is None else fitted
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % TUNING_FOLDS == TUNING_FOLD


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all good documents outside the tuning fold."""
    good = labels.where("quality = 1 and doc_id is not null").where(~_held_out())
    return good.select("doc_id").distinct()


def tuning_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of all labelled documents of the tuning fold."""
    told = labels.where("quality is not null and doc_id is not null").where(_held_out())
    return told.groupBy("doc_id").agg(F.min(F.col("quality") == 1).alias("good"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(labels), tuning=tuning_rows(labels))
