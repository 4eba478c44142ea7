"""URL filter: longest fitting host/path rule, else gradient-boosted trees on lexical features of the URL.

The labelled URLs are those that a rule decides. Cases: null URLs and those without ``://`` have an empty host and
path, fit no rule and get the trees' verdict on the URL's features (null counts as empty); with no labelled URL of
either class every other URL is allowed; repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sample_rows, table

#: (verdict, host and path) of each rule.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Labelled URLs that train the trees, at most.
TRAIN_ROWS = 100_000
#: Rates of a suffix are drawn towards the overall rate by so many URLs.
PRIOR = 20.0
FEATURES = ["n_chars", "host_chars", "path_chars", "n_labels", "depth", "digit_ratio", "hyphens", "entropy", "n_params", "n_marks", "has_fragment", "secure", "suffix_rate", "suffix_share"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def decide(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits the columns host and path, and its verdict; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: len(r[1])):
        own, slash, path = name.partition("/")
        fits = ((F.col("host") == own) | F.endswith("host", F.lit("." + own))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(pages: DataFrame) -> DataFrame:
    """Lexical features beside the columns url, host and path."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    share = lambda c: F.char_length(F.expr("coalesce(url, '')")) - F.char_length(F.replace(u, c))
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - (share(c) / n) * F.log2(share(c) / n)))
    return pages.withColumns(
        {
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "n_chars": n,
            "host_chars": F.char_length("host").cast("double"),
            "path_chars": F.char_length("path").cast("double"),
            "n_labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "digit_ratio": F.char_length(F.regexp_replace(u, "[^0-9]", "")) / n,
            "hyphens": (F.char_length("host") - F.char_length(F.translate("host", "-", ""))).cast("double"),
            "entropy": entropy,
            "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "n_marks": F.char_length(F.regexp_replace(u, r"[\p{L}\p{N}]", "")).cast("double"),
            "has_fragment": F.contains(u, F.lit("#")).cast("double"),
            "secure": F.startswith(u, F.lit("https:")).cast("double"),
        }
    )


def with_suffix(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Add the suffix statistics; a suffix without labels has the overall rate and no share."""
    overall = F.sum("blocked") / F.greatest(F.sum("n"), F.lit(1))
    top = rates.agg(F.coalesce(overall, F.lit(0.5)).alias("r"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    stats = rates.select("suffix", ((F.col("blocked") + PRIOR * top.select("r").scalar()) / (F.col("n") + PRIOR)).alias("suffix_rate"), (F.col("n") / top.select("t").scalar()).alias("suffix_share"))
    return rows.join(stats, "suffix", "left").withColumns({"suffix_rate": F.coalesce("suffix_rate", top.select("r").scalar()), "suffix_share": F.coalesce("suffix_share", F.lit(0.0))})


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (the trees' probability of block; null where they weren't trained)."""
    host, path = parts(F.col("url"))
    rule, says = decide(rules)
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "says": says})
    rows = cut(features(rows))
    known = rows.where("says is not null").withColumn("label", (F.col("says") == "block").cast("double"))
    rates = cut(known.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")))
    classes = known.agg(F.min("label"), F.max("label")).first()
    plain = ["page_id", "host", "path", "rule"]
    if classes[0] is None or classes[0] == classes[1]:
        return rows.select(*plain, F.coalesce("says", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    to_vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    train = cut(to_vector.transform(with_suffix(sample_rows(known, train_rows, "url", "page_id"), rates)).select("vector", "label"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, minInstancesPerNode=5, seed=seed).fit(train)
    scored = trees.transform(to_vector.transform(with_suffix(rows, rates)))
    method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(*plain, F.coalesce("says", method).alias("verdict"), vector_to_array("probability")[1].alias("block_score"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
