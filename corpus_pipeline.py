"""Training-corpus pipeline over documents: five operators in turn, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns the next docs: the columns of documents, but for the last stage.
Extra columns of documents stay as they are in the first four stages, whatever their names; an empty table stays empty;
texts are read whole, however long.

1. toxicity: documents whose toxicity score reaches 0.7 go. Null and empty texts have the base score and stay; repeated
   rows are judged alike; without labels of both classes all stay.
2. near_dedup: of each group of near copies the document of the smallest id stays. Rows of one id are judged by their
   own texts; rows repeated as a whole are one; null and blank texts are copies of one another; rows without an id go
   where a document with an id is alike, and stay otherwise.
3. substring_dedup: words of passages that stand earlier are cut from the text; n_chars follows where a text changed.
   Null and short texts and rows without an id stay as they are.
4. decontamination: documents that hold a window of a benchmark item go. Null texts and those without words stay.
5. byte_bpe: doc_id, n_tokens, token ids of each text, and the text decoded from them; null and empty texts give no ids
   and an empty text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import byte_bpe, decontaminate, simhash, substring_dedup, toxicity
from hirelake.llm.common import free_name, stored, table


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but doc_id and text renamed, so that no operator's column meets one of theirs; and the new
    name of each column."""
    names = {c: c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(own).alias(c) for c, own in names.items()))


#: Rows of an Arrow batch, at most: whole texts, of which some are very long.
ROWS = 500
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches have ROWS rows at most.

    The pipeline owns its session: a stage's result is lazy, so the setting has to hold when it is read, and stays.
    """

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= ROWS:
            spark.conf.set(name, str(ROWS))
        return stage(spark, docs, sf_dir)

    return run_bounded


@bounded
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _plain(docs)
    model = toxicity.train(plain, table(spark, sf_dir, "labels"))
    return _back(toxicity.score_toxicity(plain, model).where(F.col("toxic_score") < toxicity.PREDICT_AT), names)


@bounded
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = free_name("mark", docs)
    marked = docs.withColumn(mark, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    found = simhash.near_duplicates(marked.select("doc_id", "text", mark), keep=(mark,))
    goes = F.coalesce(F.col("component_id") < F.col("doc_id"), F.col("component_id").isNotNull() & F.col("doc_id").isNull())
    told = found.groupBy("doc_id", mark).agg(F.max(goes).alias("goes"), F.count("*").alias("n")).where("goes or n > 1")
    own = told.select(F.col("doc_id").alias("own_id"), F.col(mark).alias("own_mark"), "goes")
    of = lambda rows: marked["doc_id"].eqNullSafe(rows["own_id"]) & (marked[mark] == rows["own_mark"])
    single = marked.join(own, of(own), "left_anti")
    repeats = own.where("not goes")
    return single.unionByName(marked.join(repeats, of(repeats), "left_semi").dropDuplicates()).select(docs.columns)


@bounded
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _plain(docs)
    found = substring_dedup.deduplicate(plain)
    if "n_chars" in docs.columns:
        kind, chars = docs.schema["n_chars"].dataType, names["n_chars"]
        found = found.withColumn(chars, F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(kind)).otherwise(F.col(chars)))
    return _back(found.withColumn("text", F.col("kept_text")), names)


@bounded
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _plain(docs)
    return _back(decontaminate.find_leaks(plain, table(spark, sf_dir, "benchmark")).where("n_hit = 0"), names)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator keeps its result as Parquet itself."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", byte_bpe_stage),
]

#: Trained classifiers, hashes and merges have no SQL form; tests/llm/test_pipeline.py holds stages 2 to 5 and run()
#: against brute force, and stage 1 against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
