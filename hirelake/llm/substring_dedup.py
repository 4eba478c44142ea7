"""Exact substring deduplication with difference-cover anchors.

A window is WINDOW consecutive words. Anchors of ANCHOR words are hashed only where a position modulo PERIOD lies in
COVER, a perfect difference set: two equal windows, however they are placed, share an offset at which both hold an
anchor. Anchors that occur once in the corpus are told to their documents; only windows that hold another one are
candidates. Candidates are extended to their whole width, hashed to 128 bits, and each distinct window's first place
(document, position) is told to its document: the candidates that aren't first repeat an earlier window, and their
words go. A document that copies an earlier one whole needs no hashes. Hashes are reduced before and during the shuffle, so a passage of any number of copies is one small row.

The documents are numbered in the order of their ids, whatever the ids' type, and a place is one long number: the
document's number and the position. A document has a number for every 2^UNIT_BITS words it may hold, so no text is too
long and no id too large.

Cases: null and blank texts have no words; texts under WINDOW words lose none; documents with a null id are left
alone; rows that share an id are judged in that id's place, and a row repeated as a whole keeps what its first one
keeps; an empty table gives no rows; extra columns stay as they are, but n_words, n_removed and kept_text are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, look_up, table

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
UNIT_BITS = 24
#: Words that are hashed at once in a worker.
CHUNK = 400_000
_MASK = (1 << 64) - 1


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(words: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of the width values from each position on; the last width - 1 positions are missing."""
    n = len(words) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for t in range(width if n > 0 else 0):
        h *= np.uint64(factor)
        h += words[t : t + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]


def chunks(frame: pd.DataFrame) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """(row, first word, number of words) of each row with a window, and the words' hashes, some rows at a time."""
    rows, words = [], []
    for row in frame.itertuples(index=False):
        w = [] if row.is_copy is True or pd.isna(row.base) else split(row.text)
        if len(w) >= WINDOW:
            rows.append((row, len(words), len(w)))
            words += w
        if len(words) >= CHUNK:
            yield rows, word_hashes(words)
            rows, words = [], []
    if rows:
        yield rows, word_hashes(words)


def anchor_places(n: int) -> np.ndarray:
    """Anchors' positions in a text of n words."""
    at = np.arange(n - ANCHOR + 1)
    return at[np.isin(at % PERIOD, COVER)]


def anchors(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for rows, words in chunks(frame):
            h = rolling(words, ANCHOR, 0x100000001B3 | 1)
            places = [anchor_places(n) for _, _, n in rows]
            at = np.concatenate([(int(r.base) << bits) + p for (r, _, _), p in zip(rows, places, strict=True)])
            own = np.concatenate([first + p for (_, first, _), p in zip(rows, places, strict=True)])
            yield pd.DataFrame({"h": h[own].view(np.int64), "at": at})


def candidates(n: int, single: np.ndarray | None) -> np.ndarray:
    """Starts of the windows that hold an anchor which isn't single, in a text of n words."""
    held = np.zeros(n + 1, np.int32)
    held[anchor_places(n)] = 1
    if single is not None:
        held[np.asarray(single, dtype=np.int64)] = 0
    total = np.concatenate([[0], np.cumsum(held)])
    starts = np.arange(n - WINDOW + 1)
    return starts[total[starts + PERIOD] > total[starts]]


def candidate_windows(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for rows, words in chunks(frame):
            places = [candidates(n, r.single) for r, _, n in rows]
            own = np.concatenate([first + p for (_, first, _), p in zip(rows, places, strict=True)])
            if len(own):
                at = np.concatenate([(int(r.base) << bits) + p for (r, _, _), p in zip(rows, places, strict=True)])
                yield pd.DataFrame({"h": rolling(words, WINDOW, 0x5851F42D4C957F2D)[own].view(np.int64), "g": rolling(words, WINDOW, 0xD1342543DE82EF95)[own].view(np.int64), "at": at})


def keep(text: str | None, is_copy: bool | None, single: np.ndarray | None, first: np.ndarray | None) -> tuple[int, int, str]:
    """Number of words, number removed, and the text left: as it was if none goes, else words joined by one space."""
    w = split(text)
    n = len(w)
    if n < WINDOW:
        return n, 0, text
    if is_copy is True:
        return n, n, ""
    gone = candidates(n, single)
    if first is not None:
        gone = np.setdiff1d(gone, first, assume_unique=False)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + WINDOW, -1)
    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return (n, 0, text) if len(left) == n else (n, n - len(left), b" ".join([w[i] for i in left]).decode("utf-8", "surrogatepass"))


def copies(marks: DataFrame) -> DataFrame:
    """(doc_id, n_copies) of marks(doc_id, mark): rows of each id whose whole text stands in a row of a smaller id; all
    their windows start earlier."""
    least = marks.groupBy("mark").agg(F.min("doc_id").alias("own"), F.count("*").alias("n")).where("n > 1").select("mark", "own")
    return look_up(marks.select("doc_id", "mark"), least, "mark", "inner").where("doc_id > own").groupBy("doc_id").agg(F.count("*").alias("n_copies"))


def number(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, base, units, is_copy) of each id, numbered in order: base is its first number, units how many it has.

    Ids are dealt out by ranges; a range is numbered in its task, behind the sum of the ranges before it.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    marks = cut(docs.where("doc_id is not null").select("doc_id", F.md5(text).alias("mark"), F.octet_length(text).alias("size")))
    sizes = marks.groupBy("doc_id").agg(F.max("size").alias("size"), F.count("*").alias("n_rows"))
    units = (1 + F.floor(F.col("size") / (2 << bits))).cast("long")
    facts = sizes.join(copies(marks), "doc_id", "left").select("doc_id", units.alias("units"), F.coalesce(F.col("n_copies") == F.col("n_rows"), F.lit(False)).alias("is_copy"))
    ranged = cut(facts.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("part").agg(F.sum("units").alias("n")).orderBy("part").collect():  # a row for each range
        offsets.append((r["part"], before))
        before += r["n"]

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for b in batches:
            ends = done + b["units"].cumsum()
            yield b.assign(base=ends - b["units"])
            done = int(ends.iloc[-1]) if len(b) else done

    local = ranged.sortWithinPartitions("doc_id").mapInPandas(running, ranged.withColumn("base", F.lit(0).cast("long")).schema)
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, start long"))
    return cut(local.join(starts, "part").select("doc_id", (F.col("base") + F.col("start")).alias("base"), "units", "is_copy"))


def _by_doc(places: DataFrame, numbers: DataFrame, extra: DataFrame | None, name: str, bits: int) -> DataFrame:
    """The places of each document as one array; a document has no more of them than words."""
    unit = F.shiftright("at", bits).alias("unit")
    if extra is None:
        own = places.select(unit.alias("base"), F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("p"))
    else:
        own = places.select("at", unit).join(extra, "unit", "left").select("at", F.coalesce("base", "unit").alias("base")).select("base", (F.col("at") - F.shiftleft("base", bits)).cast("int").alias("p"))
    return own.groupBy("base").agg(F.collect_list("p").alias(name)).join(numbers.select("base", "doc_id"), "base").select("doc_id", name)


def deduplicate(docs: DataFrame, bits: int = UNIT_BITS) -> DataFrame:
    """docs (doc_id, text and any others) with n_words, n_removed and kept_text.

    All passes read the documents from one shuffle by id, so that places meet their texts without another.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    rest = {c: f"other{i}" for i, c in enumerate(columns) if c not in ("doc_id", "text")}  # no names of ours
    slim = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(name) for c, name in rest.items()))
    numbers = number(slim, bits)
    longer = numbers.where("units > 1")
    extra = None if longer.isEmpty() else longer.select("base", F.explode(F.sequence(F.col("base") + 1, F.col("base") + F.col("units") - 1)).alias("unit"))
    marked = slim.join(numbers.select("doc_id", "base", "is_copy"), "doc_id", "left")
    once = marked.mapInPandas(partial(anchors, bits=bits), "h long, at long").groupBy("h").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n = 1")
    with_single = marked.join(_by_doc(once, numbers, extra, "single", bits), "doc_id", "left")
    first = with_single.mapInPandas(partial(candidate_windows, bits=bits), "h long, g long, at long").groupBy("h", "g").agg(F.min("at").alias("at"))
    found = with_single.join(_by_doc(first, numbers, extra, "first", bits), "doc_id", "left")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def apply(base: pd.Series, texts: pd.Series, copy: pd.Series, single: pd.Series, first: pd.Series) -> pd.DataFrame:
        rows = [(len(split(t)), 0, t) if pd.isna(i) else keep(t, c, s, f) for i, t, c, s, f in zip(base, texts, copy, single, first, strict=True)]
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    out = found.select("doc_id", "text", *rest.values(), apply("base", "text", "is_copy", "single", "first").alias("kept"))
    return out.select(*(F.col(rest.get(c, c)).alias(c) for c in columns), "kept.*")


def _digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(b" ".join(split(t))).hexdigest())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.pandas_udf(_digest, "string")("kept_text").alias("kept_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM t, unnest(range(1, len(w) - 18)) r(i) WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM x),
g AS (SELECT DISTINCT doc_id, p FROM k, unnest(range(i, i + 20)) r(p) WHERE rn > 1),
a AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN a USING (doc_id)
"""
