"""Benchmark decontamination: Aho-Corasick automaton over normalised windows of the test items.

Text is normalised to lower-case words joined by one space; the automaton holds every window between spaces, so that
matches keep to word bounds. Matched words are mapped back to offsets in the original text.

One automaton holds PART_PAIRS (window, item) pairs; its size in a worker follows from that. A benchmark of more pairs
is dealt over several automata by hash, each of which scans the text in a pass of its own, and the parts' hits are
united for each row; so neither the driver nor a worker ever holds more than one part.

Cases: null and wordless texts and items have no windows and no hits; repeated rows get equal results, repeated items
count once; windows of an item without an id count as hits of no item; an empty benchmark hits nothing; extra columns
stay, but columns of the names n_words, n_hit, items and spans are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, table

WINDOW = 10
#: (window, item) pairs of one automaton, about: 20,000 windows take some 60 MB in a worker.
PART_PAIRS = 20_000
#: Bytes of a normalised text: digits, a-z and all beyond ASCII stay, A-Z turn lower, the rest separates words.
KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: The automaton that a worker built last, by its part's name; tasks of one part follow one another in a worker.
_built: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT).split()


def windows(text: str | None, width: int = WINDOW) -> set[bytes]:
    w = normal_words(text)
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _windows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(x.decode() for x in windows(t)))


def build(pairs: Iterable[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Automaton over Latin-1 views of the windows' bytes: one character a byte, so positions are byte offsets."""
    automaton = ahocorasick.Automaton()
    for window, items in pairs:
        automaton.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, tuple(items)))
    automaton.make_automaton()
    return automaton


def built(name: str, pairs: Iterable[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = build(pairs)
    return _built[name]


def hits(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words of the text, hit words as runs (first, last), and the items found."""
    w = normal_words(text)
    if not w or not len(automaton):
        return len(w), [], []
    found = list(automaton.iter((b" " + b" ".join(w) + b" ").decode("latin-1")))
    if not found:
        return len(w), [], []
    ends = np.cumsum([len(x) + 1 for x in w])  # offset of the space behind each word
    last = np.searchsorted(ends, [x for x, _ in found])
    items = {i for _, (_, own) in found for i in own}
    return len(w), united([(b - n + 1, b) for b, (_, (n, _)) in zip(last.tolist(), found, strict=True)]), sorted(items)


def united(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets (start, end) in the original text of runs of its words."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(KEPT))]
    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    return [(int(at[places[a][0]]) - 1, int(at[places[b][1] - 1])) for a, b in runs]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (window, item) rows; the item is null where its id is."""
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(_windows("text")).alias("window")).distinct()


def _finder(spark: SparkSession, pairs: DataFrame):
    """UDF from a text to its words, hit runs and items, by an automaton of the pairs, which the driver gathers."""
    grouped = pairs.groupBy("window").agg(F.collect_set("item").alias("items"))  # leaves null items out
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast([(r["window"], r["items"]) for r in grouped.collect()])  # one part

    @F.pandas_udf("n_words long, runs array<struct<first:int,last:int>>, items array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = built(name, shared.value)
        for texts in batches:
            rows = [hits(t, own) for t in texts]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "runs": [[{"first": a, "last": b} for a, b in r[1]] for r in rows], "items": [r[2] for r in rows]})

    return find


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS)]))
def _spans(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    own = [united((r["first"], r["last"]) for r in (x if x is not None else ())) for x in runs]
    return pd.DataFrame({"n_hit": [sum(b - a + 1 for a, b in x) for x in own], "spans": [[{"start": a, "end": b} for a, b in offsets(t, x)] for t, x in zip(texts, own, strict=True)]})


def find_leaks(docs: DataFrame, benchmark: DataFrame, part_pairs: int = PART_PAIRS) -> DataFrame:
    """docs with n_words, n_hit, items (ids of the items found) and spans (offsets of hit runs)."""
    spark, docs = docs.sparkSession, docs.drop("n_words", "n_hit", "items", "spans")
    found, row = free_name("found", docs), free_name("row", docs)
    pairs = cut(item_windows(benchmark))
    parts = max(1, -(-pairs.count() // part_pairs))
    finders = [_finder(spark, pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == i)) for i in range(parts)]
    if parts == 1:
        met = docs.withColumn(found, finders[0]("text"))
    else:
        rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        each = [rows.select(row, f("text").alias(found)) for f in finders]
        some = reduce(DataFrame.unionByName, [each[0], *(x.where(F.size(f"{found}.runs") > 0) for x in each[1:])])
        merged = F.struct(F.max(f"{found}.n_words").alias("n_words"), F.flatten(F.collect_list(f"{found}.runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{found}.items")))).alias("items"))
        met = rows.join(some.groupBy(row).agg(merged.alias(found)), row).drop(row)
    span = free_name("span", met)
    spanned = met.withColumn(span, F.when(F.size(f"{found}.runs") > 0, _spans("text", f"{found}.runs")))
    none = F.array().cast(SPANS)
    return spanned.select(*docs.columns, f"{found}.n_words", F.coalesce(f"{span}.n_hit", F.lit(0).cast("long")).alias("n_hit"), f"{found}.items", F.coalesce(f"{span}.spans", none).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM t, sizes, unnest(range(1, len(w) - n + 2)) r(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) r(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
