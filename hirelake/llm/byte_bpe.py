"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over the byte arrays of distinct words.

Pieces are cut by the tokenizer's pattern. The rank file becomes a literal table of mergeable pairs. Each distinct word
starts as an array of byte tokens; an ``aggregate`` merges the pair of least rank, the leftmost first, until none is
left. The most frequent pieces of the corpus (FREQUENT at most) are folded once and broadcast; every other distinct
piece of a document is folded in that document's row. A piece over LONG_PIECE bytes is first cut between bytes that
stand side by side in no token, where no merge can cross. Decoding concatenates the tokens' bytes.

Cases: null and empty texts give no tokens and decode to nothing; repeated rows get equal results; an empty table gives
no rows; extra columns stay, but columns ids and decoded are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, cut, most_frequent, short_plans, stored, table

RANK_FILE = "byte_bpe_50k.tiktoken"
FREQUENT = 500_000
#: Words of more tokens than this merge all places of a pair in one step; pieces of more bytes than this are cut first.
LONG, LONG_PIECE = 48, 200
#: Above all ranks: no merge.
NONE = 65_535
#: Factor, shift and size of the two hashes of the pair table.
BUCKET_HASH, SLOT_HASH = (1_000_003, 11, 60_013), (998_244_353, 13, 200_003)
#: Rows that a worker encodes at once.
ROWS = 500


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _mix(key, factor: int, shift: int, size: int):
    """Hash of a pair's key (32 bits) in 63-bit arithmetic, for ints and arrays."""
    return (key * factor >> shift) % size


def pair_table(tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Perfect hash of the mergeable pairs: a shift for each bucket, and slots that hold key << 16 | merged, or -1.

    The key of a pair is a << 16 | b. All keys of a bucket are shifted together to slots that are free, the fullest
    buckets first, so a look-up reads one shift and one slot.
    """
    rank = {t: i for i, t in enumerate(tokens) if t}
    buckets: dict[int, list[tuple[int, int]]] = {}
    for token, merged in rank.items():
        for k in range(1, len(token)):
            if (a := rank.get(token[:k])) is not None and (b := rank.get(token[k:])) is not None:
                buckets.setdefault(_mix(a << 16 | b, *BUCKET_HASH), []).append((a << 16 | b, merged))
    shifts, slots, rng = [0] * BUCKET_HASH[2], [-1] * SLOT_HASH[2], random.Random(1)
    for bucket, pairs in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        home = [_mix(key, *SLOT_HASH) for key, _ in pairs]
        if len(set(home)) < len(home):
            raise ValueError("two pairs of one bucket meet; choose other hash factors")
        shift = 0
        while any(slots[(h + shift) % len(slots)] >= 0 for h in home):
            shift = rng.randrange(len(slots))
        shifts[bucket] = shift
        for h, (key, merged) in zip(home, pairs, strict=True):
            slots[(h + shift) % len(slots)] = key << 16 | merged
    return shifts, slots


def numbers(values: str, kind: str) -> Column:
    """Array literal of numbers joined by commas; the split and cast of one string fold to it."""
    return F.split(F.lit(values), ",").cast(f"array<{kind}>")


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def merge_fold(ids: Column, shifts: Column, slots: Column) -> Column:
    """Array of byte tokens to array of merged tokens; the plan holds each table once, bound to a variable."""
    return _let(F.struct(shifts.alias("shifts"), slots.alias("slots")), lambda t: _merge_fold(ids, t["shifts"], t["slots"]))


def _merge_fold(ids: Column, shifts: Column, slots: Column) -> Column:
    """Fold over the array of tokens.

    An element of the folded array is rank << 16 | token, with the rank at which the token merges with its successor
    (NONE: never), so the least element is the next merge, and only it and its left neighbour get new ranks.
    """
    token = lambda e: e.bitwiseAND(F.lit(65535).cast("long"))

    def element(a: Column, b: Column) -> Column:
        key = F.shiftleft(a, 16) + b
        mix = lambda factor, shift, size: F.pmod(F.shiftright(key * F.lit(factor).cast("long"), shift), F.lit(size).cast("long")).cast("int")
        slot = F.pmod(mix(*SLOT_HASH) + F.get(shifts, mix(*BUCKET_HASH)), F.lit(SLOT_HASH[2]))
        rank = _let(F.get(slots, slot), lambda e: F.when(F.shiftright(e, 16) == key, token(e)).otherwise(F.lit(NONE).cast("long")))
        return F.shiftleft(F.when(b.isNull(), F.lit(NONE).cast("long")).otherwise(rank), 16) + a

    def elements(p: Column) -> Column:
        return F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), element)

    def one(s: Column, m: Column, i: Column) -> Column:
        merged, rest = F.shiftright(m, 16), F.slice(s, i + 2, F.size(s))
        here = element(merged, token(F.get(s, i + 1)))
        return F.when(i == 1, F.concat(F.array(here), rest)).otherwise(F.concat(F.slice(s, F.lit(1), i - 2), F.array(element(token(F.get(s, i - 2)), merged), here), rest))

    def every(s: Column, m: Column) -> Column:
        hits = F.array_join(F.transform(s, lambda x: F.when(x == m, "1").otherwise("0")), "")
        chosen = F.split(F.replace(hits, F.lit("11"), F.lit("10")), "")  # of touching places every other one
        merged = lambda c: F.transform(s, lambda x, i: F.when(F.get(c, i) == "1", F.shiftright(m, 16)).when((i > 0) & (F.get(c, i - 1) == "1"), F.lit(-1).cast("long")).otherwise(token(x)))
        return _let(F.filter(_let(chosen, merged), lambda x: x >= 0), elements)

    def step(state: Column) -> Column:
        """state: the elements, and the least of them; once no merge is left, a step costs nothing."""
        place = lambda s, m: _let(F.array_position(s, m).cast("int"), lambda i: one(s, m, i))
        merge = lambda s, m: F.when(F.size(s) > LONG, every(s, m)).otherwise(place(s, m))
        return F.when(F.shiftright(state["m"], 16) == NONE, state).otherwise(_let(merge(state["s"], state["m"]), with_least))

    def with_least(s: Column) -> Column:
        return F.struct(s.alias("s"), F.array_min(s).alias("m"))

    start = _let(elements(ids.cast("array<bigint>")), with_least)
    folded = F.aggregate(F.sequence(F.lit(1), F.size(ids) - 1), start, lambda s, _: step(s), lambda s: F.transform(s["s"], lambda e: token(e).cast("int")))
    return F.when(F.size(ids) < 2, ids).otherwise(folded)


def _ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@lru_cache(maxsize=1)
def tables(path: str) -> tuple[list[bytes], str, str]:
    """Token bytes by rank, and the pair table's shifts and slots as text; kept, since building them takes the driver's memory."""
    tokens = read_ranks(path)
    shifts, slots = pair_table(tokens)
    return tokens, ",".join(map(str, shifts)), ",".join(map(str, slots))


class Encoder:
    """Encoder and decoder by the rank file at path. close() frees what decode and encode have broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.shared = spark, []
        self.tokens, shifts, slots = tables(path)
        self.shifts, self.slots = numbers(shifts, "int"), numbers(slots, "bigint")
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.touching = np.zeros((256, 256), bool)  # bytes that stand side by side in a token
        for token in self.tokens:
            b = np.frombuffer(token, np.uint8)
            self.touching[b[:-1], b[1:]] = True

    def broadcast(self, value):
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def close(self) -> None:
        while self.shared:
            self.shared.pop().destroy()
        pa.default_memory_pool().release_unused()

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))

    def fold(self, ids: Column) -> Column:
        return merge_fold(ids, self.shifts, self.slots)

    def frequent(self, docs: DataFrame, limit: int = FREQUENT) -> pa.Table:
        """The most frequent of the corpus's repeated pieces and their tokens, limit at most."""
        of_byte = self.of_byte

        @F.pandas_udf("array<int>")
        def start(words: pd.Series) -> pd.Series:
            return words.map(lambda w: of_byte[np.frombuffer(w.encode(), np.uint8)])

        pieces = docs.select(F.explode(self.pieces(F.col("text"))).alias("piece")).where(F.octet_length("piece") <= LONG_PIECE)
        counts = cut(pieces.groupBy("piece").agg(F.count("*").alias("c")).where("c > 1"))
        top = most_frequent(counts, limit, "piece").select("piece").repartition(self.spark.sparkContext.defaultParallelism * 2, "piece")
        started = top.select(F.col("piece").cast("binary").alias("piece"), start("piece").alias("start"))
        with short_plans(self.spark):
            return started.select("piece", self.fold(F.col("start")).alias("ids")).toArrow()

    def encode(self, docs: DataFrame, limit: int = FREQUENT, then=None, schema: T.StructType | None = None) -> DataFrame:
        """docs with the column ids, an array of token ids; or what then, run in the same workers, makes of those rows.

        The result is stored in the shared folder: the pass over the texts runs with batches of ROWS rows, since the
        pieces of 10,000 long texts would fill a worker, and a later pass would run with the session's batches.
        """
        known = self.frequent(docs, limit).combine_chunks()
        words, ids = known.column("piece").combine_chunks(), known.column("ids").combine_chunks()
        names = self.broadcast(words)
        shared = self.broadcast((pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy().astype(np.int32)))
        del known, words, ids
        of_byte, touching, kept = self.of_byte, self.touching, [c for c in docs.columns if c != "ids"]

        def cut_long(values: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            """Values and the number of them in each row, with long pieces in parts."""
            long = np.flatnonzero(pc.binary_length(values).to_numpy(zero_copy_only=False) > LONG_PIECE)
            if not len(long):
                return values, sizes
            parts, sizes, row, at = [], sizes.copy(), np.repeat(np.arange(len(sizes)), sizes), 0
            for i in long:
                b = np.frombuffer(values[i].as_buffer(), np.uint8)
                ends = [0, *(np.flatnonzero(~touching[b[:-1], b[1:]]) + 1).tolist(), len(b)]
                parts += [values.slice(at, i - at), pa.array([b[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())]
                sizes[row[i]] += len(ends) - 2
                at = i + 1
            return pa.concat_arrays([*parts, values.slice(at)]), sizes

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """pieces to codes: the place among the frequent ones, or -1 - k for the row's k-th other distinct piece."""
            words = names.value
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    lists = batch.column("_pieces")
                    values, sizes = cut_long(lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    codes = pc.fill_null(pc.index_in(values, value_set=words), -1).to_numpy().astype(np.int32)
                    miss = np.flatnonzero(codes < 0)
                    rows = np.repeat(np.arange(len(sizes)), sizes)[miss]
                    other = values.take(pa.array(miss)).dictionary_encode()
                    width = len(other.dictionary) + 1
                    keys, back = np.unique(rows * width + other.indices.to_numpy(), return_inverse=True)
                    first = np.searchsorted(keys // width, np.arange(len(sizes) + 1))
                    codes[miss] = -1 - (back - first[rows])
                    own = other.dictionary.take(pa.array(keys % width))
                    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)
                    data = np.frombuffer(own.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(own) else np.zeros(0, np.uint8)
                    starts = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(of_byte[data], pa.int32()))
                    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), starts)], [*kept, "_codes", "_starts"])
                pa.default_memory_pool().release_unused()

        def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths, flat = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    lists, folds = batch.column("_codes"), batch.column("_folded")
                    codes, sizes = lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    mine = folds.flatten()
                    more = pc.list_value_length(mine).to_numpy(zero_copy_only=False).astype(np.int64)
                    tokens = np.concatenate([flat, mine.flatten().to_numpy()])
                    size = np.concatenate([lengths, more])
                    begin = np.cumsum(size) - size
                    first = np.cumsum(n := pc.list_value_length(folds).to_numpy(zero_copy_only=False)) - n
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    place = np.where(codes >= 0, codes, len(lengths) + first[row] - 1 - codes)
                    ids = tokens[_ragged(size[place], begin[place])].astype(np.int32)
                    bounds = np.concatenate([[0], np.cumsum(size[place])])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], [*kept, "ids"])

        own = T.StructType([docs.schema[c] for c in kept])
        cut_up = docs.select(*kept, self.pieces(F.col("text")).alias("_pieces"))
        ints = T.ArrayType(T.IntegerType())
        coded = cut_up.mapInArrow(look_up, T.StructType([*own.fields, T.StructField("_codes", ints), T.StructField("_starts", T.ArrayType(ints))]))
        folded = coded.select(*kept, "_codes", F.transform("_starts", self.fold).alias("_folded"))
        whole = T.StructType([*own.fields, T.StructField("ids", ints)])
        with batch_rows(self.spark, ROWS), short_plans(self.spark):
            return stored(folded.mapInArrow(assemble, whole) if then is None else folded.mapInArrow(lambda batches: then(assemble(batches)), schema))

    def decoder(self, kept: list[str]):
        """Function that adds the column decoded to batches with the columns kept."""
        shared = self.broadcast((np.frombuffer(b"".join(self.tokens), np.uint8), np.array([len(t) for t in self.tokens], np.int64)))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, lengths = shared.value
            begin = np.cumsum(lengths) - lengths
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    lists = batch.column("ids")
                    ids, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    size = lengths[ids]
                    text = data[_ragged(size, begin[ids])]
                    bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(text)])], [*kept, "decoded"])

        return join

    def decode(self, rows: DataFrame) -> DataFrame:
        """rows with the column decoded (binary): the bytes of each row's ids, one after another."""
        kept = [c for c in rows.columns if c != "decoded"]
        return rows.select(*kept).mapInArrow(self.decoder(kept), T.StructType([*(rows.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())]))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        size = pc.list_value_length(ids)
        bounds = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False))]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), ids.flatten().cast(pa.string())), " ")
        sha = lambda values: pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size.cast(pa.int64()), sha(joined), sha(batch.column("decoded"))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (array of token ids) and decoded (bytes)."""
    encoder = Encoder(docs.sparkSession, path or public_tokenizers.path(RANK_FILE))
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    try:
        return encoder.encode(docs.select(*kept), then=encoder.decoder([*kept, "ids"]), schema=schema)
    finally:
        encoder.close()  # the result is stored


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = Encoder(spark, public_tokenizers.path(RANK_FILE))
    decode = encoder.decoder(["doc_id", "ids"])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    try:
        return encoder.encode(docs, then=lambda batches: digests(decode(batches)), schema=schema)
    finally:
        encoder.close()
