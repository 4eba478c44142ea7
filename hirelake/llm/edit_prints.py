"""Document fingerprints by a randomised edit embedding.

A walker reads a text while time runs. At each time the embedded string holds the character under the walker, and a
shared random bit of (time, character) tells whether the walker moves on. Equal pieces are embedded alike, and after an
edit two walkers fall into step again, so edits cost differing places in proportion; likeness is the share of places that
agree. A walker of n characters needs some 2 n times; the embedded string ends there, with nothing behind it.

A fingerprint samples SAMPLES times that are the same for all texts of a scale, the least power of two that holds the
embedded string, one hex digit each: 0 behind the end, else a hash of (time, character). Below its middle a scale samples
every second time of the scale before, so fingerprints of different scales compare too. The random bits are a table of
(character class, time modulo PERIOD).

Near classes: fingerprints are linked where their likeness reaches NEAR, and a class is what links connect. The search is
exact. Digits besides 0 come first in a fingerprint, so a pair of n and m >= n of them can be near only if few of the first n
digits differ; cut into blocks of a fixed width, so many that some block agrees whole (`widths`). Fingerprints that share a
block meet in its bucket, at the scale of the larger, and are compared there. A bucket gives a link for each member that its
links connect to an earlier one, so copies don't multiply; the rows of a large bucket are dealt over tiles, and each pair of
tiles is a bucket of its own, so a task holds 2 TILE rows of a bucket or little more. Comparisons of unlike texts that share a block grow with the
square of the different texts, at a few in 100,000 of all pairs for each block.

Cases: null counts as empty; the empty text has no digit but 0, is like itself alone, and shares bands with none; one
character is a text; the longest texts are walked whole; equal texts and so repeated rows have equal fingerprints; rows
without an id come before all others in the order of documents, rows of one id go by hash and text; a single document is
its own next; an empty table gives no rows; columns other than those named are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, cut, look_up, shuffles_removed, stored, table
from .components import components

#: Times sampled of a text.
SAMPLES = 128
#: Likeness from which fingerprints are linked.
NEAR = 0.8
#: Widest block of digits; the scale up to which digits stand at their times, so that all fingerprints compare as they are.
WIDEST, PLAIN_SCALE = 8, SAMPLES.bit_length() - 1
#: Rows of a bucket that are dealt over no tiles; rows of a bucket whose pairs are all compared; pairs compared at once.
TILE, SMALL, PAIRS = 8192, 32, 65_536
#: Character classes and times of the table of random bits, and its seed.
CLASSES, PERIOD, SEED = 256, 1024, 11
#: Values of a digit besides 0.
DIGITS = 15
#: Walkers that make it worth to go in step; characters and documents that a worker walks at once.
LANES, CHARS, TOGETHER = 24, 8_000_000, 4000
#: Rows of an Arrow batch: whole texts.
ROWS = 500
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=1)
def _steps() -> bytes:
    """Times that a walker spends on a character of a class if it comes at a time: until the first bit that is set."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    at = np.where(bits, np.arange(PERIOD), PERIOD)
    following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    return (following - np.arange(PERIOD) + 1).astype(np.uint8).tobytes()  # runs of 255 unset bits don't occur


@lru_cache(maxsize=64)
def sample_times(scale: int) -> np.ndarray:
    """The times sampled of embedded strings of 2^scale times, rising; all where there are SAMPLES at most."""
    if 1 << scale <= SAMPLES:
        return np.arange(1 << scale)
    half = 1 << (scale - 1)
    behind = np.random.default_rng((SEED, scale)).choice(half, SAMPLES // 2, replace=False) + half
    return np.concatenate([sample_times(scale - 1)[::2], np.sort(behind)])


def lifted(digits: np.ndarray, scale: int, to: int) -> np.ndarray:
    """The digits that a fingerprint of a smaller scale has at the times of a larger one."""
    for s in range(scale, to):
        if 1 << s >= SAMPLES:
            digits = np.concatenate([digits[::2], np.zeros(SAMPLES // 2, digits.dtype)])
    return digits


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rows(chars: np.ndarray) -> np.ndarray:
    """Where the table of steps begins for each character."""
    return ((chars.astype(np.uint64) * np.uint64(MIX[0]) >> np.uint64(40)) % np.uint64(CLASSES) * np.uint64(PERIOD)).astype(np.int64)


def walk_all(texts: list[np.ndarray], starts: list[int] | None = None) -> list[np.ndarray]:
    """For each text the time at which its walker comes to each character, and the time at which it leaves the last.

    The walkers go in step, the longest text first, as long as LANES of them walk; the few that remain go alone.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes + 1)
    own = (ends - sizes - 1)[order]  # where the times of each walker begin, in its order
    times, rows = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64), np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    for at, text in zip((ends - sizes - 1).tolist(), texts, strict=True):
        rows[at : at + len(text)] = _rows(text)
    now = np.array(starts if starts is not None else [0] * len(texts), np.int64)[order]
    times[own] = now
    steps, mask, falling = np.frombuffer(_steps(), np.uint8), PERIOD - 1, sizes[order]
    alive, place, turn = int((falling > 0).sum()), own.copy(), 0
    while alive >= LANES:
        until = int(falling[alive - 1])  # nobody leaves before
        t, p = now[:alive], place[:alive]
        for _ in range(until - turn):
            t += steps[rows[p] + (t & mask)]
            p += 1
            times[p] = t
        turn, alive = until, int((falling > until).sum())
    plain = _steps()
    for k in range(alive):
        at, end = int(place[k]), int(own[k] + falling[k])
        times[at : end + 1] = np.fromiter(accumulate(rows[at:end].tolist(), lambda t, row: t + plain[row + (t & mask)], initial=int(now[k])), np.int64, end + 1 - at)
    return [times[end - size - 1 : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def sample(chars: np.ndarray, times: np.ndarray) -> tuple[int, np.ndarray]:
    """(scale, SAMPLES digits) of a walked text."""
    scale = int(times[-1] - 1).bit_length() if len(chars) else 0
    at = sample_times(scale)
    place = np.searchsorted(times, at, "right") - 1
    inside = place < len(chars)
    digits = np.zeros(SAMPLES, np.uint8)
    seen = chars[place[inside]].astype(np.uint64) * np.uint64(MIX[1]) + at[inside].astype(np.uint64) * np.uint64(MIX[2])
    digits[np.flatnonzero(inside)] = 1 + ((seen ^ seen >> np.uint64(29)) * np.uint64(MIX[0]) >> np.uint64(40)) % np.uint64(DIGITS)
    return scale, digits


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of times at which two embedded strings agree, less what chance agrees; times behind both ends don't count."""
    to = max(a[0], b[0])
    x, y = lifted(a[1], a[0], to), lifted(b[1], b[0], to)
    there = (x > 0) | (y > 0)
    if not there.any():
        return 1.0
    share = float((x == y)[there].mean())
    return max(0.0, (share - 1 / DIGITS) / (1 - 1 / DIGITS))


def written(scale: int, digits: np.ndarray) -> str:
    """Two hex digits of the scale, then the digits."""
    return f"{scale:02x}" + digits.tobytes().hex()[1::2]


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return int(fingerprint[:2], 16), np.stack([packed >> 4, packed & 15], axis=1).ravel()


def most_differing(n: int, near: float) -> int:
    """Digits of n that may differ, at most, where the likeness is near or more."""
    return int(n * (1 - near) * (1 - 1 / DIGITS) + 1e-6)


@lru_cache(maxsize=4096)
def widths(n: int, near: float, least: int = 1) -> tuple[int, ...]:
    """Widths of the blocks for a fingerprint of n digits besides 0, one or two: those of all numbers m of digits, least or
    more, that a near fingerprint with no fewer digits may have. The width for m is the widest that leaves more whole blocks in the
    shorter fingerprint of any near pair than digits that differ in them, beside the digits that it lacks."""
    lacking = lambda m: range(max(m - most_differing(m, near), 1), m + 1)
    fits = lambda w, m: all(k // w > most_differing(m, near) - (m - k) for k in lacking(m))
    partners = (m for m in range(max(n, least), SAMPLES + 1) if n in lacking(m))
    return tuple(sorted({next(w for w in range(WIDEST, 0, -1) if w == 1 or fits(w, m)) for m in partners}))


def block_keys(scale: int, digits: np.ndarray, near: float) -> list[int]:
    """An exact number for each block of a fingerprint, with its scale, width and place: at the own scale, and at larger
    ones as long as it may be near a text of theirs, half of whose digits at least lie below the scale's middle."""
    out: list[int] = []
    at, n, least = max(scale, PLAIN_SCALE), int(np.count_nonzero(digits)), 1
    while n and n >= least - most_differing(least, near):
        for w in widths(n, near, least):
            blocks = digits[: n // w * w].reshape(-1, w).astype(np.int64) @ (1 << 4 * np.arange(w))
            out += (((at << 11 | w << 7) + np.arange(len(blocks)) << 32) + blocks).tolist()
        digits, at, least = lifted(digits, at, at + 1), at + 1, SAMPLES // 2
        n = int(np.count_nonzero(digits))
    return out


class Bucketed:
    """Rows (key, tile, node, print) of buckets, sorted by key and tile, and the links within each bucket."""

    def __init__(self, rows: pd.DataFrame, near: float, small: int):
        self.near, self.small, self.nodes = near, small, rows["node"]
        packed = np.frombuffer(b"".join(rows["print"]), np.uint8).reshape(len(rows), -1)
        scale, at = np.maximum(packed[:, 0], PLAIN_SCALE), rows["key"].to_numpy() >> 43
        self.digits = np.stack([packed[:, 1:] >> 4, packed[:, 1:] & 15], axis=2).reshape(len(rows), -1)
        self.own = scale == at  # at least one of a pair is at its own scale; others meet at a smaller one
        while (low := scale < at).any():
            self.digits[low] = np.hstack([self.digits[low, ::2], np.zeros((low.sum(), SAMPLES // 2), np.uint8)])
            scale = scale + low
        self.n = np.count_nonzero(self.digits, axis=1)
        other = (rows["key"].to_numpy()[1:] != rows["key"].to_numpy()[:-1]) | (rows["tile"].to_numpy()[1:] != rows["tile"].to_numpy()[:-1])
        self.starts = np.append(0, np.flatnonzero(other) + 1)
        self.sizes = np.diff(np.append(self.starts, len(rows)))

    def _near(self, agree: np.ndarray, there: np.ndarray) -> np.ndarray:
        return (agree / there - 1 / DIGITS) / (1 - 1 / DIGITS) >= self.near

    def _small(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All near pairs of the buckets of SMALL rows at most."""
        for size in range(2, self.small + 1):
            starts = self.starts[self.sizes == size]
            x, y = np.triu_indices(size, 1)
            for k in range(0, len(starts), PAIRS // len(x) + 1):
                first = starts[k : k + PAIRS // len(x) + 1, None]
                i, j = (first + x).ravel(), (first + y).ravel()
                may = self.own[i] | self.own[j]
                i, j = i[may], j[may]
                a = self.digits[i]
                hit = self._near(np.count_nonzero((a == self.digits[j]) & (a > 0), axis=1), np.maximum(self.n[i], self.n[j]))
                yield i[hit], j[hit]

    def _large(self, first: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links from a row to all that near pairs connect with it: each row of a bucket meets those not yet reached."""
        rest = np.arange(first, first + size)
        digits = self.digits[rest]
        while len(rest) > 1:
            root, waiting, rest, digits = rest[0], [rest[0]], rest[1:], digits[1:]
            while waiting and len(rest):
                x = waiting.pop()
                agree = np.count_nonzero((digits == self.digits[x]) & (digits > 0), axis=1)
                hit = self._near(agree, np.maximum(self.n[rest], self.n[x])) & (self.own[rest] | self.own[x])
                if hit.any():
                    yield rest[hit], np.full(hit.sum(), root)
                    waiting += rest[hit].tolist()
                    rest, digits = rest[~hit], digits[~hit]

    def links(self) -> pd.DataFrame:
        """(a, b): each row that is linked to earlier ones of its bucket, and the first that it is connected to."""
        found = list(self._small())
        for k in np.flatnonzero(self.sizes > self.small):
            found += self._large(int(self.starts[k]), int(self.sizes[k]))
        i, j = (np.concatenate([np.empty(0, np.int64), *(f[side] for f in found)]) for side in (0, 1))
        least = np.arange(len(self.n))
        while (least[i] != least[j]).any():
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            least = least[least]
        linked = np.flatnonzero(least != np.arange(len(least)))
        return pd.DataFrame({"a": self.nodes.iloc[linked].array, "b": self.nodes.iloc[least[linked]].array})


def prints_of(texts: list[str | None]) -> list[str]:
    """The written fingerprint of each text."""
    chars = [codes(t or "") for t in texts]
    return [written(*sample(c, t)) for c, t in zip(chars, walk_all(chars), strict=True)]


def similarity(a: str, b: str) -> float:
    """Likeness of two written fingerprints, 0 to 1; 1 for equal ones."""
    return 1.0 if a == b else likeness(read(a), read(b))


# ---- tables


@F.pandas_udf(T.StringType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([p for part in _parts(texts.tolist(), lambda t: len(t or "")) for p in prints_of(part)], dtype=object)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""
    return docs.select("doc_id", _fingerprints("text").alias("fingerprint"))


def near_links(distinct: DataFrame, near: float) -> DataFrame:
    """Distinct links (a, b) that connect all nodes of distinct(fingerprint, node) whose likeness is near or more, and no others."""
    kind, small = distinct.schema["node"].dataType.simpleString(), SMALL

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(prints: pd.Series) -> pd.Series:
        return prints.map(lambda p: block_keys(*read(p), near))

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last bucket, which may go on in the next frame
        for frame in frames:
            if held:
                goes_on = (frame["key"] == held[0]["key"].iloc[0]) & (frame["tile"] == held[0]["tile"].iloc[0])
                if goes_on.all():
                    held.append(frame)
                    continue
            whole = pd.concat([*held, frame])
            last = (whole["key"] == whole["key"].iloc[-1]) & (whole["tile"] == whole["tile"].iloc[-1])
            held = [whole[last]]
            if not last.all():
                yield Bucketed(whole[~last], near, small).links()
        if held:
            yield Bucketed(pd.concat(held), near, small).links()

    rows = distinct.select("node", F.unhex("fingerprint").alias("print"), F.explode(keys("fingerprint")).alias("key"))
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).alias("tiles")))
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(own, t) * F.col("tiles") + F.greatest(own, t))
    tiled = rows.join(F.broadcast(large), "key", "left")  # a row for TILE rows at most
    dealt = tiled.select("key", "node", "print", F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("long")))).alias("tile"))
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInPandas(links, f"a {kind}, b {kind}").distinct()


def near_classes(prints: DataFrame, near: float = NEAR) -> DataFrame:
    """The rows of prints(fingerprint, doc_id, ...) with class_id, the least doc_id that links reach; null where none has an id."""
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).where("node is not null"))
    classes = distinct.join(components(near_links(distinct, near)), "node", "left").select("fingerprint", F.coalesce("component", "node").alias("class_id"))
    return look_up(prints, classes, "fingerprint").select(*prints.columns, "class_id")


def _parts(rows: Iterable, size: Callable[[object], int]) -> Iterator[list]:
    """The rows in turn, in lists of TOGETHER at most that end once they hold CHARS characters."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= CHARS or len(part) >= TOGETHER:
            yield part
            part, held = [], 0
    if part:
        yield part


TOLD = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGES = f"{TOLD}, part int, head string, tail string"


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _edited(ids: list, texts: list[str], chars: list[np.ndarray], times: list[np.ndarray]) -> list[dict]:
    """A row for each document but the last: its last half gives way to the first as many characters of the next one."""
    found = [sample(c, t) for c, t in zip(chars, times, strict=True)]
    half = [len(c) // 2 for c in chars[:-1]]
    keep = [len(c) - h for c, h in zip(chars, half, strict=False)]
    new = [after[:h] for after, h in zip(chars[1:], half, strict=True)]
    ends = walk_all(new, [int(t[k]) for t, k in zip(times, keep, strict=False)])
    rows = []
    for i, k in enumerate(keep):
        own, edited = found[i], sample(np.concatenate([chars[i][:k], new[i]]), np.concatenate([times[i][:k], ends[i]]))
        digest = hashlib.sha256((texts[i][:k] + texts[i + 1][: half[i]]).encode("utf-8", "surrogatepass")).hexdigest()
        rows.append({"doc_id": ids[i], "n_chars": len(chars[i]), "edited_sha256": digest, "fingerprint": written(*own), "edited_fingerprint": written(*edited), "near_edited": likeness(own, edited), "near_next": likeness(own, found[i + 1])})
    return rows


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition in order; the first tells its text as head, the last, whose next is elsewhere, as tail."""
    number, before, head = TaskContext.get().partitionId(), None, None
    docs = ((i, t or "") for f in frames for i, t in zip(f["doc_id"], f["text"], strict=True))
    for part in _parts(docs, lambda d: len(d[1])):
        ids, texts = [d[0] for d in part], [d[1] for d in part]
        chars = [codes(t) for t in texts]
        times = walk_all(chars)
        if before:
            ids, texts, chars, times = ([b, *own] for b, own in zip(before, (ids, texts, chars, times), strict=True))
        rows = _edited(ids, texts, chars, times)
        if head is None:
            head = texts[0]
            rows = [r | {"head": head} if at == 0 else r for at, r in enumerate(rows)]
            told = bool(rows)
        before = ids[-1], texts[-1], chars[-1].copy(), times[-1].copy()
        yield _frame([r | {"part": number} for r in rows], EDGES)
    if before:
        yield _frame([{"doc_id": before[0], "n_chars": len(before[2]), "part": number, "head": None if told else head, "tail": before[1]}], EDGES)


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in frame.itertuples():
            texts = [at.tail, at.head]
            chars = [codes(t) for t in texts]
            yield _frame(_edited([at.doc_id, None], texts, chars, walk_all(chars)), TOLD)


def with_edits(docs: DataFrame) -> DataFrame:
    """A row for each document: n_chars, its fingerprint, that of its text with the last half replaced by the start of the
    next document's, the SHA-256 of that text, and the fingerprint's likeness to it and to the next document's.

    One shuffle deals the texts by ranges of (doc_id, hash) and a worker meets neighbours in order; only the first and the
    last of each range travel once more.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    with batch_rows(spark, ROWS), shuffles_removed(spark):
        rows = stored(ordered.mapInPandas(_within, EDGES))
        heads = rows.where("head is not null").select("part", "head")
        order = heads.selectExpr("part", "coalesce(lead(part) over (order by part), min(part) over ()) as follows")  # a number for each range
        tails = rows.where("tail is not null").select("doc_id", "part", "tail").join(order, "part")
        last = cut(tails.select("doc_id", "tail", "follows").join(heads.withColumnRenamed("part", "follows"), "follows").mapInPandas(_across, TOLD))
    names = [c.split()[0] for c in TOLD.split(", ")]
    return rows.where("tail is null").select(names).unionByName(last).withColumn("doc_id", F.col("doc_id").cast(kind))


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(with_edits(table(spark, sf_dir, "documents")))
