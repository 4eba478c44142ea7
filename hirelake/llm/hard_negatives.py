"""Hard negatives of anchor vectors, by best-first search of R-trees packed by sort-tile-recursion.

Rows are dealt into trees by ranges of (label, first coordinate, hash): contiguous slabs of TREE_ROWS rows at most but for
the sampling of the ranges. The hash splits groups of equal vectors, so no tree depends on how often a vector repeats. A
task sorts its slab into tiles, coordinate by coordinate, down to leaves of LEAF rows, and packs FAN boxes into one above
them. A box has the least and largest value of each coordinate and of the label, so an anchor's inner product with
anything in it lies in an interval that is summed coordinate by coordinate.

The anchors travel in blocks to the trees, an equi-join on (tree, block); a tree's rows go to a block only if their labels
can serve it. In a tree each anchor's queue opens the box of the highest bound first, and drops boxes outside all score
windows or strictly below the last score still wanted. Positives come first (their search starts with the bound that the
anchor's own tree gives), their scores set the windows, and a second search finds the negatives. What leaves a tree is
at most the wanted number of rows for an anchor or window; a ranked window merges the trees.

Scores are exact: doubles where sums of products stay under 2^53, unbounded integers otherwise, held to a long's range
when returned (past it they tie). Bounds are exact too, so results equal a search of all rows.

Cases: a row with a null label, a null vector or a null, non-finite or too large entry takes no part; one without an id
does, comes last among ties, and is never an anchor by the query's rule; a shorter vector has zeros at its end; rows of
equal ids or vectors are rows of their own, and an anchor leaves out just itself; equal scores go by the smaller id;
an anchor without positives or without rows in a window has no rows; a positive of negative score has an empty window; an
empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import EXACT, LONG, largest, matrix, with_whole

#: Rows of a tree, of a leaf, and boxes of a box.
TREE_ROWS, LEAF, FAN = 65536, 128, 8
#: Anchors of a block, on average; each of a block's trees gives BLOCK at most.
BLOCK = 8192
#: Rows below which a tree isn't worth a task of its own.
LEAST_ROWS = 1024
#: Positives of an anchor, negatives of a positive, and the window: LOW * positive <= UNIT * negative <= HIGH * positive.
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, UNIT = 30, 90, 100

#: A leaf as a task tells it, with some of the tree's anchors; a score and id of the own tree's last wanted row may lack.
ANCHOR = "anchor: string, anchor_id: string, label: bigint, part: int, ax: binary, own_score: bigint, floor_score: string, floor_id: string"
PLANTED = f"tree int, slot int, width int, first long, last long, ids binary, named binary, labels binary, x binary, anchors array<struct<{ANCHOR}>>"
FOUND = "anchor string, wanted int, id string, score long"


# ---- one tree


def tiles(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf: sorted by label, then tiled by the coordinates of the largest spread, in turn."""
    order = np.argsort(labels, kind="stable")
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(0)
    axes = np.argsort(-spread, kind="stable")

    def split(rows: np.ndarray, depth: int, levels: int) -> Iterator[np.ndarray]:
        leaves = math.ceil(len(rows) / leaf)
        if leaves <= 1 or not levels:
            yield from (rows[at : at + leaf] for at in range(0, len(rows), leaf))
            return
        slabs = math.ceil(leaves ** (1 / levels))
        rows = rows[np.argsort(x[rows, axes[depth]], kind="stable")]
        size = math.ceil(leaves / slabs) * leaf
        for at in range(0, len(rows), size):
            yield from split(rows[at : at + size], depth + 1, levels - 1)

    out: list[np.ndarray] = []
    for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []:
        out += split(own, 0, min(len(axes), max(1, math.ceil(math.log2(max(2, math.ceil(len(own) / leaf)))))))
    return out


class Tree:
    """Leaves of rows under boxes; score type float where sums are exact, object (unbounded integers) otherwise."""

    def __init__(self, leaves: list[dict], width: int, anchors_reach: int) -> None:
        reach = max([1, *(largest(leaf["x"]) for leaf in leaves)])
        self.kind = float if width * reach * max(1, anchors_reach) < EXACT else object
        self.leaves = [leaf | {"x": leaf["x"].astype(self.kind)} for leaf in leaves]
        level = [(leaf["x"].min(axis=0), leaf["x"].max(axis=0), leaf["labels"].min(), leaf["labels"].max()) for leaf in self.leaves]
        self.levels = [self._packed(level)]
        while len(level) > FAN:
            level = [
                (np.min([b[0] for b in part], axis=0), np.max([b[1] for b in part], axis=0), min(b[2] for b in part), max(b[3] for b in part))
                for part in (level[at : at + FAN] for at in range(0, len(level), FAN))
            ]
            self.levels.append(self._packed(level))

    def _packed(self, boxes: list[tuple]) -> tuple[np.ndarray, ...]:
        low, high, first, last = zip(*boxes, strict=True)
        return np.array(low, self.kind), np.array(high, self.kind), np.array(first), np.array(last)

    def search(self, anchor: np.ndarray, label: int, same: bool, wanted: list[Wanted]) -> None:
        """Offer the rows of the label, or of all others, to what is wanted, best boxes first."""
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        queue: list[tuple] = []

        def push(depth: int, start: int) -> None:
            low, high, first, last = (part[start : start + FAN] if depth < len(self.levels) - 1 else part for part in self.levels[depth])
            most, least = high @ up + low @ down, low @ up + high @ down
            fit = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            for at in np.flatnonzero(fit).tolist():
                if any(w.open(least[at], most[at]) for w in wanted):
                    heapq.heappush(queue, (-most[at], depth, start + at, least[at]))

        push(len(self.levels) - 1, 0)
        while queue:
            most, depth, at, least = heapq.heappop(queue)
            if not any(w.open(least, -most) for w in wanted):
                continue
            if depth:
                push(depth - 1, at * FAN)
                continue
            leaf = self.leaves[at]
            scores = leaf["x"] @ anchor
            own = leaf["labels"] == label if same else leaf["labels"] != label
            for w in wanted:
                w.offer(scores, leaf["ids"], leaf["named"], own)


class Wanted:
    """The best k rows whose score lies in [low, high]: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, k: int, low: float = -math.inf, high: float = math.inf, floor: tuple | None = None) -> None:
        self.k, self.low, self.high, self.floor = k, low, high, floor
        self.rows: list[tuple] = []  # (-score, without id, id), best first

    def last(self) -> float:
        """The score that a row has to reach."""
        own = -self.rows[-1][0] if len(self.rows) == self.k else -math.inf
        return max(self.low, own, -self.floor[0] if self.floor else -math.inf)

    def open(self, least: float, most: float) -> bool:
        return most >= self.last() and least <= self.high

    def offer(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray, own: np.ndarray) -> None:
        at = np.flatnonzero(own & (scores >= self.last()) & (scores <= self.high))
        if not len(at):
            return
        if len(at) > self.k:  # ties of the k-th stay
            at = at[scores[at] >= np.sort(scores[at])[-self.k]]
        rows = [(-int(scores[i]), not named[i], int(ids[i])) for i in at.tolist()]
        self.rows = sorted([*self.rows, *(r for r in rows if self.floor is None or r <= self.floor)])[: self.k]


# ---- what tasks send one another


def _pack(values: np.ndarray) -> bytes:
    """Longs, in four bytes each where they fit; the first byte tells."""
    small = largest(values) < 1 << 31
    return (b"4" if small else b"8") + values.astype("<i4" if small else "<i8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[:1] == b"4" else "<i8", offset=1).astype(np.int64)


def _leaf(row: object) -> dict:
    ids = _unpack(row.ids)
    return {"ids": ids, "named": np.frombuffer(row.named, bool), "labels": _unpack(row.labels), "x": _unpack(row.x).reshape(len(ids), row.width)}


def _row(score: int, nameless: bool, number: int) -> tuple[str | None, int]:
    return None if nameless else str(number), max(-LONG, min(LONG - 1, -score))


def _planted(width: int, own_best: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A slab's rows as leaves, and its anchors with the own tree's bound of their positives."""
    from pyspark import TaskContext

    def plant(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        part, tree = pd.concat(got, ignore_index=True), TaskContext.get().partitionId()
        x, labels, named = matrix(part["x"], width), part["label"].to_numpy(np.int64), part["id"].notna().to_numpy()
        ids = np.array([int(i) if ok else LONG - 1 for i, ok in zip(part["id"], named, strict=True)], np.int64)
        leaves = [{"ids": ids[r], "named": named[r], "labels": labels[r], "x": x[r]} for r in tiles(x, labels)]
        search, anchors = Tree(leaves, width, largest(x)), []
        for count, at in enumerate(np.flatnonzero(part["is_anchor"]).tolist()):
            own = Wanted(own_best)
            search.search(x[at].astype(search.kind), labels[at], True, [own])
            floor = own.rows[-1] if len(own.rows) == own_best else None
            floored = {"floor_score": str(floor[0]) if floor else None, "floor_id": None if not floor or floor[1] else str(floor[2])}
            own_score = int(x[at].astype(search.kind) @ x[at].astype(search.kind))
            anchors.append({"anchor": f"{tree}.{at}", "anchor_id": part["id"][at], "label": int(labels[at]), "part": count // BLOCK, "ax": _pack(x[at]), "own_score": _row(-own_score, True, 0)[1]} | floored)
        yield pd.DataFrame(
            {"tree": tree, "slot": s, "width": width, "first": f["labels"].min(), "last": f["labels"].max(), "ids": _pack(f["ids"]), "named": f["named"].tobytes(), "labels": _pack(f["labels"]), "x": _pack(f["x"]), "anchors": anchors[s :: len(leaves)]}
            for s, f in enumerate(leaves)
        )

    return plant


def _finder(same: bool, wanted_of: Callable[[object], list[tuple[int, Wanted]]]) -> Callable:
    """Search a (tree, block) group: wanted_of gives an anchor's numbered wants."""

    def find(leaves: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(leaves) and len(anchors):
            xs = [_unpack(v) for v in anchors["ax"]]
            tree = Tree([_leaf(r) for r in leaves.sort_values("slot").itertuples()], int(leaves["width"].iloc[0]), max(map(largest, xs)))
            for x, anchor in zip(xs, anchors.itertuples(), strict=True):
                wants = wanted_of(anchor)
                tree.search(x.astype(tree.kind), anchor.label, same, [w for _, w in wants])
                out += [(anchor.anchor, number, *_row(*r)) for number, w in wants for r in w.rows]
        return pd.DataFrame(out, columns=["anchor", "wanted", "id", "score"])

    return find


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best k of each key, with their rank; Spark trims each task's rows to k before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").cast("long").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _met(leaves: DataFrame, anchors: DataFrame, n_blocks: int, same: bool, find: Callable) -> DataFrame:
    """Each tree's leaves with each block's anchors where their labels allow it, searched by find.

    Each tree lists the numbers of the blocks and meets the blocks' label ranges by number, without their rows.
    """
    ranges = leaves.groupBy("tree").agg(F.min("first").alias("tree_first"), F.max("last").alias("tree_last"))
    blocks = anchors.groupBy("block").agg(F.min("label").alias("block_first"), F.max("label").alias("block_last"))
    listed = ranges.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    serves = "tree_first <= block_last and block_first <= tree_last" if same else "tree_first < tree_last or block_first < block_last or tree_first <> block_first"
    pairs = listed.join(blocks, "block").where(serves).select("tree", "block")
    left, right = leaves.join(pairs, "tree"), anchors.drop("tree").join(pairs, "block")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(find, FOUND)


def _of_label(k: int) -> Callable[[object], list[tuple[int, Wanted]]]:
    def wants(anchor: object) -> list[tuple[int, Wanted]]:
        if not isinstance(anchor.floor_score, str):
            return [(0, Wanted(k))]
        named = isinstance(anchor.floor_id, str)
        return [(0, Wanted(k, floor=(int(anchor.floor_score), not named, int(anchor.floor_id) if named else LONG - 1)))]

    return wants


def _of_windows(k: int) -> Callable[[object], list[tuple[int, Wanted]]]:
    def wants(anchor: object) -> list[tuple[int, Wanted]]:
        windows = [(int(p["rank"]), -(-LOW * int(p["score"]) // UNIT), HIGH * int(p["score"]) // UNIT) for p in anchor.positives]
        return [(rank, Wanted(k, low, high)) for rank, low, high in windows if low <= high]

    return wants


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor, positive and negative."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    plain = rows.select(F.col(key).cast("string").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col(vector).alias("vector"))
    sound = with_whole(plain.where("label is not null"), "vector", "x").drop("vector")
    n, width = sound.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    trees = max(1, math.ceil(n / TREE_ROWS), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS)))
    slabs = sound.repartitionByRange(trees, "label", F.get("x", F.lit(0)), F.xxhash64("id", "x"))
    packed = cut(slabs.mapInPandas(_planted(width, positives + 1), PLANTED))
    leaves, anchors = packed.drop("anchors"), packed.select("tree", F.explode("anchors").alias("a")).select("tree", "a.*")
    count, parts, trees = anchors.agg(F.count("*"), F.coalesce(F.max("part") + 1, F.lit(1)), F.coalesce(F.max("tree") + 1, F.lit(1))).first()
    together = max(1, BLOCK * trees // max(1, count))  # neighbouring trees whose anchors share a block
    anchors = anchors.withColumn("block", F.expr(f"cast(tree div {together} as int) * {parts} + part")).drop("part")
    n_blocks = math.ceil(trees / together) * parts

    near = cut(_first(_met(leaves, anchors, n_blocks, True, _finder(True, _of_label(positives + 1))), positives + 1, "anchor"))
    known = near.join(anchors.select("anchor", "anchor_id", "own_score"), "anchor")
    itself = F.when(F.col("id").eqNullSafe(F.col("anchor_id")) & (F.col("score") == F.col("own_score")), F.col("rank"))
    left_out = F.coalesce(F.min(itself).over(Window.partitionBy("anchor")), F.lit(positives + 1))
    chosen = known.withColumn("left_out", left_out).where("rank <> left_out").select("anchor", "anchor_id", (F.col("rank") - (F.col("rank") > F.col("left_out")).cast("int")).alias("wanted"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = cut(chosen)
    windows = chosen.groupBy("anchor").agg(F.collect_list(F.struct(F.col("wanted").alias("rank"), F.col("positive_score").alias("score"))).alias("positives"))
    far = _first(_met(leaves, anchors.join(windows, "anchor"), n_blocks, False, _finder(False, _of_windows(negatives))), negatives, "anchor", "wanted")
    return far.join(chosen, ["anchor", "wanted"]).select(F.col("anchor_id").cast(kind).alias("anchor_id"), F.col("positive_id").cast(kind).alias("positive_id"), "rank", F.col("id").cast(kind).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= {UNIT} * score AND {UNIT} * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
