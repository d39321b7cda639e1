"""Hard-negative mining with an STR-packed R-tree, exact.

For every anchor: its ``positives`` best other rows of the same label, and for each of these the ``negatives`` best rows of other
labels whose score lies between ``low`` and ``high`` per cent of the positive's. A score is the inner product of whole-number vectors.

* Packing (sort-tile-recursive): rows are range-partitioned by label and first coordinate into slabs, sorted by the second one and
  cut into tiles of one label. Inside a tile, rows are sorted and sliced by the coordinates that spread most, down to leaves; boxes
  of leaves, of ``FAN`` neighbours, and so on up to the tile's root make a tree. A label with a third of all rows is many tiles.
* Search: queries in blocks meet tiles in the cells of a (query groups) x (tile groups) grid, so that the queries, however many,
  never pass the driver, and the corpus is sent once per ``QUERY_ROWS`` queries. A task holds one block of queries and streams
  tiles past it. Of a box, the sum of per-coordinate intervals bounds its scores. A queue opens the box with the highest bound first,
  for those queries only whose window meets the interval and whose kth score so far is not strictly above it.
* Each cell gives at most k rows per query; a rank limit, which Spark applies before the shuffle, merges them.

Defined cases: rows with a NULL ``vec_id``, label or vector, or a vector with a component that is NULL or not below ``LIMIT`` in
size (whose scores would not fit a long), take no part. Repeated rows are rows of their own: a copy of an anchor is one of its "other
rows" and an anchor itself. Ties go to the smaller ``vec_id``. Rows whose vectors differ in length never meet. An anchor without
another row of its label, or whose windows are empty (always so below a negative positive score), gives no rows; nor does an empty
table. Other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.context import materialize
from larder.llm.batches import as_text, runs
from larder.llm.vector_rows import stacked

SLAB_ROWS = 32_768
TILE_ROWS = 4096
LEAF_ROWS = 64
FAN = 8
QUERY_ROWS = 16_384
TILES_PER_CELL = 64
#: Components must stay below this size.
LIMIT = 1 << 24
NOTHING = -(1 << 62)


def packed(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows, leaf of each row in that order): sort by the widest coordinate, slice, and again inside every slice."""
    order, sizes = [], []

    def tile(rows: np.ndarray, used: int, by: np.ndarray) -> None:
        if len(rows) <= leaf or used == len(by):
            for k in range(0, len(rows), leaf):
                order.append(rows[k : k + leaf])
                sizes.append(len(order[-1]))
            return
        rows = rows[np.argsort(vectors[rows, by[used]], kind="stable")]
        left = len(by) - used
        slices = math.ceil(math.ceil(len(rows) / leaf) ** (1 / left))
        step = math.ceil(len(rows) / slices / leaf) * leaf
        for k in range(0, len(rows), step):
            tile(rows[k : k + step], used + 1, by)

    spread = vectors.max(axis=0) - vectors.min(axis=0) if len(vectors) else np.zeros(0)
    tile(np.arange(len(vectors)), 0, np.argsort(-spread, kind="stable")[:3])
    return np.concatenate(order), np.repeat(np.arange(len(sizes)), sizes)


class Tree:
    """The boxes over one tile's rows, which come in leaf order."""

    def __init__(self, vectors: np.ndarray, leaf_of: np.ndarray):
        self.vectors = vectors
        cuts = np.flatnonzero(np.diff(leaf_of, prepend=-1))
        self.starts = np.append(cuts, len(leaf_of))
        self.levels = [(np.minimum.reduceat(vectors, cuts), np.maximum.reduceat(vectors, cuts))]
        while len(self.levels[-1][0]) > 1:
            lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def interval(self, level: int, boxes: slice, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of the queries (split into positive and negative components) with anything in the boxes."""
        lo, hi = (x[boxes].T for x in self.levels[level])
        return up @ lo + down @ hi, up @ hi + down @ lo


class Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NOTHING, np.int64)
        self.vec_id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, scores: np.ndarray, vec_id: np.ndarray) -> None:
        """``scores`` (queries ``at`` x rows), NOTHING where a row does not count."""
        better = scores.max(axis=1) >= np.maximum(self.score[at, -1], NOTHING + 1)
        if not better.any():
            return
        at, k = at[better], self.score.shape[1]
        score = np.concatenate([self.score[at], scores[better]], axis=1)
        ids = np.concatenate([self.vec_id[at], np.broadcast_to(vec_id, (len(at), len(vec_id)))], axis=1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, by_id, 1), np.take_along_axis(ids, by_id, 1)
        first = np.argsort(-score, axis=1, kind="stable")[:, :k]
        self.score[at], self.vec_id[at] = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)


class Block:
    """A block of queries of one vector length."""

    def __init__(self, vectors: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.vectors, self.row, self.low, self.high = vectors, row, low, high
        self.largest = int(np.abs(vectors).max(initial=0))
        self.best = Best(len(vectors), k)
        self.opened = 0

    def search(self, at: np.ndarray, vectors: np.ndarray, leaf_of: np.ndarray, row: np.ndarray, vec_id: np.ndarray) -> None:
        """Best-first through one tile for the queries ``at``."""
        exact = self.largest * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) < 1 << 53  # floating point is exact
        kind = np.float64 if exact else np.int64
        tree, own = Tree(vectors.astype(kind), leaf_of), self.vectors.astype(kind)
        up, down = np.maximum(own, 0), np.minimum(own, 0)
        queue: list[tuple] = []

        def push(level: int, boxes: slice, at: np.ndarray) -> None:
            least, most = tree.interval(level, boxes, up[at], down[at])
            wanted = (most >= np.maximum(self.low[at], self.best.score[at, -1])[:, None]) & (least <= self.high[at][:, None])
            for n in np.flatnonzero(wanted.any(axis=0)).tolist():
                some = wanted[:, n]
                bound = most[some, n]
                heapq.heappush(queue, (-bound.max(), level, boxes.start + n, at[some], bound))

        if len(at):
            push(len(tree.levels) - 1, slice(0, 1), at)
        while queue:
            _, level, box, at, bound = heapq.heappop(queue)
            at = at[bound >= self.best.score[at, -1]]  # strictly below the kth: nothing in the box can enter
            if not len(at):
                continue
            if level:
                push(level - 1, slice(box * FAN, min((box + 1) * FAN, len(tree.levels[level - 1][0]))), at)
                continue
            self.opened += 1
            span = slice(tree.starts[box], tree.starts[box + 1])
            scores = (own[at] @ tree.vectors[span].T).astype(np.int64)
            out = (scores < self.low[at][:, None]) | (scores > self.high[at][:, None]) | (self.row[at][:, None] == row[None, span])
            scores[out] = NOTHING
            self.best.offer(at, scores, vec_id[span])


def _tiles(rows: DataFrame) -> DataFrame:
    """row, vec_id, label, width, tile, leaf, vector (bytes): the packed corpus."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for run in runs(frames, ["width", "label"]):
            width = int(run["width"].iloc[0])
            for k in range(0, len(run), TILE_ROWS):
                part = run.iloc[k : k + TILE_ROWS]
                order, leaf = packed(np.stack(part["vector"].tolist()).reshape(len(part), width).astype(np.int32))
                part = part.iloc[order]
                raw = [np.asarray(v, "<i4").tobytes() for v in part["vector"]]
                yield pd.DataFrame(
                    {**{c: part[c] for c in ("row", "vec_id", "label", "width")}, "tile": (int(part["slab"].iloc[0]) << 32) + number, "leaf": leaf, "vector": raw}
                )
                number += 1

    n = rows.count()
    slabs = rows.repartitionByRange(max(1, math.ceil(n / SLAB_ROWS)), "width", "label", F.try_element_at("vector", F.lit(1)), "vec_id", "row")
    slabs = slabs.withColumn("slab", F.spark_partition_id()).sortWithinPartitions("width", "label", F.try_element_at("vector", F.lit(2)), "vec_id")
    schema = "row long, vec_id long, label string, width int, tile long, leaf int, vector binary"
    return materialize(slabs.mapInPandas(pack, schema), "packed-vectors")


def _search(queries: DataFrame, tiles: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``query, vec_id, score, rank`` of the k best rows of each query (query, row, label, width, vector, low, high)."""
    spark = queries.sparkSession
    n = queries.count()
    parts = tiles.select("tile").distinct().count()
    query_groups = max(1, math.ceil(n / QUERY_ROWS))
    tile_groups = max(1, math.ceil(parts / TILES_PER_CELL), min(parts, math.ceil(3 * spark.sparkContext.defaultParallelism / query_groups)))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, blocks = None, {}
        for run in runs(frames, ["cell", "tile"]):
            if run["cell"].iloc[0] != cell:
                yield from found(blocks)
                cell, blocks = run["cell"].iloc[0], {}
            if run["tile"].iloc[0] < 0:
                for width, part in run.groupby("width"):
                    vectors = stacked(part["vector"], "<i4", width).astype(np.int64)
                    low, high = part["low"].to_numpy(np.int64), part["high"].to_numpy(np.int64)
                    blocks[width] = Block(vectors, part["row"].to_numpy(), low, high, k), part["query"].to_numpy(), part["label"].to_numpy()
                continue
            width, label = run["width"].iloc[0], run["label"].iloc[0]
            if width in blocks:
                block, _, labels = blocks[width]
                run = run.sort_values("leaf", kind="stable")
                vectors = stacked(run["vector"], "<i4", width)
                block.search(np.flatnonzero((labels == label) == same_label), vectors, run["leaf"].to_numpy(), run["row"].to_numpy(), run["vec_id"].to_numpy())
        yield from found(blocks)

    def found(blocks: dict) -> Iterator[pd.DataFrame]:
        for block, names, _ in blocks.values():
            at, place = np.nonzero(block.best.score > NOTHING)
            yield pd.DataFrame({"query": names[at], "vec_id": block.best.vec_id[at, place], "score": block.best.score[at, place]})

    zero = F.lit(0).cast("long")
    asking = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(tile_groups - 1))).alias("_t"), F.pmod(F.xxhash64("query"), F.lit(query_groups)).cast("long").alias("_q"), F.lit(-1).cast("long").alias("tile"),
        F.lit(0).alias("leaf"), "query", "row", zero.alias("vec_id"), "label", "width", "low", "high", "vector",
    )
    asked = tiles.select(
        F.pmod(F.xxhash64("tile"), F.lit(tile_groups)).cast("int").alias("_t"), F.explode(F.sequence(zero, F.lit(query_groups - 1).cast("long"))).alias("_q"), "tile",
        "leaf", zero.alias("query"), "row", "vec_id", "label", "width", zero.alias("low"), zero.alias("high"), "vector",
    )
    cells = asking.unionByName(asked).withColumn("cell", F.col("_q") * tile_groups + F.col("_t")).drop("_q", "_t")
    cells = cells.repartition(query_groups * tile_groups, "cell").sortWithinPartitions("cell", "tile")
    parted = cells.mapInPandas(meet, "query long, vec_id long, score long")
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))))
    return ranked.filter(F.col("rank") <= k)  # Spark applies this limit in the tasks above as well


def _share(score: str, per_cent: int, rounded: str) -> Column:
    """``per_cent`` of a score as a whole number (``rounded``: ceil or floor), without leaving the range of longs."""
    return F.expr(f"{score} div 100 * {per_cent} + cast({rounded}({score} % 100 * {per_cent} / 100) as long)")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows (vec_id, label, vector of whole numbers)."""
    fits = F.forall("vector", lambda x: x.isNotNull() & (x < LIMIT) & (x > -LIMIT))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fits, F.lit(False))
    own = rows.filter(part).select("vec_id", as_text("label"), "vector", F.size("vector").alias("width"), is_anchor.alias("anchor"))
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    tiles = _tiles(own.drop("anchor"))
    anchors = tiles.join(own.filter("anchor").select("row"), "row", "left_semi").select("row", "vec_id", "label", "width", "vector")

    everything = F.lit(1 << 61).cast("long")
    asked = anchors.withColumns({"query": F.col("row"), "low": -everything, "high": everything})
    best = _search(asked, tiles, positives, True).withColumnRenamed("query", "row")
    best = best.select("row", (F.col("row") * positives + F.col("rank") - 1).alias("query"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best, "positives")

    window = {"low": _share("positive_score", low, "ceil"), "high": _share("positive_score", high, "floor")}
    asked = anchors.join(best, "row").withColumns(window).filter("low <= high")
    found = _search(asked, tiles, negatives, False)
    return (
        found.join(best, "query").join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
