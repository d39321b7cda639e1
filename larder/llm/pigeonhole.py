"""Near duplicates among vectors by a subspace pigeonhole join, exact.

For unit vectors, cosine >= t means squared distance <= 2 - 2t. The vectors are rotated and split into blocks of ``BLOCK``
coordinates. If two are that near, they are in at least one block at most the block's share of that budget apart, the share being
proportional to its coordinates. So every block is joined by range on its own, and every candidate of any block is then compared
whole, in double precision.

* A block's range join uses a grid over its first coordinates, with cells as wide as two radii. A vector is at home in one cell
  and visits the smaller-numbered cells that its ball touches, so two near vectors meet in exactly one cell. The number of grid
  coordinates follows from the largest label, so that cells stay near ``CELL_ROWS`` rows.
* A link counts in one block only, the one in which the two are nearest (in a tie the first). Every task can see that by itself,
  because rotation (sign changes and Hadamard steps) rounds alike wherever it is computed. So tasks return counts and no pairs.
* A cell with more than ``TILE`` rows is cut into tiles, and each pair of tiles is a task of its own: a hot label or a large group of
  near copies spreads. Exact copies are one node with a number of copies. A task returns one row per linked node: the links it saw
  and the smallest node it is connected with. Components come from these by ``components``.

Defined cases: a row whose label is NULL, or whose vector is NULL, empty, zero or holds a NULL or non-finite component, links with
nothing and is its own component; vectors of different length do not link. Repeated rows are vectors of their own and link with each
other. A NULL ``vec_id`` takes part; its ``component_id`` is the smallest id that there is in its component, else NULL, and it is kept
only in the latter case. An empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.llm.components import components
from larder.llm.vector_rows import finite, stacked

THRESHOLD = 0.98
BLOCK = 8
CELL_ROWS = 512
TILE = 1024
#: Cells that a coordinate of a unit vector spreads over, for cells of two radii at blocks of 8 coordinates; it only sets the grid's size.
SPREAD = 3.6
#: Pairs that are compared whole at once.
PAIRS = 1 << 15
SEED = 13


def padded(width: int) -> int:
    """The power of two to which the rotation pads."""
    return 1 << max(0, width - 1).bit_length()


def turned(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, rotated unit vectors) in double precision; every row is rounded alike in any company."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    n, size = len(x), padded(x.shape[1])
    y = np.zeros((n, size))
    y[:, : x.shape[1]] = x
    draw = np.random.default_rng(SEED)
    for _ in range(2):
        y = y * draw.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            z = y.reshape(n, -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        y = y / math.sqrt(size)
    return x, y


def block_radius(size: int, block: int, threshold: float) -> float:
    """The distance inside a block that its share of the squared distance allows, a little widened for rounding."""
    return math.sqrt((2 - 2 * threshold) * block / size) * (1 + 1e-9) + 1e-9


def cells(y: np.ndarray, block: int, grid: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(block, rows, cells, home): where each rotated vector is at home and which smaller cells its ball touches."""
    size = y.shape[1]
    radius = block_radius(size, block, threshold)
    wide = 2 * radius
    across = int(2 / wide) + 3
    weights = across ** np.arange(grid - 1, -1, -1, dtype=np.int64)
    rows = np.arange(len(y))
    for b in range(size // block):
        part = (y[:, b * block : b * block + grid] + 1 + wide) / wide
        home = np.floor(part).astype(np.int64)
        inside = part - home
        step = np.where(inside < 0.5, -1, 1)  # the one neighbour in each direction that the ball can touch
        gap = np.minimum(inside, 1 - inside) * wide
        yield b, rows, home @ weights, True
        for moved in product((False, True), repeat=grid):
            if any(moved):
                m = np.array(moved)
                touched = (gap[:, m] ** 2).sum(axis=1) <= radius * radius * (1 + 1e-9)
                there = (home + step * m) @ weights
                smaller = touched & (there < home @ weights)
                yield b, rows[smaller], there[smaller], False


def _meet(frame: pd.DataFrame, block: int, threshold: float) -> pd.DataFrame:
    """Links inside one cell, or between two tiles of it, that belong to this block: (node, root, links)."""
    width = int(frame["width"].iloc[0])
    b, i, j = (int(frame[c].iloc[0]) for c in ("block", "i", "j"))
    x, y = turned(stacked(frame["raw"], frame["kind"].iloc[0], width))
    node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    home, tile = frame["home"].to_numpy(dtype=bool), frame["tile"].to_numpy()
    own = np.ascontiguousarray(y[:, b * block : (b + 1) * block])
    norm = (own * own).sum(axis=1)
    allowed = block_radius(y.shape[1], block, threshold) ** 2 + 1e-9
    left, right = (np.flatnonzero(tile == k) for k in (i, j))
    found_a, found_b = [], []
    for start in range(0, len(left), 256):
        at = left[start : start + 256]
        near = norm[at, None] + norm[None, right] - 2 * (own[at] @ own[right].T) <= allowed
        near &= home[at, None] | home[None, right]
        if i == j:
            near &= at[:, None] < right[None, :]
        p, q = np.nonzero(near)
        p, q = at[p], right[q]
        for k in range(0, len(p), PAIRS):
            u, v = p[k : k + PAIRS], q[k : k + PAIRS]
            linked = (x[u] * x[v]).sum(axis=1) >= threshold
            u, v = u[linked], v[linked]
            apart = ((y[u] - y[v]) ** 2).reshape(len(u), y.shape[1] // block, block).sum(axis=2)
            here = apart.argmin(axis=1) == b
            found_a.append(u[here])
            found_b.append(v[here])
    if not sum(map(len, found_a)):
        return pd.DataFrame({"node": [], "root": [], "links": []}, dtype="int64")
    u, v = np.concatenate(found_a), np.concatenate(found_b)
    links = np.bincount(u, copies[v], len(node)) + np.bincount(v, copies[u], len(node))
    rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
    root = rank.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, low[u])
        low = low[np.argsort(rank)][low]  # the root's root
        if (low == root).all():
            break
        root = low
    met = np.flatnonzero(links)
    return pd.DataFrame({"node": node[met], "root": np.sort(node)[root[met]], "links": links[met].astype(np.int64)})


def nodes(rows: DataFrame) -> DataFrame:
    """Distinct (label, vector) of the usable rows: node, copies, least vec_id."""
    usable = F.col("label").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    distinct = rows.filter(usable).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    return materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")


def _cell_rows(found: DataFrame, grid: int, block: int, threshold: float, counts_only: bool) -> DataFrame:
    """Every node in each cell it belongs to; with ``counts_only`` just how many a task saw of each cell."""
    kind = "<f4" if found.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    label = found.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                yield from explode(batch.slice(start, 2048))

    def explode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = batch.column("embedding")
        widths = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
        starts = np.cumsum(widths) - widths
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            raw = values[starts[at][:, None] + np.arange(width)]
            _, y = turned(raw)
            own = min(block, y.shape[1])
            for b, rows, cell, home in cells(y, own, min(grid, own), threshold):
                if not len(rows):
                    continue
                picked = pa.array(at[rows])
                columns = {"label": batch.column("label").take(picked), "width": pa.array(np.full(len(rows), width, np.int32)), "block": pa.array(np.full(len(rows), b, np.int32)), "cell": pa.array(cell)}
                if not counts_only:
                    columns |= {
                        "home": pa.array(np.full(len(rows), home)), "node": batch.column("node").take(picked), "copies": batch.column("copies").take(picked),
                        "kind": pa.array([kind] * len(rows)), "raw": pa.array([raw[k].tobytes() for k in rows], pa.binary()),
                    }
                yield pa.RecordBatch.from_pydict(columns)

    more = "" if counts_only else ", home boolean, node long, copies long, kind string, raw binary"
    return found.select("label", "embedding", "node", "copies").mapInArrow(run, f"label {label}, width int, block int, cell long{more}")


def links(found: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell_rows: int = CELL_ROWS, tile: int = TILE) -> DataFrame:
    """``node, root, links``: links of each node with other nodes (copies counted) as the tasks saw them, to be added up."""
    largest = found.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    grid = min(block, max(1, math.ceil(math.log(max(1, largest / cell_rows), SPREAD))))
    key = ["label", "width", "block", "cell"]
    crowded = _cell_rows(found, grid, block, threshold, True).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile)
    crowded = materialize(crowded.select(*key, F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")), "crowded-cells")
    placed = _cell_rows(found, grid, block, threshold, False).join(crowded, key, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    units = placed.withColumn("_other", other).withColumns({"i": F.least("tile", "_other"), "j": F.greatest("tile", "_other")}).drop("_other", "_tiles")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        width = int(frame["width"].iloc[0])
        return _meet(frame, min(block, padded(width)), threshold)

    return units.groupBy(*key, "i", "j").applyInPandas(meet, "node long, root long, links long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell_rows: int = CELL_ROWS, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows`` (vec_id, label, embedding)."""
    rows = rows.select("vec_id", "label", "embedding")
    found = nodes(rows)
    seen = materialize(links(found, threshold, block, cell_rows, tile), "vector-links")
    totals = seen.groupBy("node").agg(F.sum("links").alias("links"))
    member = components(seen.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    own = found.join(totals, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = own.join(first, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(own, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    usable = F.col("label").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
