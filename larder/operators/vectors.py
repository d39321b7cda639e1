"""Exact cosine search of request vectors over a large corpus of vectors, as a blocked matrix join.

Requests and corpus rows meet in the cells of a grid of (request groups) x (corpus groups). A cell's task holds its requests, at most
about ``REQUEST_ROWS``, streams its corpus rows past them in matrix products, and returns at most k rows per request. A rank limit, which
Spark applies before the shuffle, merges the cells. Nothing passes the driver; the corpus is scanned once, and sent once per
``REQUEST_ROWS`` requests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.operators.grouping import top_per_key

REQUEST_ROWS = 4_096
#: Corpus rows in one matrix product, and candidates that a task holds before it cuts them to the best.
TILE_ROWS, HELD = 1_024, 1 << 20
THRESHOLD, SEARCH_ROWS, SIMILAR_ROWS = 0.7, 10, 5


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    widths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of different length: {widths[:5].tolist()}")
    width = int(widths[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Block:
    """The requests of one cell and the best rows that each has met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tags: list, k: int, threshold: float | None, skip_self: bool, by_tag: bool):
        self.ids, self.vectors, self.k, self.skip_self, self.by_tag = ids, _unit(vectors), k, skip_self, by_tag
        self.least = np.full(len(ids), -np.inf)  # what a row must reach, in the rounded scores that make the order
        self.threshold = -np.inf if threshold is None else threshold
        self.tag_at = {t: i for i, t in enumerate(sorted({t for own in tags for t in own or []}))} if by_tag else {}
        self.asked = np.zeros((len(self.tag_at), len(ids)), dtype=np.float32)
        for j, own in enumerate(tags if by_tag else []):
            self.asked[[self.tag_at[t] for t in own or []], j] = 1
        self.untagged = self.asked.sum(axis=0) == 0
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def meet(self, vec_ids: np.ndarray, vectors: np.ndarray, tags: list) -> None:
        sims = _unit(vectors) @ self.vectors.T
        rounded = np.round(sims, 12)
        keep = (sims >= self.threshold) & (rounded >= self.least)
        if self.skip_self:
            keep &= vec_ids[:, None] != self.ids
        if self.by_tag:
            own = np.zeros((len(vec_ids), len(self.tag_at)), dtype=np.float32)
            for i, row in enumerate(tags):
                own[i, [self.tag_at[t] for t in row or [] if t in self.tag_at]] = 1
            keep &= (own @ self.asked > 0) | self.untagged
        row, request = np.nonzero(keep)
        self.held.append((request, rounded[row, request], vec_ids[row], sims[row, request]))
        self.waiting += len(row)
        if self.waiting > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Only the k best of each request stay; equal scores in id order."""
        request, rounded, vec_id, sim = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((vec_id, -rounded, request))
        own = request[order]
        order = order[np.arange(len(own)) - np.searchsorted(own, own) < self.k]
        kept = request, rounded, vec_id, sim = request[order], rounded[order], vec_id[order], sim[order]
        size = np.bincount(request, minlength=len(self.ids))
        last = np.cumsum(size) - 1
        full = size >= self.k
        self.least[full] = rounded[last[full]]
        self.held, self.waiting = [kept], len(request)
        return kept


def _search(k: int, threshold: float | None, skip_self: bool, by_tag: bool):
    schema = pa.schema([("request_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_q", "_c", "asked")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                here, part = tuple(marks[:2, start]), batch.slice(start, stop - start)
                if here != cell:
                    yield from found(block)
                    cell, asked, block = here, [], None
                if marks[2, start]:
                    asked.append(part)
                    continue
                if asked and block is None:
                    whole = pa.Table.from_batches(asked).combine_chunks()
                    vectors = _matrix(whole.column("vector").chunk(0))
                    block = Block(whole.column("id").to_numpy(), vectors, whole.column("tags").to_pylist(), k, threshold, skip_self, by_tag)
                for i in range(0, part.num_rows if block else 0, TILE_ROWS):
                    tile = part.slice(i, TILE_ROWS)
                    ids = tile.column("id").to_numpy(zero_copy_only=False)
                    block.meet(ids, _matrix(tile.column("vector")), tile.column("tags").to_pylist() if by_tag else [])
        yield from found(block)

    def found(block: Block | None) -> Iterator[pa.RecordBatch]:
        if block and block.waiting:
            request, _, vec_id, sim = block.cut()
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[request]), pa.array(vec_id), pa.array(sim)], schema=schema)

    return run


def nearest(
    corpus: DataFrame,
    requests: DataFrame,
    k: int,
    threshold: float | None = None,
    skip_self: bool = False,
    by_tag: bool = False,
) -> DataFrame:
    """(request_id, vec_id, similarity): per request the k most similar corpus rows, equal scores in id order.

    ``corpus`` has vec_id, vector (and tags), ``requests`` request_id, vector and tags. Rows without a vector are left out.
    """
    spark = corpus.sparkSession
    asked = materialize(requests.filter("vector IS NOT NULL").select("request_id", "vector", *(["tags"] if by_tag else [])), "vector-requests")
    request_groups = max(1, math.ceil(asked.count() / REQUEST_ROWS))
    corpus_groups = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / request_groups))
    none, vector = F.array().cast("array<string>"), F.col("vector").cast("array<double>").alias("vector")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(
        F.pmod(F.xxhash64("request_id"), F.lit(request_groups)).cast("int").alias("_q"), every(corpus_groups).alias("_c"), F.lit(1).alias("asked"),
        F.col("request_id").cast("long").alias("id"), vector, (F.col("tags") if by_tag else none).alias("tags"),
    )
    right = corpus.filter("vector IS NOT NULL").select(
        every(request_groups).alias("_q"), F.pmod(F.xxhash64("vec_id"), F.lit(corpus_groups)).cast("int").alias("_c"), F.lit(0).alias("asked"),
        F.col("vec_id").cast("long").alias("id"), vector, (F.col("tags") if by_tag else none).alias("tags"),
    )
    cells = left.unionByName(right).repartition(request_groups * corpus_groups, "_q", "_c").sortWithinPartitions("_q", "_c", F.desc("asked"))
    found = cells.mapInArrow(_search(k, threshold, skip_self, by_tag), "request_id long, vec_id long, similarity double")
    return top_per_key(found, ["request_id"], [F.round("similarity", 12).desc(), F.col("vec_id")], k)


def semantic_search(
    corpus: DataFrame, requests: DataFrame, k: int = SEARCH_ROWS, threshold: float = THRESHOLD, by_tag: bool = False
) -> DataFrame:
    """Rows at least as similar as the threshold, optionally sharing a tag with the request."""
    return nearest(corpus, requests, k, threshold=threshold, by_tag=by_tag)


def similar_items(corpus: DataFrame, item_ids: DataFrame, k: int = SIMILAR_ROWS) -> DataFrame:
    """The items most like each asked item, itself left out."""
    asked = corpus.join(item_ids.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("request_id"), "vector")
    return nearest(corpus, asked, k, skip_self=True)
