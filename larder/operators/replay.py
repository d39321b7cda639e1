"""Replay of versioned requests, parallel inside a key.

A request raises its key's version by one if it expects the version it meets, or none. Each answer depends on the one before, but
what a whole range of requests does is a map from the version it starts at to the version it ends at: "plus the number of requests
without an expectation", except for the starting versions that some expectation of the range can meet. Such maps compose. So:

1. ``segments`` cuts all requests, in order, into ranges of equal size. Only keys that go on over a range's end need more.
2. For these, every range's map is made by its own task, in one backward pass.
3. Neighbouring maps are composed pair by pair, in joins, up to one map per key; on the way down every range gets its start.
4. Every range is replayed from its start by its own task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.context import materialize
from larder.operators.grouping import segments, with_carry


def range_map(expected: list[int | None]) -> tuple[dict[int, int], int]:
    """What requests in order do to a starting version: ({start: end} where expectations matter, what is added to all others)."""
    free = sum(e is None for e in expected)
    after: dict[int, int] = {}  # from a version, net of the free requests before it, to the one at the end, net of all
    before = free
    for e in reversed(expected):
        if e is None:
            before -= 1
        else:
            at = e - before
            after[at] = after.get(at + 1, at + 1)
    return {start: end + free for start, end in after.items()}, free


def _maps(parts: DataFrame) -> DataFrame:
    """``key, node, start, end, free`` of every range; one row with a NULL start says what happens to all other versions."""

    def summarise(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("request_id")
        found, free = range_map([None if e == "" else int(e) for e in frame["expected"]])
        out = pd.DataFrame({"start": pd.array([None, *found], "Int64"), "end": pd.array([None, *found.values()], "Int64")})
        return out.assign(key=frame["key"].iloc[0], node=frame["node"].iloc[0], free=free)

    kind = parts.schema["key"].dataType.simpleString()
    return parts.groupBy("key", "node").applyInPandas(summarise, f"key {kind}, node int, start long, end long, free long")


def _composed(maps: DataFrame) -> DataFrame:
    """The maps of pairs of neighbouring nodes (0 and 1, 2 and 3, ...); a last node without a neighbour stays as it is."""
    at = maps.withColumns({"up": F.shiftright("node", 1), "second": F.col("node") % 2 == 1})
    left, right = at.filter("not second"), at.filter("second")
    right_free = right.filter("start is null").select("key", "up", F.col("free").alias("r_free"))
    left_free = left.filter("start is null").select("key", "up", F.col("free").alias("l_free"))
    totals = left_free.join(right_free, ["key", "up"], "left").select("key", "up", "l_free", F.coalesce("r_free", F.lit(0)).alias("r_free"))
    through = left.filter("start is not null").select("key", "up", "start", "end").join(totals, ["key", "up"])
    known = right.filter("start is not null").select("key", "up", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    first = through.withColumn("r_start", F.col("end")).join(known, ["key", "up", "r_start"], "left").select(
        "key", "up", "start", F.coalesce("r_end", F.col("end") + F.col("r_free")).alias("end"), (F.col("l_free") + F.col("r_free")).alias("free")
    )
    second = known.join(totals, ["key", "up"]).select("key", "up", (F.col("r_start") - F.col("l_free")).alias("start"), F.col("r_end").alias("end"), (F.col("l_free") + F.col("r_free")).alias("free"))
    second = second.join(through.select("key", "up", "start"), ["key", "up", "start"], "left_anti").select(first.columns)
    none = F.lit(None).cast("long")
    others = totals.select("key", "up", none.alias("start"), none.alias("end"), (F.col("l_free") + F.col("r_free")).alias("free"))
    return first.unionByName(second).unionByName(others).withColumnRenamed("up", "node")


def _starts(levels: list[DataFrame], first: DataFrame) -> DataFrame:
    """``key, node, version``: where each node of the lowest level starts, given where each key starts."""
    now = first.select("key", F.lit(0).alias("node"), "version")
    for maps in reversed(levels):
        here = maps.select("key", "node", "start", "end", "free")
        own = now.select("key", (F.col("node") * 2).alias("node"), "version")
        free = here.filter("start is null").select("key", "node", "free")
        met = here.filter("start is not null").select("key", "node", F.col("start").alias("version"), "end")
        passed = own.join(free, ["key", "node"]).join(met, ["key", "node", "version"], "left")
        after = passed.select("key", (F.col("node") + 1).alias("node"), F.coalesce("end", F.col("version") + F.col("free")).alias("version"))
        now = own.unionByName(after.join(free.select("key", "node"), ["key", "node"], "left_semi"))
    return now


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range, key and request; only the version reached is carried from batch to batch."""
    at, version = None, 0
    for frame in frames:
        applied = np.empty(len(frame), bool)
        current = np.empty(len(frame), np.int64)
        rows = zip(frame["_seg"].tolist(), frame["key"].tolist(), frame["version"].tolist(), frame["expected"].tolist(), strict=True)
        for i, (seg, key, first, expected) in enumerate(rows):
            if (seg, key) != at:
                at, version = (seg, key), first
            applied[i] = expected == "" or int(expected) == version
            version += int(applied[i])
            current[i] = version
        yield pd.DataFrame({"key": frame["key"], "request_id": frame["request_id"], "expected": frame["expected"], "applied": applied, "current_version": current})


def versioned_replace(state: DataFrame, requests: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Optimistic updates in request order: requests (key, request_id, expected_version) on the current versions.

    A request is applied if it expects the version it meets, or none (NULL), and then raises the version by one; else it is a
    conflict and reports the version it met. A key with very many requests spreads over as many tasks as it fills ranges.
    """
    found = requests.join(state.select(key, "version"), key).select(
        F.col(key).alias("key"), "request_id", F.coalesce(F.col("expected_version").cast("string"), F.lit("")).alias("expected"), "version"
    )
    kind = requests.schema[key].dataType.simpleString()
    cut = segments(found, ["key", "request_id"], parts)
    ends = cut.groupBy("_seg").agg(F.max("key").alias("key")).select("key").distinct()  # at most one per range
    going_on = cut.join(F.broadcast(ends), "key", "left_semi")
    places = going_on.select("key", "_seg").distinct().withColumn("node", F.row_number().over(W.partitionBy("key").orderBy("_seg")) - 1)
    places = materialize(places.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("_n > 1"), "replay-ranges")
    most = places.agg(F.max("_n")).first()[0]
    placed = cut
    if most:
        nodes = places.select("key", "_seg", "node")
        levels = [materialize(_maps(cut.join(F.broadcast(nodes), ["key", "_seg"])), "replay-maps")]  # two rows per range at most
        while len(levels) < math.ceil(math.log2(most)):
            levels.append(materialize(_composed(levels[-1]), "replay-maps"))
        first = cut.join(F.broadcast(nodes.filter("node = 0")), ["key", "_seg"]).groupBy("key").agg(F.first("version").alias("version"))
        starts = _starts(levels, first).join(nodes, ["key", "node"]).select("_seg", "key", F.col("version").alias("_start"))
        placed = with_carry(cut, starts, ["key"]).withColumn("version", F.coalesce("_start", cut["version"])).select(cut.columns)
    ordered = placed.repartition("_seg", "key").sortWithinPartitions("_seg", "key", "request_id")
    done = ordered.mapInPandas(_replay, f"key {kind}, request_id long, expected string, applied boolean, current_version long")
    return done.select(
        F.col("key").alias(key), "request_id", F.nullif("expected", F.lit("")).cast("long").alias("expected_version"), "applied", "current_version"
    )
