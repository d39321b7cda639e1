"""Cart streams: what a micro-batch of cart versions or versioned requests does to the sessions it touches.

Both are steps for ``run.run_steps``: functions from (micro-batch, newest state of its sessions) to (result rows, new state), made of
the batch operators, so that a busy session spreads over tasks inside a micro-batch too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.context import materialize
from larder.operators.carts import changes, clean_items, read_cart
from larder.operators.grouping import carried, first_per_key, segments, with_carry
from larder.operators.replay import versioned_replace
from larder.streaming.run import run_steps

#: State per session: the cart version last seen, and the version its requests have reached.
CARTS = "session_id long, version long, cart string"
VERSIONS = "session_id long, version long"


def cart_step(batch: DataFrame, held: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Added and increased items of every new cart version (session_id, version, cart) against the one before.

    Versions that a session has already passed, and repeated ones, say nothing new; of different carts under one new version
    the greatest text counts. Texts are put in order once, by ranges in which a session's held cart comes first, and read once.
    """
    both = held.select("session_id", "version", "cart", F.lit(False).alias("_new")).unionByName(
        batch.select("session_id", "version", "cart", F.lit(True).alias("_new"))
    )
    cut = segments(both, ["session_id", "_new", "version"], parts)
    # Into a range are carried the version that its first session has passed and that session's newest cart in earlier ranges.
    asked, row = F.col("_new"), F.struct("version", "cart")
    earlier = W.partitionBy("session_id").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    ends = {"_h": F.max(F.when(~asked, row)), "_n": F.max(F.when(asked, row))}
    carry = carried(cut, ["session_id"], ends, {"_h_before": F.max("_h").over(earlier), "_n_before": F.max("_n").over(earlier)})
    carry = read_cart(
        carry.select(
            "_seg", "session_id", F.col("_h_before.version").alias("_passed_before"),
            F.when(_fresh("_n_before.version", "_h_before.version"), F.col("_n_before.cart")).otherwise(F.col("_h_before.cart")).alias("cart"),
        )
    ).select("_seg", "session_id", "_passed_before", F.when(F.col("cart").isNotNull(), clean_items(F.col("raw_items"))).alias("_carried"))

    inside = W.partitionBy("_seg", "session_id").orderBy("_new", "version", "cart")
    marked = cut.withColumns({
        "_passed": F.max(F.when(~asked, F.col("version"))).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_last_of": ~F.coalesce(F.lead(F.struct("_new", "version")).over(inside).eqNullSafe(F.struct("_new", "version")), F.lit(False)),
    })
    known = with_carry(marked, carry, ["session_id"]).withColumn("_passed", F.coalesce("_passed", "_passed_before"))
    kept = known.filter(~asked | (F.col("_last_of") & _fresh("version", "_passed")))
    items = read_cart(kept.select("_seg", "session_id", "version", "_new", "cart", "_carried"))
    items = items.select("_seg", "session_id", "version", "_new", "cart", "_carried", clean_items(F.col("raw_items")).alias("_items"))
    paired = items.withColumns({"_old": F.lag("_items").over(inside), "_newest": F.lead("_new").over(inside).isNull()})
    told = paired.filter("_new").select(
        "session_id", "version", F.when(F.col("_newest"), F.col("cart")).alias("cart"), "_newest",
        changes(F.col("_items"), F.coalesce("_old", "_carried")).alias("_changes"),
    )
    told = materialize(told, "cart-step")
    newest = first_per_key(told.filter("_newest").select("session_id", "version", "cart"), ["session_id"], [F.col("version").desc()])
    return told.select("session_id", "version", F.inline("_changes")), newest


def _fresh(version: str, passed: str) -> Column:
    return F.col(passed).isNull() | (F.col(version) > F.col(passed))


def version_step(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (session_id, request_id, expected_version) that met another version than they expect; sessions start at 1."""
    sessions = batch.select("session_id").distinct().join(held, "session_id", "left").select("session_id", F.coalesce("version", F.lit(1)).alias("version"))
    told = versioned_replace(sessions, batch.select("session_id", "request_id", "expected_version"), "session_id")
    rows = told.filter("NOT applied AND expected_version IS NOT NULL").select("session_id", "request_id", "expected_version", "current_version")
    return rows, told.groupBy("session_id").agg(F.max("current_version").alias("version"))


def cart_changes(versions: DataFrame, folder: str | None = None) -> DataFrame:
    """Run the stream of cart versions to its end: the table of added and increased items."""
    return run_steps(versions.select("session_id", "version", "cart"), "cart-changes", cart_step, ["session_id"], "version", CARTS, folder)


def version_conflicts(requests: DataFrame, folder: str | None = None) -> DataFrame:
    """Run the stream of requests to its end: the table of conflicts."""
    return run_steps(requests, "conflicts", version_step, ["session_id"], "version", VERSIONS, folder)
