"""Orders: totals, lists, lookups and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.functions.money import cents, line_total
from larder.operators.grouping import left_join_many, top_per_key

# The order states.
STATUSES = ["pending", "confirmed", "preparing", "ready", "completed", "cancelled"]
MAX_ORDERS, MAX_SESSION_ORDERS = 500, 200


def clamp(limit: int, highest: int) -> int:
    return max(1, min(limit, highest))


def order_totals(items: DataFrame) -> DataFrame:
    """Money is rounded per line before it is added up (items: order_id, unit_price, quantity)."""
    return items.groupBy("order_id").agg(
        F.sum(line_total(F.col("unit_price"), F.col("quantity"))).alias("total_amount"),
        F.sum(F.coalesce("quantity", F.lit(0))).alias("item_count"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def newest(df: DataFrame, created: str, unique: str, limit: int, highest: int = MAX_ORDERS) -> DataFrame:
    """Newest-first list with a clamped length."""
    return df.orderBy(F.col(created).desc(), F.col(unique).desc()).limit(clamp(limit, highest))


def recent_orders(orders: DataFrame, items: DataFrame, limit: int = 100) -> DataFrame:
    """The newest orders with their item counts. The list is cut first; only its orders' items are added up."""
    listed = newest(orders, "created_at", "order_id", limit)
    wanted = items.join(listed.select("order_id"), "order_id", "left_semi")
    counts = wanted.groupBy("order_id").agg(F.sum("quantity").alias("item_count"))
    return listed.join(counts, "order_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def session_history(orders: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """All orders of every session, one row per order line (orders without lines keep one row).

    ``limit`` keeps a session's newest orders only, clamped to a page of a list.
    """
    newest_first = [F.col("created_at").desc(), F.col("order_id").desc()]
    listed = orders if limit is None else top_per_key(orders, ["session_id"], newest_first, clamp(limit, MAX_SESSION_ORDERS))
    lines = items.select(
        "order_id", "order_item_id", "name", "quantity", cents(F.col("unit_price")).alias("unit_price"),
        line_total(F.col("unit_price"), F.col("quantity")).alias("line_total"),
    )
    return left_join_many(listed, lines, ["order_id"])


def lookup(requests: DataFrame, details: DataFrame, key: str, error: str) -> DataFrame:
    """Point lookups in bulk: requested keys with their row, or the error code."""
    found = details.withColumn("_found", F.lit(True))
    joined = requests.join(found, key, "left")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), error)).drop("_found")


ITEM_FIELDS = ["dish_id", "name", "size_label", "note", "extra_data", "quantity", "unit_price"]
#: Fields of an order that an edit may set, beside its items; contact fields where the table has them.
HEAD_FIELDS = ["status", "note", "contact_name", "contact_phone"]


def edit_errors(orders: DataFrame, items: DataFrame, edits: DataFrame, patches: DataFrame) -> DataFrame:
    """(order_id, error): orders whose edit must not be applied at all, with the first error in rule order."""
    stored = orders.select("order_id", F.lit(True).alias("_stored"))
    head = edits.join(stored, "order_id", "left").select(
        "order_id",
        F.when(F.col("_stored").isNull(), F.struct(F.lit(1).alias("no"), F.lit("order_not_found").alias("error")))
        .when(
            ~F.col("status").isin(STATUSES),
            F.struct(F.lit(2).alias("no"), F.concat(F.lit("invalid_status: "), "status").alias("error")),
        )
        .alias("_e"),
    )
    known = items.select("order_id", "order_item_id", F.lit(True).alias("_known"))
    unnamed = F.col("name").isNull() | F.col("unit_price").isNull()
    lines = patches.join(known, ["order_id", "order_item_id"], "left").select(
        "order_id",
        F.when(
            F.col("order_item_id").isNotNull() & F.col("_known").isNull(),
            F.struct(F.lit(3).alias("no"), F.lit("order_item_not_found").alias("error")),
        )
        .when(
            F.col("order_item_id").isNull() & (F.coalesce("quantity", F.lit(0)) > 0) & unnamed,
            F.struct(F.lit(4).alias("no"), F.lit("order_item_missing_fields").alias("error")),
        )
        .alias("_e"),
    )
    found = head.unionByName(lines).filter("_e is not null")
    return found.groupBy("order_id").agg(F.min("_e").alias("_e")).select("order_id", "_e.error")


def edit_items(items: DataFrame, patches: DataFrame) -> DataFrame:
    """Item rows after the patches: set fields overwrite, a quantity of 0 or less deletes, rows without id are new.

    ``items`` and ``patches`` share the columns order_id, order_item_id and the fields that an edit may set (``ITEM_FIELDS``); both may
    lack the same ones of the optional fields.
    """
    fields = [c for c in ITEM_FIELDS if c in items.columns]
    changed = patches.filter("order_item_id is not null").select(
        "order_id", "order_item_id", F.nullif(F.col("name"), F.lit("")).alias("_name"),
        *[F.col(c).alias(f"_{c}") for c in fields if c != "name"],
    )
    joined = items.join(changed, ["order_id", "order_item_id"], "left")
    edited = joined.filter(F.coalesce("_quantity", F.lit(1)) > 0).select(
        "order_id", "order_item_id", *[F.coalesce(f"_{c}", c).alias(c) for c in fields]
    )
    added = patches.filter("order_item_id is null and coalesce(quantity, 0) > 0")
    return edited.unionByName(added.select("order_id", "order_item_id", *fields)).withColumn(
        "unit_price", cents(F.col("unit_price"))
    )


def edit_orders(
    orders: DataFrame, items: DataFrame, edits: DataFrame, patches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Apply order edits (order_id, status, note) and item patches; orders with an error stay as they were.

    Returns the orders with new totals and their ``error``, and the new item rows.
    """
    errors = materialize(edit_errors(orders, items, edits, patches), "edit-errors")
    good_edits = edits.join(errors, "order_id", "left_anti")
    good_patches = patches.join(errors, "order_id", "left_anti")
    new_items = edit_items(items, good_patches)
    touched = patches.select("order_id").distinct().withColumn("_touched", F.lit(True))
    heads = [c for c in HEAD_FIELDS if c in orders.columns]
    changed = good_edits.select("order_id", *[(F.col(c) if c in good_edits.columns else F.lit(None)).alias(f"_{c}") for c in heads])
    state = (
        orders.join(changed, "order_id", "left")
        .join(order_totals(new_items).select("order_id", F.col("total_amount").alias("_total")), "order_id", "left")
        .join(touched, "order_id", "left")
        .join(errors, "order_id", "left")
    )
    recalculated = F.col("_touched") & F.col("error").isNull()
    return (
        state.select(
            "order_id",
            *[F.coalesce(f"_{c}", c).alias(c) for c in heads],
            F.when(recalculated, F.coalesce("_total", F.lit(0).cast("decimal(18,2)")))
            .otherwise(F.col("total_amount"))
            .alias("total_amount"),
            "error",
        ),
        new_items,
    )
