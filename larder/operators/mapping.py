"""Unstable till ids to canonical dishes: parse menu names, number new dishes, maintain the bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.functions.parsing import display_name, split_name
from larder.operators.grouping import first_per_key
from larder.operators.mutate import insert_new, upsert


def latest_by_load(menu: DataFrame) -> DataFrame:
    """The newest row per food: dated rows first, newest date, newest load, then the largest surrogate."""
    order = [F.col("create_date").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("menu_sk").desc()]
    return first_per_key(menu.filter("food_id is not null"), ["food_id"], order)


def parsed_menu(menu: DataFrame) -> DataFrame:
    """Latest menu rows with base name, label and display name; rows with a blank name are left out."""
    base, label = split_name(F.col("food_name"))
    named = latest_by_load(menu).withColumns({"basename": base, "price_label": label}).filter("basename is not null")
    return named.withColumn("canonical_name", display_name(F.col("basename"), F.col("price_label")))


def add_dishes(dishes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Insert the (base name, label) pairs not known yet; known dishes are never changed."""
    source = parsed.select("basename", "price_label", "canonical_name", F.lit(True).alias("is_active"))
    return insert_new(dishes, source, ["basename", "price_label"], "canonical_dish_id")


def refresh_bridge(bridge: DataFrame, parsed: DataFrame, dishes: DataFrame) -> DataFrame:
    """Point every parsed food at its dish; foods no longer on the menu keep their row, seen dates stay."""
    source = parsed.join(
        dishes.select("basename", "price_label", "canonical_dish_id"), ["basename", "price_label"]
    ).select(
        "food_id",
        "canonical_dish_id",
        F.col("food_name").alias("source_menu_food_name"),
        F.col("category_raw").alias("source_menu_category_raw"),
        F.col("create_date").cast("date").alias("source_menu_snapshot_date"),
        F.lit(True).alias("is_active"),
    )
    return upsert(bridge, source, ["food_id"])


def sales_span_by_food(sales: DataFrame) -> DataFrame:
    return (
        sales.filter("food_id is not null")
        .groupBy("food_id")
        .agg(F.min("close_work_date").alias("first_seen_date"), F.max("close_work_date").alias("last_seen_date"))
    )


def backfill_seen(bridge: DataFrame, spans: DataFrame, extend: bool = False) -> DataFrame:
    """Write first and last sales dates to the bridge.

    By default only empty dates are filled, so ``last_seen_date`` freezes once set; ``extend`` widens the span instead.
    """
    patch = spans.select(
        "food_id", F.col("first_seen_date").alias("_first"), F.col("last_seen_date").alias("_last")
    )
    joined = bridge.join(patch, "food_id", "left")
    if extend:
        first, last = F.least("first_seen_date", "_first"), F.greatest("last_seen_date", "_last")
    else:
        first, last = F.coalesce("first_seen_date", "_first"), F.coalesce("last_seen_date", "_last")
    new = {"first_seen_date": first, "last_seen_date": last}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in bridge.columns])


def unmapped_foods(sales: DataFrame, bridge: DataFrame, limit: int | None = None) -> DataFrame:
    """Food ids that were sold but are not in the bridge, ordered; ``limit`` makes it a top list."""
    found = sales.filter("food_id is not null").select("food_id").distinct()
    missing = found.join(bridge.select("food_id"), "food_id", "left_anti").orderBy("food_id")
    return missing.limit(limit) if limit else missing


def build_mapping(
    menu: DataFrame, sales: DataFrame, dishes: DataFrame, bridge: DataFrame, extend: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The whole mapping refresh: new dishes, refreshed bridge with seen dates. Each stage is written once."""
    parsed = materialize(parsed_menu(menu), "parsed-menu")
    all_dishes = materialize(add_dishes(dishes, parsed), "dishes")
    fresh = refresh_bridge(bridge, parsed, all_dishes)
    return all_dishes, backfill_seen(fresh, sales_span_by_food(sales), extend)


def variant_rows(menu: DataFrame, category: Column, price: Column) -> DataFrame:
    """Menu file rows to distinct (category, base name, label, price) variants; no label stays NULL."""
    base, label = split_name(F.col("food_name"))
    rows = menu.select(
        category.alias("category"), base.alias("basename"), F.nullif(label, F.lit("single")).alias("price_label"),
        price.alias("price"),
    )
    return rows.filter("basename is not null").distinct()
