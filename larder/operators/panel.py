"""Clean daily demand: one row per date and dish, without gaps.

The raw sales are read once. Rows are summed to (date, food) inside the map tasks before they move, so a best-selling
food ships one row per date and task; after mapping, a second sum leaves one row per date and dish. That small table is
written once, and the calendar bounds, the list of dishes, the unmapped counts and the panel all come from it. The dense
grid is made by exploding a date sequence per dish, not by joining dates with dishes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.functions.dates import is_closed_day
from larder.operators.grouping import first_per_key
from larder.operators.mutate import upsert

QUANTITIES = ["dinein_qty", "reserve_qty", "qty"]


def floor_at_zero(quantity: Column) -> Column:
    """NULL and negative quantities count as none, row by row, before any summing."""
    return F.greatest(F.coalesce(quantity, F.lit(0)), F.lit(0))


def outside(date: Column, window: tuple[dt.date, dt.date] | None) -> Column:
    """True outside the half-open window [from, to)."""
    if window is None:
        return F.lit(True)
    return ~((date >= F.lit(window[0])) & (date < F.lit(window[1])))


def daily_food_sales(sales: DataFrame, excluded: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Sales rows to (date, food) totals."""
    kept = sales.filter(outside(F.col("close_work_date"), excluded))
    return kept.groupBy("close_work_date", "food_id").agg(
        *[F.sum(floor_at_zero(F.col(q))).alias(q) for q in QUANTITIES],
        F.count(F.lit(1)).alias("src_row_cnt"),
    )


def map_foods(daily: DataFrame, bridge: DataFrame) -> DataFrame:
    """Attach the canonical dish of each food; foods without an active bridge row stay, unmapped."""
    active = bridge.filter("is_active").select("food_id", "canonical_dish_id")
    return daily.join(active, "food_id", "left").withColumn("is_unmapped_food", F.col("canonical_dish_id").isNull())


def demand_by_day(
    sales: DataFrame, bridge: DataFrame, excluded: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """Kept sales per (date, dish), with one row per date for all unmapped foods together (dish NULL)."""
    mapped = map_foods(daily_food_sales(sales, excluded), bridge)
    return mapped.groupBy("close_work_date", "canonical_dish_id").agg(
        *[F.sum(q).alias(q) for q in QUANTITIES],
        F.sum("src_row_cnt").alias("src_row_cnt"),
        F.max("is_unmapped_food").alias("has_unmapped_food"),
        F.count(F.lit(1)).alias("food_cnt"),
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread few rows over all tasks before each grows into a whole calendar (a given count is not coalesced again)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def dense_panel(by_day: DataFrame, dishes: DataFrame, excluded: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Every day between the first and last kept sales date (also of unmapped foods) for every active dish that sold.

    ``has_unmapped_food`` is a flag of mapped rows only, hence always false; ``unmapped_food_cnt`` counts the unmapped
    foods sold on the day. ``is_excluded`` marks days that are zero because their sales were left out.
    """
    demand = by_day.filter(F.col("canonical_dish_id").isNotNull()).drop("food_cnt")
    unmapped = by_day.filter(F.col("canonical_dish_id").isNull()).select(
        "close_work_date", F.col("food_cnt").alias("unmapped_food_cnt")
    )
    span = by_day.agg(F.sequence(F.min("close_work_date"), F.max("close_work_date")).alias("days")).scalar()
    sold = demand.select("canonical_dish_id").distinct()
    spine = spread(dishes.filter("is_active").join(sold, "canonical_dish_id", "left_semi"), "canonical_dish_id")
    grid = spine.select(
        F.explode(span).alias("close_work_date"), "canonical_dish_id", "basename", "price_label", "canonical_name"
    )
    filled = grid.join(demand, ["close_work_date", "canonical_dish_id"], "left").join(
        unmapped, "close_work_date", "left"
    )
    return filled.select(
        "close_work_date",
        "canonical_dish_id",
        "basename",
        "price_label",
        "canonical_name",
        *[F.coalesce(q, F.lit(0)).alias(q) for q in ["qty", "dinein_qty", "reserve_qty"]],
        F.col("src_row_cnt").isNull().alias("is_zero_filled"),
        is_closed_day(F.col("close_work_date")).alias("is_shop_closed"),
        F.coalesce("has_unmapped_food", F.lit(False)).alias("has_unmapped_food"),
        F.coalesce("src_row_cnt", F.lit(0)).alias("src_row_cnt"),
        F.coalesce("unmapped_food_cnt", F.lit(0)).alias("unmapped_food_cnt"),
        (~outside(F.col("close_work_date"), excluded)).alias("is_excluded"),
    )


def clean_daily_demand(
    sales: DataFrame, bridge: DataFrame, dishes: DataFrame, excluded: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """The dense panel from raw sales, in one pass over them."""
    by_day = materialize(demand_by_day(sales, bridge, excluded), "demand-by-day")
    return dense_panel(by_day, dishes, excluded)


FACT_KEYS = ["close_work_date", "canonical_dish_id"]
FACT_VALUES = [
    "qty", "dinein_qty", "reserve_qty", "is_zero_filled", "is_shop_closed", "has_unmapped_food", "src_row_cnt",
]


def refresh_fact(fact: DataFrame, demand: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Replace or add the fact rows of [start, end]; rows outside the window and rows no longer produced stay."""
    inside = F.col("close_work_date").between(start, end)
    window = demand.filter(inside).select(*FACT_KEYS, *FACT_VALUES)
    # Only the window's rows are joined; the others pass as they are.
    return upsert(fact.filter(inside), window, FACT_KEYS).unionByName(fact.filter(~F.coalesce(inside, F.lit(False))))


def latest_menu(menu: DataFrame) -> DataFrame:
    """The newest menu row of each food: dated rows first, newest date, then the largest surrogate."""
    return first_per_key(menu, ["food_id"], [F.col("create_date").desc_nulls_last(), F.col("menu_sk").desc()])


def model_input(fact: DataFrame, dishes: DataFrame, bridge: DataFrame, menu: DataFrame) -> DataFrame:
    """Fact rows with display name, and category and price of the dish's representative food.

    The representative is the smallest food id in text order. The three lookups are joined to one row per dish first,
    so the fact is joined once.
    """
    active = bridge.filter("is_active")
    representative = active.groupBy("canonical_dish_id").agg(F.min(F.col("food_id").cast("string")).alias("food_key"))
    shown = latest_menu(menu).select(
        F.col("food_id").cast("string").alias("food_key"), F.col("category_raw").alias("category"), "price"
    )
    described = (
        dishes.filter("is_active")
        .select("canonical_dish_id", F.col("canonical_name").alias("food_name"))
        .join(representative, "canonical_dish_id", "left")
        .join(shown, "food_key", "left")
        .withColumn("is_market_price", F.col("price").isNull())
        .drop("food_key")
    )
    return fact.join(described, "canonical_dish_id").select(
        "canonical_dish_id",
        "close_work_date",
        "food_name",
        "dinein_qty",
        "reserve_qty",
        "qty",
        F.col("is_shop_closed").alias("is_closed"),
        "category",
        "price",
        "is_market_price",
    )
