"""Raw landed files to clean, checked tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.functions import parsing
from larder.functions.text import strip
from larder.operators import validate
from larder.operators.grouping import first_per_key
from larder.operators.mutate import insert_ignore

# Wire names of the two landed files, and of the model-input export.
SALES_COLUMNS = {
    "CloseWorkDate": "close_work_date",
    "FoodID": "food_id",
    "FoodName": "food_name",
    "dinein(內用)": "dinein_qty",
    "reserve(預訂)": "reserve_qty",
    "數量": "qty",
}
MENU_COLUMNS = {
    "food_id": "food_id",
    "food_name": "food_name",
    "category": "category_raw",
    "price": "price",
    "create_date": "create_date",
    "shop_id": "shop_id",
}
MODEL_INPUT_COLUMNS = {
    "CanonicalDishId": "canonical_dish_id",
    "CloseWorkDate": "close_work_date",
    "FoodName": "food_name",
    "dinein(內用)": "dinein_qty",
    "reserve(預訂)": "reserve_qty",
    "數量": "qty",
    "IsClosed": "is_closed",
    "category": "category",
    "price": "price",
    "IsMarketPrice": "is_market_price",
}
QUANTITIES = ["dinein_qty", "reserve_qty", "qty"]
SALES_REQUIRED = ["close_work_date", "food_id", *QUANTITIES]


def parse_sales(raw: DataFrame) -> DataFrame:
    """Typed sales rows; what cannot be read is NULL. ``is_fractional`` marks quantities an integer cannot hold."""
    named = validate.rename(raw, SALES_COLUMNS)
    fractional = F.lit(False)
    for q in QUANTITIES:
        fractional = fractional | validate.fractional(F.col(q))
    return named.select(
        parsing.landed_date(F.col("close_work_date")).alias("close_work_date"),
        strip(F.col("food_id")).alias("food_id"),
        "food_name",
        *[F.col(q).try_cast("double").try_cast("long").alias(q) for q in QUANTITIES],
        fractional.alias("is_fractional"),
    )


def land_sales(raw: DataFrame) -> DataFrame:
    """Sales rows for staging, stored; one fractional quantity or one NULL in a required column rejects the load.

    The raw rows are read and parsed once: the broken ones are counted on their way to the scratch folder.
    """
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in SALES_REQUIRED])
    counted = validate.Counted(parse_sales(raw), {"n_missing": missing, "n_fractional": F.col("is_fractional")})
    stored = counted.store("landed-sales")
    if any(counted.counts.values()):
        validate.require_none(stored.filter(missing | F.col("is_fractional")), f"sales rows with missing, unreadable or fractional values ({counted.counts})")
    return stored.drop("is_fractional")


def parse_menu(raw: DataFrame) -> DataFrame:
    return validate.rename(raw, MENU_COLUMNS).select(
        strip(F.col("food_id")).alias("food_id"),
        "food_name",
        "category_raw",
        parsing.messy_price(F.col("price")).alias("price"),
        parsing.landed_timestamp(F.col("create_date")).alias("create_date"),
        strip(F.col("shop_id")).alias("shop_id"),
    )


def land_menu(raw: DataFrame) -> DataFrame:
    return validate.require_not_null(parse_menu(raw), ["food_id"])


@dataclass(frozen=True)
class InputConfig:
    """What part of the model input to load. ``ids`` is a one-column frame of id texts."""

    start: dt.date | None = None
    end: dt.date | None = None
    ids: DataFrame | None = None
    drop_duplicates: bool = False
    keep: str = "last"
    line: str | None = None
    keys: list[str] = field(default_factory=lambda: ["canonical_dish_id", "close_work_date"])


def clean_model_input(raw: DataFrame, config: InputConfig) -> DataFrame:
    """Wire columns to typed rows, filtered and without repeated keys. ``line`` orders repeats (it is dropped)."""
    validate.require_columns(raw, list(MODEL_INPUT_COLUMNS))
    extra = [config.line] if config.line else []
    df = raw.select(*[F.col(f"`{a}`").alias(n) for a, n in MODEL_INPUT_COLUMNS.items()], *extra)
    df = df.withColumns(
        {
            "close_work_date": parsing.landed_date(F.col("close_work_date")),
            **{c: parsing.number(F.col(c)) for c in [*QUANTITIES, "price", "is_closed", "is_market_price"]},
        }
    )
    if config.start:
        df = df.filter(F.col("close_work_date") >= F.lit(config.start))
    if config.end:
        df = df.filter(F.col("close_work_date") <= F.lit(config.end))
    if config.ids is not None:
        allowed = config.ids.select(F.col(config.ids.columns[0]).cast("string").alias("_id")).distinct()
        df = df.join(allowed, F.col("canonical_dish_id").cast("string") == F.col("_id"), "left_semi")
    if config.drop_duplicates:
        if not config.line:
            raise ValueError("dropping repeats needs a line column that orders them")
        order = F.col(config.line).desc() if config.keep == "last" else F.col(config.line).asc()
        df = first_per_key(df, config.keys, [order])
    return df.drop(*extra)


def model_input_violations(df: DataFrame, config: InputConfig) -> DataFrame:
    """(rule, n_violations) for the contract of the model input."""
    rules = {
        "target is a number": F.col("qty").isNotNull(),
        "target is not negative": F.col("qty") >= 0,
        "is_closed is 0 or 1": validate.zero_or_one(F.col("is_closed")),
        "is_market_price is 0 or 1": validate.zero_or_one(F.col("is_market_price")),
    }
    return validate.check_constraints(df, rules).unionByName(validate.check_unique(df, config.keys, "one row per key"))


def load_and_clean(raw: DataFrame, config: InputConfig) -> DataFrame:
    """``clean_model_input``, refused if any rule of the contract is broken.

    The cleaned rows are written once; the checks and the caller both read that copy.
    """
    df = materialize(clean_model_input(raw, config), "model-input")
    validate.require_none(model_input_violations(df, config).filter("n_violations > 0"), "model input")
    return df


# Columns of a backtest file, and its key.
BACKTEST_REQUIRED = {
    "run_id": "string", "fold_id": "int", "forecast_origin_date": "date", "target_date": "date", "canonical_dish_id": "long",
    "model_version": "string", "y_true": "double", "yhat": "double", "residual": "double", "abs_error": "double",
}
BACKTEST_OPTIONAL = {"baseline_method": "string", "created_at": "timestamp"}
BACKTEST_KEY = ["run_id", "fold_id", "model_version", "canonical_dish_id", "target_date"]


def parse_backtest(raw: DataFrame) -> DataFrame:
    """A backtest file as typed rows: the required columns, and the optional ones it has."""
    validate.require_columns(raw, list(BACKTEST_REQUIRED))
    wanted = {**BACKTEST_REQUIRED, **{c: t for c, t in BACKTEST_OPTIONAL.items() if c in raw.columns}}
    readers = {"date": parsing.landed_date, "timestamp": parsing.landed_timestamp}
    line = ["_line"] if "_line" in raw.columns else []
    return raw.select(
        *[(readers[t](F.col(c)) if t in readers else F.col(c).try_cast(t)).alias(c) for c, t in wanted.items()], *line
    )


def load_backtest(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Add the rows of a backtest file whose key is not stored yet, of repeats the first in the file; loading a file
    twice changes nothing."""
    lined = raw.withColumn("_line", F.monotonically_increasing_id())
    rows = validate.require_not_null(parse_backtest(lined), list(BACKTEST_REQUIRED))
    return insert_ignore(stored, rows, BACKTEST_KEY, [F.col("_line")])
