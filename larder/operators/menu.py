"""The menu: category and dish lists, nested prices and set members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.context import materialize
from larder.functions.text import blank_to_null
from larder.operators.grouping import first_per_key, left_join_many
from larder.operators.mutate import number_new


def price_rows(prices: DataFrame) -> DataFrame:
    """The prices of dishes, one row each; rows with neither label nor price are no price."""
    real = prices.filter("price_label is not null or price is not null")
    return real.select("dish_id", "price_id", F.nullif("price_label", F.lit("")).alias("label"), "price")


def menu_tree(
    categories: DataFrame, dishes: DataFrame, prices: DataFrame, translations: DataFrame, details: DataFrame
) -> DataFrame:
    """One row per category, dish and price. Categories without dishes and dishes without prices keep one row.

    The description is the detail text, else the Chinese translation. Nothing is collected into lists, since a category can hold
    any number of dishes and a dish any number of prices; the menu's order is that of the columns ``MENU_ORDER``, and a
    caller that writes pages sorts by them.
    """
    chinese = translations.filter("lang = 'zh'").select("dish_id", F.col("description").alias("_translated"))
    described = details.select("dish_id", F.col("description").alias("_detail"), "image_url")
    shown = (
        dishes.join(chinese, "dish_id", "left")
        .join(described, "dish_id", "left")
        .select(
            "category_id",
            "dish_id",
            "name",
            "is_set",
            F.col("sort_order").alias("dish_sort"),
            F.coalesce(F.nullif("_detail", F.lit("")), "_translated").alias("description"),
            "image_url",
        )
    )
    sections = categories.select(
        "category_id", "category_name", F.coalesce("sort_order", F.lit(0)).alias("category_sort")
    )
    tree = left_join_many(sections, shown, ["category_id"])
    return left_join_many(tree, price_rows(prices), ["dish_id"])


MENU_ORDER = ["category_sort", "category_id", "dish_sort", "dish_id", "price_id"]


def set_members(set_items: DataFrame, dishes: DataFrame) -> DataFrame:
    """(set_id, item_id, item_name, quantity, sort_order); items without a dish are left out."""
    named = dishes.select(F.col("dish_id").alias("item_id"), F.col("name").alias("item_name"))
    members = set_items.join(named, "item_id")
    return members.select("set_id", "item_id", "item_name", "quantity", "sort_order")


def set_item_list(set_items: DataFrame, dishes: DataFrame, set_id: int) -> DataFrame:
    """The members of one set in menu order."""
    return set_members(set_items.filter(F.col("set_id") == set_id), dishes).orderBy("sort_order", "item_id")


def menu_with_sets(menu: DataFrame, set_items: DataFrame, dishes: DataFrame) -> DataFrame:
    """Menu rows, set dishes with one row for each of their members and its place in the set.

    A set without members and a dish that is no set keep one row, with NULLs.
    """
    members = set_members(set_items, dishes).select(F.col("set_id").alias("dish_id"), F.lit(True).alias("is_set"), "item_id", "item_name", "quantity", "sort_order")
    return left_join_many(menu, members, ["dish_id", "is_set"])


def category_dishes(category_id: int | None, dishes: DataFrame, prices: DataFrame, details: DataFrame) -> DataFrame:
    """The dishes of one category (or of all) with the default price, the number of sizes and the detail fields.

    The default price is the first one, 0 if there is none; sizes are the labelled prices (rows of ``price_rows``).
    """
    listed = dishes if category_id is None else dishes.filter(F.col("category_id") == category_id)
    first = price_rows(prices).groupBy("dish_id").agg(
        F.min_by(F.struct("price"), "price_id")["price"].alias("default_price"), F.count("label").alias("n_sizes")
    )
    shown = details.select("dish_id", "image_url", "description", "tags")
    joined = listed.join(first, "dish_id", "left").join(shown, "dish_id", "left")
    return joined.withColumns({"default_price": F.coalesce("default_price", F.lit(0)), "n_sizes": F.coalesce("n_sizes", F.lit(0))})


def item_picker(listed: DataFrame, language: str = "zh") -> DataFrame:
    """Category lists for picking: ``place`` numbers a category's dishes by name in the language's order."""
    order = W.partitionBy("category_id").orderBy(F.collate("name", language), "dish_id")
    return listed.withColumn("place", F.row_number().over(order).cast("long"))


def category_index(categories: DataFrame) -> DataFrame:
    return categories.orderBy("sort_order", "category_id")


def set_index(dishes: DataFrame) -> DataFrame:
    return dishes.filter("is_set").select("dish_id", "name", "sort_order").orderBy("sort_order", "dish_id")


def create_dishes(
    dishes: DataFrame, new: DataFrame, prices: DataFrame, translations: DataFrame, natural_key: list[str], details: DataFrame | None = None
) -> tuple[DataFrame, ...]:
    """Insert new dishes with their prices, translations and (if given) details, all keyed by the ids the insert gives out.

    Children refer to their dish by its natural key; translations without language or name are skipped. The numbered
    rows are written once and all results read that copy.
    """
    made = materialize(number_new(dishes, new, natural_key, "dish_id"), "new-dishes")
    ids = made.select("dish_id", *natural_key)
    complete = translations.filter(
        blank_to_null(F.col("lang")).isNotNull() & blank_to_null(F.col("translated_name")).isNotNull()
    )
    keyed = [child.join(ids, natural_key).drop(*natural_key) for child in (prices, complete, *([] if details is None else [details]))]
    return (dishes.unionByName(made, allowMissingColumns=True), *keyed)


def first_prices(dishes: DataFrame, prices: DataFrame) -> DataFrame:
    """Every dish with its first price by id; a dish without prices keeps a row with NULLs."""
    first = first_per_key(prices, ["dish_id"], [F.col("price_id").asc_nulls_last()])
    return dishes.join(first, "dish_id", "left")


def duplicate_names(dishes: DataFrame, name: str = "name", key: str = "dish_id") -> DataFrame:
    """Names carried by more than one dish, and how many."""
    return dishes.groupBy(name).agg(F.count(key).alias("n_dishes")).filter("n_dishes > 1")


def duplicate_ids(dishes: DataFrame, name: str = "name", key: str = "dish_id") -> DataFrame:
    """Every dish whose name another dish carries too, one row per id."""
    return dishes.select(name, key).join(duplicate_names(dishes, name, key), name)
