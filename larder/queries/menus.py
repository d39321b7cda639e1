"""Menu queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import table
from larder.functions.text import search_text as compose
from larder.operators import menu as menus
from larder.operators import mutate
from larder.queries import bindings as b
from larder.queries.registry import query

# --- menu bindings: category = brand, dish = part, up to three price rows per dish ------------------------------------


def categories(spark: SparkSession, folder: str) -> DataFrame:
    brands = table(spark, folder, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return brands.select(
        number.alias("category_id"), F.col("p_brand").alias("category_name"), (number % 7).alias("sort_order")
    )


b.CTE["category"] = (
    [],
    "SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS category_id, p_brand AS category_name, "
    "CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 7 AS sort_order FROM part",
)


def dishes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS category_id", "p_partkey AS dish_id", "p_name AS name",
        "p_size % 10 = 0 AS is_set", "p_size AS sort_order",
    )


b.CTE["mdish"] = (
    [],
    "SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS category_id, p_partkey AS dish_id, p_name AS name, "
    "p_size % 10 = 0 AS is_set, p_size AS sort_order FROM part",
)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """A regular price, a large price, and a row with neither label nor price, each for some dishes."""
    part = table(spark, folder, "part")
    regular = part.filter("p_size % 4 <> 0").selectExpr(
        "p_partkey AS dish_id", "p_partkey * 3 AS price_id", "p_type AS price_label", "CAST(p_retailprice AS DECIMAL(12,2)) AS price"
    )
    large = part.filter("p_size % 3 = 0").selectExpr(
        "p_partkey AS dish_id", "p_partkey * 3 + 1 AS price_id", "IF(p_size % 2 = 0, 'large', '') AS price_label",
        "CAST(p_retailprice * 2 AS DECIMAL(12,2)) AS price",
    )
    none = part.filter("p_size % 11 = 0").selectExpr(
        "p_partkey AS dish_id", "p_partkey * 3 + 2 AS price_id", "CAST(NULL AS STRING) AS price_label", "CAST(NULL AS DECIMAL(12,2)) AS price"
    )
    return regular.unionByName(large).unionByName(none)


b.CTE["mprice"] = (
    [],
    """SELECT p_partkey AS dish_id, p_partkey * 3 AS price_id, p_type AS price_label, CAST(p_retailprice AS DECIMAL(12,2)) AS price
FROM part WHERE p_size % 4 <> 0
UNION ALL SELECT p_partkey, p_partkey * 3 + 1, CASE WHEN p_size % 2 = 0 THEN 'large' ELSE '' END, CAST(p_retailprice * 2 AS DECIMAL(12,2))
FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, p_partkey * 3 + 2, NULL, NULL FROM part WHERE p_size % 11 = 0""",
)
b.CTE["pricetext"] = (
    ["mprice"],
    """SELECT dish_id, count(*) FILTER (WHERE price_label <> '') AS n_sizes, min_by(price, price_id) AS first_price
FROM mprice WHERE price_label IS NOT NULL OR price IS NOT NULL GROUP BY dish_id""",
)


def translations(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").filter("p_size % 2 = 0")
    return part.selectExpr("p_partkey AS dish_id", "upper(p_name) AS translated_name", "concat('about ', p_name) AS d").selectExpr(
        "dish_id", "translated_name", "inline(array(struct('zh' AS lang, d AS description), struct('en' AS lang, 'english' AS description)))"
    )


def details(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").filter("p_size % 3 <> 2").selectExpr(
        "p_partkey AS dish_id", "CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN NULL ELSE concat('detail ', p_type) END AS description",
        "concat('/images/', p_partkey, '.webp') AS image_url", "concat(lower(p_type), ', ', lower(p_brand)) AS tags",
    )


b.CTE["described"] = (
    [],
    """SELECT p_partkey AS dish_id, CASE WHEN p_size % 3 <> 2 AND p_size % 5 > 1 THEN 'detail ' || p_type
    WHEN p_size % 2 = 0 THEN 'about ' || p_name END AS description,
  CASE WHEN p_size % 3 <> 2 THEN '/images/' || p_partkey || '.webp' END AS image_url,
  CASE WHEN p_size % 3 <> 2 THEN CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 > 1 THEN 'detail ' || p_type END END AS detail,
  CASE WHEN p_size % 3 <> 2 THEN lower(p_type) || ', ' || lower(p_brand) END AS tags FROM part""",
)


def set_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders play sets: order key = set id, its lines the members (one row per food)."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item_id")).agg(
        F.sum("l_quantity").cast("long").alias("quantity"), F.min("l_linenumber").alias("sort_order")
    )


b.CTE["sitem"] = (
    [],
    "SELECT l_orderkey AS set_id, l_partkey AS item_id, CAST(sum(l_quantity) AS BIGINT) AS quantity, min(l_linenumber) AS sort_order "
    "FROM lineitem GROUP BY ALL",
)


@query(
    b.with_(
        ["category", "mdish", "mprice", "described"],
        """SELECT category_id, category_name, c.sort_order AS category_sort, d.dish_id, d.name, is_set, d.sort_order AS dish_sort,
  s.description, image_url, price_id, nullif(price_label, '') AS label, CAST(price AS DOUBLE) AS price
FROM category c LEFT JOIN mdish d USING (category_id) LEFT JOIN described s USING (dish_id)
LEFT JOIN (SELECT * FROM mprice WHERE price_label IS NOT NULL OR price IS NOT NULL) p ON p.dish_id = d.dish_id""",
    )
)
def menu_tree(spark: SparkSession, folder: str) -> DataFrame:
    return menus.menu_tree(
        categories(spark, folder), dishes(spark, folder), prices(spark, folder), translations(spark, folder), details(spark, folder)
    )


@query(
    b.with_(
        ["mdish", "sitem"],
        """SELECT d.dish_id, d.name, d.is_set, s.item_id, i.name AS item_name, quantity, CAST(s.sort_order AS BIGINT) AS sort_order
FROM mdish d LEFT JOIN (sitem s JOIN mdish i ON i.dish_id = s.item_id) ON s.set_id = d.dish_id AND d.is_set""",
    )
)
def menu_with_sets(spark: SparkSession, folder: str) -> DataFrame:
    every = dishes(spark, folder)
    return menus.menu_with_sets(every.select("dish_id", "name", "is_set"), set_items(spark, folder), every)


@query(
    b.with_(
        ["mdish", "pricetext", "described"],
        """SELECT category_id, d.dish_id, d.name, CAST(coalesce(first_price, 0) AS DOUBLE) AS default_price, coalesce(n_sizes, 0) AS n_sizes,
  detail AS description, image_url, tags
FROM mdish d LEFT JOIN pricetext USING (dish_id) LEFT JOIN described USING (dish_id)""",
    )
)
def category_dishes(spark: SparkSession, folder: str) -> DataFrame:
    rows = menus.category_dishes(None, dishes(spark, folder), prices(spark, folder), details(spark, folder))
    return rows.select("category_id", "dish_id", "name", "default_price", "n_sizes", "description", "image_url", "tags")


@query(b.with_(["mdish"], "SELECT dish_id, name, CAST(sort_order AS BIGINT) AS sort_order FROM mdish WHERE is_set"))
def set_index(spark: SparkSession, folder: str) -> DataFrame:
    return menus.set_index(dishes(spark, folder))


@query(
    b.with_(
        ["mdish", "sitem"],
        "SELECT set_id, item_id, i.name AS item_name, quantity, CAST(s.sort_order AS BIGINT) AS sort_order "
        "FROM sitem s JOIN mdish i ON i.dish_id = s.item_id",
    )
)
def set_members(spark: SparkSession, folder: str) -> DataFrame:
    """The members of all sets, one row each."""
    return menus.set_members(set_items(spark, folder), dishes(spark, folder))


@query(
    b.with_(
        ["mdish", "pricetext"],
        "SELECT category_id, row_number() OVER (PARTITION BY category_id ORDER BY name, d.dish_id) AS place, d.dish_id, name, "
        "CAST(coalesce(first_price, 0) AS DOUBLE) AS default_price, coalesce(n_sizes, 0) AS n_sizes "
        "FROM mdish d LEFT JOIN pricetext USING (dish_id)",
    )
)
def item_picker(spark: SparkSession, folder: str) -> DataFrame:
    listed = menus.category_dishes(None, dishes(spark, folder), prices(spark, folder), details(spark, folder))
    return menus.item_picker(listed).select("category_id", "place", "dish_id", "name", "default_price", "n_sizes")


@query(
    b.with_(
        ["category", "mdish"],
        """SELECT category_id, category_name, c.sort_order, count(*) FILTER (WHERE is_set) AS n_sets, count(*) AS n_dishes
FROM category c JOIN mdish d USING (category_id) GROUP BY ALL""",
    )
)
def category_index(spark: SparkSession, folder: str) -> DataFrame:
    """The category list in menu order with its dish and set counts."""
    counts = dishes(spark, folder).groupBy("category_id").agg(
        F.count_if("is_set").alias("n_sets"), F.count(F.lit(1)).alias("n_dishes")
    )
    return menus.category_index(categories(spark, folder).join(counts, "category_id"))


@query(
    b.with_(
        ["mdish", "mprice"],
        """SELECT d.dish_id, name, price_id, price_label, CAST(price AS DOUBLE) AS price FROM mdish d LEFT JOIN (
  SELECT * FROM mprice QUALIFY row_number() OVER (PARTITION BY dish_id ORDER BY price_id) = 1) p USING (dish_id)""",
    )
)
def first_price(spark: SparkSession, folder: str) -> DataFrame:
    return menus.first_prices(dishes(spark, folder).select("dish_id", "name"), prices(spark, folder))


@query("SELECT p_name AS name, p_partkey AS dish_id, count(*) OVER (PARTITION BY p_name) AS n_dishes FROM part QUALIFY n_dishes > 1")
def duplicate_names(spark: SparkSession, folder: str) -> DataFrame:
    """All ids behind every name that several dishes carry."""
    return menus.duplicate_ids(dishes(spark, folder))


@query(
    b.with_(
        ["mprice"],
        """SELECT dish_id, price_id, price_label, CAST(price AS DOUBLE) AS price FROM mprice
WHERE dish_id NOT IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)
UNION ALL SELECT p_partkey, p_partkey * 3 + v, 'new ' || v, p_retailprice + v FROM part, (VALUES (0), (1)) AS t(v)
WHERE p_size % 5 = 0 AND p_size % 10 <> 0""",
    )
)
def replace_children(spark: SparkSession, folder: str) -> DataFrame:
    """Price lists replaced for some dishes; some of these end up without any price."""
    part = table(spark, folder, "part").filter("p_size % 5 = 0")
    new = part.filter("p_size % 10 <> 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).selectExpr(
        "p_partkey AS dish_id", "p_partkey * 3 + v AS price_id", "concat('new ', v) AS price_label",
        "CAST(p_retailprice + v AS DECIMAL(12,2)) AS price",
    )
    parents = part.selectExpr("p_partkey AS dish_id")
    return mutate.replace_children(prices(spark, folder), new, parents, "dish_id")


@query(
    b.with_(
        ["category", "mdish", "sitem"],
        """SELECT 'category_has_related_dishes' AS error, category_id AS blocked_id FROM category
WHERE category_id IN (SELECT category_id FROM mdish)
UNION ALL SELECT 'dish_in_use_in_set', dish_id FROM mdish WHERE dish_id IN (SELECT item_id FROM sitem)""",
    )
)
def delete_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Categories and dishes that must not be deleted because something uses them."""
    held = mutate.blocked_by(categories(spark, folder), dishes(spark, folder), "category_id", "category_id")
    used = mutate.blocked_by(dishes(spark, folder), set_items(spark, folder), "dish_id", "item_id")
    return held.select(F.lit("category_has_related_dishes").alias("error"), F.col("category_id").alias("blocked_id")).unionByName(
        used.select(F.lit("dish_in_use_in_set").alias("error"), F.col("dish_id").alias("blocked_id"))
    )


@query(
    b.with_(
        ["mdish"],
        """SELECT 'dish' AS kind, n.dish_id, n.name, CAST(NULL AS DOUBLE) AS price FROM fresh n
UNION ALL SELECT 'price', n.dish_id, n.name, CAST(10 + n.category_id AS DOUBLE) FROM fresh n
UNION ALL SELECT 'translation', n.dish_id, upper(n.name), NULL FROM fresh n WHERE n.category_id % 2 = 0
UNION ALL SELECT 'detail', n.dish_id, 'served by ' || n.name, NULL FROM fresh n""",
        fresh="""SELECT (SELECT max(dish_id) FROM mdish)
  + row_number() OVER (ORDER BY md5(category_id || chr(1) || name), category_id, name) AS dish_id, category_id, name
FROM (SELECT DISTINCT 1000 + s_nationkey AS category_id, 'house ' || s_suppkey AS name FROM supplier)""",
    )
)
def create_with_children(spark: SparkSession, folder: str) -> DataFrame:
    """New house dishes (one per supplier) with a price and, for half, a usable translation."""
    stored = dishes(spark, folder)
    new = table(spark, folder, "supplier").selectExpr(
        "CAST(1000 + s_nationkey AS BIGINT) AS category_id", "concat('house ', s_suppkey) AS name", "false AS is_set", "0 AS sort_order"
    )
    key = ["category_id", "name"]
    price_rows = new.selectExpr(*key, "CAST(10 + category_id AS DECIMAL(12,2)) AS price")
    texts = new.selectExpr(*key, "IF(category_id % 2 = 0, 'zh', ' ') AS lang", "upper(name) AS translated_name")
    about = new.selectExpr(*key, "concat('served by ', name) AS description")
    every, made_prices, made_texts, made_details = menus.create_dishes(stored, new, price_rows, texts, key, about)
    made = every.join(stored.select("dish_id"), "dish_id", "left_anti")
    names = made.select("dish_id", "name")
    empty = F.lit(None).cast("decimal(12,2)").alias("price")
    return (
        made.select(F.lit("dish").alias("kind"), "dish_id", "name", empty)
        .unionByName(made_prices.join(names, "dish_id").select(F.lit("price").alias("kind"), "dish_id", "name", "price"))
        .unionByName(made_texts.select(F.lit("translation").alias("kind"), "dish_id", F.col("translated_name").alias("name"), empty))
        .unionByName(made_details.select(F.lit("detail").alias("kind"), "dish_id", F.col("description").alias("name"), empty))
    )


@query(
    b.with_(
        ["mdish", "described"],
        """SELECT dish_id, concat_ws(' | ', name, nullif(detail, ''), tags) AS search_text FROM mdish LEFT JOIN described USING (dish_id)""",
    )
)
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = dishes(spark, folder).select("dish_id", "name").join(details(spark, folder), "dish_id", "left")
    return rows.select("dish_id", compose(F.col("name"), F.col("description"), F.col("tags")).alias("search_text"))
