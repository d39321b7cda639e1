"""Parsing, validation, canonical mapping and table-change queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import table
from larder.functions import parsing
from larder.operators import mapping as maps
from larder.operators import mutate, validate
from larder.plans import staging
from larder.queries import bindings as b
from larder.queries.registry import query
from larder.sources.readers import pending

# A menu name per part: plain labels, digit labels, full-width digits, missing base, blank.
NAME_SQL = """CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name || '(' || p_size || ')' WHEN 2 THEN '(' || p_type || ')'
  WHEN 3 THEN '  ' WHEN 4 THEN ' ' || p_name || ' (' || p_type || ') ' WHEN 5 THEN p_name || '(a)(b)'
  WHEN 6 THEN p_name || '(３)' ELSE p_name || '(' || p_type || ')' END"""


@query(
    rf"""SELECT p_partkey, CASE WHEN split THEN base WHEN s <> '' THEN s END AS basename,
  CASE WHEN split THEN label ELSE 'single' END AS price_label,
  CASE WHEN split THEN base || '(' || label || ')' WHEN s <> '' THEN s END AS canonical_name
FROM (SELECT *, base <> '' AND label <> '' AND NOT regexp_matches(label, '[\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨]') AS split
      FROM (SELECT *, trim(regexp_extract(s, '^(.*)\(([^)]+)\)$', 1)) AS base,
              trim(regexp_extract(s, '^(.*)\(([^)]+)\)$', 2)) AS label
            FROM (SELECT p_partkey, trim({NAME_SQL}) AS s FROM part)))"""
)
def parse_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_partkey", F.expr(NAME_SQL).alias("food_name"))
    base, label = parsing.split_name(F.col("food_name"))
    named = names.select("p_partkey", base.alias("basename"), label.alias("price_label"))
    return named.withColumn("canonical_name", parsing.display_name(F.col("basename"), F.col("price_label")))


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR)
  AS close_work_date FROM orders"""
)
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written as yyyymmdd, serial day, with slashes, with a time, and two unreadable ways."""
    written = F.expr(
        """CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyyMMdd')
        WHEN 1 THEN concat(' ', datediff(o_orderdate, DATE'1899-12-30')) WHEN 2 THEN date_format(o_orderdate, 'yyyy/M/d')
        WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 4 THEN '20231399' ELSE 'soon' END"""
    )
    raw = table(spark, folder, "orders").select("o_orderkey", written.alias("text"))
    return raw.select("o_orderkey", parsing.landed_date(F.col("text")).alias("close_work_date"))


@query(
    """SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL
  WHEN 6 THEN p_retailprice + 0.01 ELSE p_retailprice END AS DOUBLE) AS price FROM part"""
)
def clean_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices with separators, signs and blanks; ``1-2``, ``-`` and empty texts have no price; .005 rounds up."""
    written = F.expr(
        """CASE p_partkey % 7 WHEN 0 THEN format_number(p_retailprice, 2)
        WHEN 1 THEN concat('$', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING))
        WHEN 2 THEN concat('  ', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), ' ')
        WHEN 3 THEN '1-2' WHEN 4 THEN '-' WHEN 5 THEN ''
        ELSE concat(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), '5') END"""
    )
    return table(spark, folder, "part").select("p_partkey", parsing.messy_price(written).alias("price"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE p_retailprice END AS price
FROM part"""
)
def prices_null_literal(spark: SparkSession, folder: str) -> DataFrame:
    written = F.expr(
        """CASE p_partkey % 5 WHEN 1 THEN 'null ' WHEN 2 THEN ' ' WHEN 3 THEN 'n/a'
        ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END"""
    )
    return table(spark, folder, "part").select("p_partkey", parsing.menu_price(written).alias("price"))


@query(
    """SELECT DISTINCT CASE WHEN p_size % 10 = 0 THEN '[' || p_size || ']' ELSE p_brand END AS category, p_name AS basename,
  p_type AS price_label, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_retailprice END AS price,
  p_name LIKE '%gear' AS is_set FROM part"""
)
def category_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Menu file rows grouped into variants; gears play the set menus."""
    part = table(spark, folder, "part")
    dish = F.regexp_replace("p_name", "gear$", "套餐")
    raw = part.select(
        F.concat(dish, F.lit("("), "p_type", F.lit(")")).alias("food_name"),
        F.expr("concat('[', p_size, ']', IF(p_size % 10 = 0, '', concat(' ', p_brand)))").alias("category"),
        F.expr("IF(p_size % 9 = 0, 'NULL', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING))").alias("price"),
    )
    rows = maps.variant_rows(raw, parsing.category_name(F.col("category")), parsing.menu_price(F.col("price")))
    rows = rows.withColumn("is_set", parsing.is_set_name(F.col("basename")))
    return rows.withColumn("basename", F.regexp_replace("basename", "套餐$", "gear"))


# --- canonical mapping -----------------------------------------------------------------------------------------------

b.CTE["parsed"] = (
    ["menu"],
    r"""SELECT *, regexp_extract(food_name, '^(.*)\(([^)]+)\)$', 1) AS basename,
  regexp_extract(food_name, '^(.*)\(([^)]+)\)$', 2) AS price_label FROM menu
QUALIFY row_number() OVER (PARTITION BY food_id
  ORDER BY create_date DESC NULLS LAST, loaded_at DESC NULLS LAST, menu_sk DESC) = 1""",
)
b.CTE["old_dish"] = (
    [],
    """SELECT min(p_partkey) + 1 AS canonical_dish_id, p_name AS basename, p_type AS price_label,
  p_name || '(' || p_type || ')' AS canonical_name, true AS is_active FROM part WHERE p_partkey % 2 = 0 AND p_size > 10
GROUP BY p_name, p_type""",
)
b.CTE["all_dish"] = (
    ["old_dish", "parsed"],
    """SELECT * FROM old_dish UNION ALL
SELECT (SELECT max(canonical_dish_id) FROM old_dish)
    + row_number() OVER (ORDER BY md5(basename || chr(1) || price_label), basename, price_label),
  basename, price_label, canonical_name, true
FROM (SELECT DISTINCT basename, price_label, basename || '(' || price_label || ')' AS canonical_name FROM parsed
      ANTI JOIN old_dish USING (basename, price_label))""",
)
b.CTE["old_bridge"] = (
    [],
    """SELECT p_partkey AS food_id, CAST(-1 AS BIGINT) AS canonical_dish_id, 'old name' AS source_menu_food_name,
  CAST(NULL AS VARCHAR) AS source_menu_category_raw, CAST(NULL AS DATE) AS source_menu_snapshot_date,
  CASE WHEN p_partkey % 2 = 0 THEN DATE '1997-01-01' END AS first_seen_date,
  CASE WHEN p_partkey % 5 = 0 THEN DATE '1998-01-01' END AS last_seen_date, false AS is_active
FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT -1 - p_partkey, -1, 'gone', NULL, NULL, NULL, NULL, true FROM part WHERE p_partkey % 10 = 0""",
)
b.CTE["new_bridge"] = (
    ["old_bridge", "parsed", "all_dish"],
    """SELECT coalesce(o.food_id, s.food_id) AS food_id,
  CASE WHEN s.food_id IS NULL THEN o.canonical_dish_id ELSE s.canonical_dish_id END AS canonical_dish_id,
  CASE WHEN s.food_id IS NULL THEN o.source_menu_food_name ELSE s.food_name END AS source_menu_food_name,
  CASE WHEN s.food_id IS NULL THEN o.source_menu_category_raw ELSE s.category_raw END AS source_menu_category_raw,
  CASE WHEN s.food_id IS NULL THEN o.source_menu_snapshot_date ELSE s.create_date END AS source_menu_snapshot_date,
  o.first_seen_date, o.last_seen_date, s.food_id IS NOT NULL OR o.is_active AS is_active
FROM old_bridge o FULL JOIN (SELECT p.*, d.canonical_dish_id FROM parsed p JOIN all_dish d USING (basename, price_label)) s
  ON o.food_id = s.food_id""",
)
b.CTE["span"] = (
    ["sales"],
    "SELECT food_id, min(close_work_date) AS lo, max(close_work_date) AS hi FROM sales GROUP BY food_id",
)
DATES_AS_TEXT = """REPLACE (CAST(first_seen_date AS VARCHAR) AS first_seen_date, CAST(last_seen_date AS VARCHAR) AS last_seen_date,
  CAST(source_menu_snapshot_date AS VARCHAR) AS source_menu_snapshot_date)"""


def old_dishes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").filter("p_partkey % 2 = 0 and p_size > 10")
    return part.groupBy(F.col("p_name").alias("basename"), F.col("p_type").alias("price_label")).agg(
        (F.min("p_partkey") + 1).alias("canonical_dish_id")
    ).select(
        "canonical_dish_id",
        "basename",
        "price_label",
        F.expr("concat(basename, '(', price_label, ')')").alias("canonical_name"),
        F.lit(True).alias("is_active"),
    )


def old_bridge(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    empty = {"source_menu_category_raw": "string", "source_menu_snapshot_date": "date"}
    known = part.filter("p_partkey % 3 = 0").selectExpr(
        "p_partkey AS food_id", "-1L AS canonical_dish_id", "'old name' AS source_menu_food_name",
        *[f"CAST(NULL AS {t}) AS {c}" for c, t in empty.items()],
        "IF(p_partkey % 2 = 0, DATE'1997-01-01', NULL) AS first_seen_date",
        "IF(p_partkey % 5 = 0, DATE'1998-01-01', NULL) AS last_seen_date", "false AS is_active",
    )
    gone = part.filter("p_partkey % 10 = 0").selectExpr(
        "-1 - p_partkey AS food_id", "-1L AS canonical_dish_id", "'gone' AS source_menu_food_name",
        *[f"CAST(NULL AS {t}) AS {c}" for c, t in empty.items()],
        "CAST(NULL AS DATE) AS first_seen_date", "CAST(NULL AS DATE) AS last_seen_date", "true AS is_active",
    )
    return known.unionByName(gone)


@query(b.with_(["all_dish"], "SELECT * FROM all_dish"))
def canonical_insert_only(spark: SparkSession, folder: str) -> DataFrame:
    return maps.add_dishes(old_dishes(spark, folder), maps.parsed_menu(b.menu(spark, folder)))


@query(b.with_(["new_bridge"], f"SELECT * {DATES_AS_TEXT} FROM new_bridge"))
def bridge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    parsed = maps.parsed_menu(b.menu(spark, folder))
    dishes = maps.add_dishes(old_dishes(spark, folder), parsed)
    return maps.refresh_bridge(old_bridge(spark, folder), parsed, dishes)


@query(
    b.with_(
        ["old_bridge", "span"],
        """SELECT food_id, CAST(coalesce(first_seen_date, lo) AS VARCHAR) AS first_seen_date,
  CAST(coalesce(last_seen_date, hi) AS VARCHAR) AS last_seen_date,
  CAST(coalesce(least(first_seen_date, lo), first_seen_date, lo) AS VARCHAR) AS widest_first,
  CAST(coalesce(greatest(last_seen_date, hi), last_seen_date, hi) AS VARCHAR) AS widest_last
FROM old_bridge LEFT JOIN span USING (food_id)""",
    )
)
def seen_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Seen dates after a fill-the-gaps backfill, beside those of the widening one."""
    stored, spans = old_bridge(spark, folder), maps.sales_span_by_food(b.sales(spark, folder))
    wide = maps.backfill_seen(stored, spans, extend=True).select(
        "food_id", F.col("first_seen_date").alias("widest_first"), F.col("last_seen_date").alias("widest_last")
    )
    filled = maps.backfill_seen(stored, spans).select("food_id", "first_seen_date", "last_seen_date")
    return filled.join(wide, "food_id")


@query(
    b.with_(
        ["new_bridge", "span", "all_dish"],
        """SELECT food_id, n.canonical_dish_id, d.canonical_name, source_menu_category_raw,
  CAST(coalesce(first_seen_date, lo) AS VARCHAR) AS first_seen_date, CAST(coalesce(last_seen_date, hi) AS VARCHAR) AS last_seen_date,
  n.is_active
FROM new_bridge n LEFT JOIN span USING (food_id) LEFT JOIN all_dish d USING (canonical_dish_id)""",
    )
)
def canonical_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The whole mapping refresh, with the dish name each food ends up at."""
    dishes, bridge = maps.build_mapping(
        b.menu(spark, folder), b.sales(spark, folder), old_dishes(spark, folder), old_bridge(spark, folder)
    )
    named = bridge.join(dishes.select("canonical_dish_id", "canonical_name"), "canonical_dish_id", "left")
    return named.select(
        "food_id", "canonical_dish_id", "canonical_name", "source_menu_category_raw", "first_seen_date", "last_seen_date",
        "is_active",
    )


# --- landing and validation ------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS VARCHAR) AS close_work_date,
  CAST(l_partkey AS VARCHAR) AS food_id, 'food ' || l_partkey AS food_name,
  CAST(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS BIGINT) AS dinein_qty,
  CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS BIGINT) AS reserve_qty,
  CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS qty, l_partkey % 83 = 0 AS is_fractional,
  l_partkey % 97 = 0 OR l_partkey % 89 = 0 AS is_rejected
FROM lineitem"""
)
def staged_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Till sales landed as text under their wire names, parsed; rows the not-null gate would reject are marked."""
    raw = table(spark, folder, "lineitem").selectExpr(
        """CASE WHEN l_partkey % 97 = 0 THEN 'closed' WHEN l_orderkey % 3 = 0 THEN date_format(l_shipdate, 'yyyyMMdd')
        WHEN l_orderkey % 3 = 1 THEN CAST(datediff(l_shipdate, DATE'1899-12-30') AS STRING)
        ELSE date_format(l_shipdate, 'yyyy-MM-dd') END AS CloseWorkDate""",
        "concat(' ', l_partkey, ' ') AS FoodID",
        "concat('food ', l_partkey) AS FoodName",
        "CAST(IF(l_linestatus = 'O', l_quantity, 0) AS STRING) AS `dinein(內用)`",
        "CAST(CAST(IF(l_linestatus = 'F', l_quantity, 0) AS INT) + IF(l_partkey % 83 = 0, 0.5, 0) AS STRING) AS `reserve(預訂)`",
        "IF(l_partkey % 89 = 0, 'many', CAST(l_quantity AS STRING)) AS `數量`",
    )
    parsed = staging.parse_sales(raw)
    bad = F.lit(False)
    for c in staging.SALES_REQUIRED:
        bad = bad | F.col(c).isNull()
    return parsed.withColumn("is_rejected", bad)


INPUT_RANGE = (dt.date(1996, 1, 1), dt.date(2001, 6, 30))


@query(
    b.with_(
        ["model_input"],
        f"""SELECT canonical_dish_id, CAST(close_work_date AS VARCHAR) AS close_work_date, food_name,
  CAST(dinein_qty AS DOUBLE) AS dinein_qty, CAST(reserve_qty AS DOUBLE) AS reserve_qty,
  CAST(qty + CASE WHEN canonical_dish_id % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS qty, CAST(is_closed AS DOUBLE) AS is_closed,
  category, CAST(price AS DOUBLE) AS price, CAST(is_market_price AS DOUBLE) AS is_market_price
FROM model_input WHERE close_work_date BETWEEN DATE '{INPUT_RANGE[0]}' AND DATE '{INPUT_RANGE[1]}'
  AND canonical_dish_id IN (SELECT canonical_dish_id FROM price_bridge WHERE is_active)""",
        price_bridge=b.CTE["price_bridge"][1],
    )
)
def load_and_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The model input read back as text with corrected repeats, loaded under the contract."""
    rows = b.model_rows(spark, folder)
    wire = rows.select(
        "canonical_dish_id",
        *[
            F.col(n).cast("int").cast("string").alias(a)
            if n in ("is_closed", "is_market_price")
            else F.col(n).cast("string").alias(a)
            for a, n in staging.MODEL_INPUT_COLUMNS.items()
            if n != "canonical_dish_id"
        ],
    ).withColumnRenamed("canonical_dish_id", "CanonicalDishId")
    copies = F.array(F.lit(0), F.lit(1))
    twice = wire.select("*", F.explode(F.when(F.expr("CanonicalDishId % 5 = 0"), copies).otherwise(F.array(F.lit(0)))).alias("line"))
    twice = twice.withColumn("數量", (F.col("數量").cast("long") + F.col("line")).cast("string"))
    ids = b.price_bridge(spark, folder).filter("is_active").select("canonical_dish_id")
    config = staging.InputConfig(start=INPUT_RANGE[0], end=INPUT_RANGE[1], ids=ids, drop_duplicates=True, line="line")
    return staging.load_and_clean(twice, config)


@query(
    b.with_(
        ["span"],
        """SELECT 'status is known' AS rule, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS n_violations FROM orders
UNION ALL SELECT 'total is not negative', count(*) FILTER (WHERE o_totalprice < 0) FROM orders
UNION ALL SELECT 'quantity is not negative', count(*) FILTER (WHERE qty < 0) FROM sales
UNION ALL SELECT 'day is not before 1996', count(*) FILTER (WHERE close_work_date < DATE '1996-01-01') FROM sales
UNION ALL SELECT 'name is not blank', count(*) FILTER (WHERE length(trim(p_name)) = 0) FROM part
UNION ALL SELECT 'last seen not before first', count(*) FILTER (WHERE hi < lo) FROM span
UNION ALL SELECT 'line number is unique', count(*) FROM
  (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'required label', count(*) FILTER (WHERE p_size % 10 <> 0 AND p_type IS NULL) FROM part""",
    )
)
def constraint_report(spark: SparkSession, folder: str) -> DataFrame:
    """Violations per rule over orders, sales, menu and seen dates."""
    orders, sold, part = table(spark, folder, "orders"), b.sales(spark, folder), table(spark, folder, "part")
    lines = table(spark, folder, "lineitem")
    reports = [
        validate.check_constraints(
            orders,
            {"status is known": F.col("o_orderstatus").isin("O", "F"), "total is not negative": F.col("o_totalprice") >= 0},
        ),
        validate.check_constraints(
            sold,
            {
                "quantity is not negative": F.col("qty") >= 0,
                "day is not before 1996": validate.not_before(F.col("close_work_date"), F.lit(dt.date(1996, 1, 1))),
            },
        ),
        validate.check_constraints(
            part,
            {
                "name is not blank": validate.not_blank(F.col("p_name")),
                "required label": F.expr("p_size % 10 = 0 or p_type is not null"),
            },
        ),
        validate.check_constraints(
            maps.sales_span_by_food(sold),
            {"last seen not before first": validate.not_before(F.col("last_seen_date"), F.col("first_seen_date"))},
        ),
        validate.check_unique(lines, ["l_orderkey", "l_linenumber"], "line number is unique"),
    ]
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return report


# --- table changes ---------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS order_id, 'stored' AS status, o_totalprice AS total FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT CASE WHEN o_orderkey % 50 = 1 THEN NULL ELSE o_orderkey END, o_orderstatus, o_totalprice
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 50 = 1
UNION ALL SELECT NULL, 'repeat', 0 FROM orders WHERE o_orderkey % 50 = 1"""
)
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Load orders, some stored already, every one twice: the first copy of a new key wins, NULL keys never collide."""
    orders = table(spark, folder, "orders")
    stored = orders.filter("o_orderkey % 3 = 0").selectExpr(
        "o_orderkey AS order_id", "'stored' AS status", "o_totalprice AS total"
    )
    key = "IF(o_orderkey % 50 = 1, NULL, o_orderkey) AS order_id"
    first = orders.selectExpr(key, "o_orderstatus AS status", "o_totalprice AS total", "0 AS line")
    again = orders.selectExpr(key, "'repeat' AS status", "0D AS total", "1 AS line")
    return mutate.insert_ignore(stored, first.unionByName(again), ["order_id"], [F.col("line")])


@query(
    """SELECT p_partkey AS dish_id, CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS name,
  CASE WHEN p_size % 7 = 0 THEN 'Brand#0' ELSE p_brand END AS category, p_size AS sort_order FROM part"""
)
def partial_update(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    stored = part.selectExpr("p_partkey AS dish_id", "p_name AS name", "p_brand AS category", "p_size AS sort_order")
    patches = part.filter("p_size % 5 = 0 or p_size % 7 = 0").selectExpr(
        "p_partkey AS dish_id", "IF(p_size % 5 = 0, upper(p_name), NULL) AS name",
        "IF(p_size % 7 = 0, 'Brand#0', NULL) AS category",
    )
    return mutate.patch_fields(stored, patches, ["dish_id"])


@query("SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Orders still to work on when finished and half-finished ones are in the output already."""
    work = table(spark, folder, "orders").selectExpr("o_orderkey AS order_id", "o_totalprice AS total")
    done = table(spark, folder, "orders").filter("o_orderstatus <> 'O'").selectExpr("o_orderkey AS order_id")
    return pending(work, done, "order_id")


@query(
    b.with_(
        ["forecast", "backtest", "policy", "price_bridge", "span"],
        """SELECT 'forecast' AS table_name, 'yhat is not negative' AS rule, count(*) FILTER (WHERE canonical_dish_id % 3 = 0 AND yhat < 20) AS n_violations FROM forecast
UNION ALL SELECT 'forecast', 'target not before origin', count(*) FILTER (WHERE canonical_dish_id % 5 = 0 AND target_date - 3 < forecast_origin_date) FROM forecast
UNION ALL SELECT 'backtest', 'error is not negative', count(*) FILTER (WHERE residual < 0) FROM backtest
UNION ALL SELECT 'price_bridge', 'validity ends after its start', count(*) FILTER (WHERE dish_price_id % 4 <> 0 AND dish_price_id % 7 < 3) FROM price_bridge
UNION ALL SELECT 'policy', 'effect ends after its start', count(*) FILTER (WHERE canonical_dish_id % 6 = 0) FROM policy
UNION ALL SELECT 'food_bridge', 'last seen not before first', count(*) FILTER (WHERE food_id % 2 = 0 AND lo < hi) FROM span""",
    )
)
def table_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The row rules of the stored tables, on copies in which some rows were spoiled or left open."""
    from larder.plans import contracts

    history = b.stored_panel(spark, folder)
    back = F.when(F.expr("canonical_dish_id % 5 = 0"), F.date_sub("target_date", 3)).otherwise(F.col("target_date"))
    less = F.when(F.expr("canonical_dish_id % 3 = 0"), F.col("yhat") - 20).otherwise(F.col("yhat"))
    first = F.lit("2001-01-01").cast("date")
    until = F.when(F.expr("dish_price_id % 4 <> 0"), F.date_add(first, F.expr("CAST(dish_price_id % 7 - 3 AS INT)")))
    spans = maps.sales_span_by_food(b.sales(spark, folder))
    return contracts.broken_rules(
        {
            "forecast": b.forecasts(spark, folder, history).withColumns({"target_date": back, "yhat": less}),
            "backtest": b.backtest(spark, folder, history).withColumn("abs_error", F.col("residual")),
            "price_bridge": b.price_bridge(spark, folder).withColumns({"valid_from": first, "valid_to": until}),
            "policy": b.policy(spark, folder, history).withColumn("effective_to", F.when(F.expr("canonical_dish_id % 6 = 0"), F.date_sub("effective_from", 1))),
            "food_bridge": spans.selectExpr("IF(food_id % 2 = 0, last_seen_date, first_seen_date) AS first_seen_date", "IF(food_id % 2 = 0, first_seen_date, last_seen_date) AS last_seen_date"),
        }
    )
