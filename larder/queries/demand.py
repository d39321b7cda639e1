"""Calendar, daily demand and model-input queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import table
from larder.operators import calendar, mapping, panel as panels
from larder.queries import bindings as b
from larder.queries.registry import query

EXISTING_BEFORE = dt.date(1996, 1, 1)
REFRESH = (dt.date(2000, 6, 1), dt.date(2000, 12, 31))


@query(
    b.with_(
        ["sales"],
        f"""SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, CAST(d AS VARCHAR) AS date, year(d) AS year,
  quarter(d) AS quarter, month(d) AS month, day(d) AS day, isodow(d) AS day_of_week_iso, dayname(d) AS day_name_en,
  isodow(d) >= 6 AS is_weekend, weekofyear(d) AS iso_week, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week_start_date,
  CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start_date, CAST(last_day(d) AS VARCHAR) AS month_end_date,
  isodow(d) = 1 AS is_shop_closed
FROM (SELECT CAST(unnest(generate_series((SELECT min(close_work_date) - 365 FROM sales),
  (SELECT max(close_work_date) + 365 FROM sales), INTERVAL 1 DAY)) AS DATE) AS d) WHERE d >= DATE '{EXISTING_BEFORE}'""",
    )
)
def dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar around the sales, days before 1996 being stored already."""
    sold = b.sales(spark, folder)
    stored = calendar.date_dimension(sold).filter(F.col("date") < F.lit(EXISTING_BEFORE))
    return calendar.date_dimension(sold, stored)


@query(b.with_(["panel"], "SELECT * REPLACE (CAST(close_work_date AS VARCHAR) AS close_work_date) FROM panel"))
def clean_daily_demand(spark: SparkSession, folder: str) -> DataFrame:
    return b.panel(spark, folder)


@query(
    b.with_(
        ["sales", "bridge"],
        """SELECT DISTINCT food_id FROM sales WHERE food_id NOT IN (SELECT food_id FROM bridge WHERE is_active)
ORDER BY food_id""",
    )
)
def unmapped_foods(spark: SparkSession, folder: str) -> DataFrame:
    """All sold foods without an active mapping."""
    return mapping.unmapped_foods(b.sales(spark, folder), b.bridge(spark, folder).filter("is_active"))


@query(
    b.with_(
        ["sales"],
        """SELECT food_id, CAST(min(close_work_date) AS VARCHAR) AS first_seen_date,
  CAST(max(close_work_date) AS VARCHAR) AS last_seen_date FROM sales GROUP BY food_id""",
    )
)
def sales_span(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.sales_span_by_food(b.sales(spark, folder))


@query(
    b.with_(
        ["model_input"],
        "SELECT * REPLACE (CAST(close_work_date AS VARCHAR) AS close_work_date, CAST(price AS DOUBLE) AS price) FROM model_input",
    )
)
def model_input_view(spark: SparkSession, folder: str) -> DataFrame:
    return b.model_rows(spark, folder)


@query(
    b.with_(
        ["panel"],
        f"""SELECT CAST(close_work_date AS VARCHAR) AS close_work_date, canonical_dish_id,
  CASE WHEN close_work_date BETWEEN DATE '{REFRESH[0]}' AND DATE '{REFRESH[1]}' THEN qty ELSE qty + 1 END AS qty,
  dinein_qty, reserve_qty, is_zero_filled, is_shop_closed, has_unmapped_food, src_row_cnt
FROM panel WHERE canonical_dish_id % 3 <> 0 OR close_work_date BETWEEN DATE '{REFRESH[0]}' AND DATE '{REFRESH[1]}'""",
    )
)
def fact_refresh_window(spark: SparkSession, folder: str) -> DataFrame:
    """An older fact (quantities off by one, a third of the dishes missing) refreshed for half a year."""
    demand = b.panel(spark, folder)
    fact = demand.select(*panels.FACT_KEYS, *panels.FACT_VALUES).filter("canonical_dish_id % 3 <> 0")
    return panels.refresh_fact(fact.withColumn("qty", F.col("qty") + 1), demand, *REFRESH)


@query(
    b.with_(
        ["menu_latest"],
        """SELECT food_id, menu_sk, food_name, category_raw, CAST(price AS DOUBLE) AS price,
  price IS NULL AS is_market_price FROM menu_latest""",
    )
)
def latest_menu(spark: SparkSession, folder: str) -> DataFrame:
    latest = panels.latest_menu(b.menu(spark, folder))
    return latest.select(
        "food_id", "menu_sk", "food_name", "category_raw", "price", F.col("price").isNull().alias("is_market_price")
    )


@query(
    """SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL
SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL
SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events"""
)
def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    from larder.sources.readers import row_counts as counts

    names = ["lineitem", "orders", "part", "customer", "events"]
    return counts({n: table(spark, folder, n) for n in names})
