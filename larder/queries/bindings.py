"""How the stored tables play the parts of the domain, in Spark and (``CTE``) in plain SQL.

lineitem = till sales and order lines, part = menu rows, orders/customer = orders and diners, events = cart requests.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import materialize, table

EXCLUDED = (dt.date(1999, 10, 1), dt.date(2000, 1, 1))
ORIGIN = dt.date(2001, 6, 4)
ORIGINS = [dt.date(2001, 5, 28), ORIGIN]
FOLDS = [dt.date(2001, 4, 2) + dt.timedelta(weeks=i) for i in range(6)]
VERSIONS = {
    "baseline_k4": {"method": "k_week_median", "k": 4},
    "seasonal": {"method": "seasonal_median"},
}

CTE: dict[str, tuple[list[str], str]] = {}


def with_(names: list[str], body: str, **extra: str) -> str:
    """SQL text: the named building blocks in dependency order, then extra ones, then the body."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        needs, text = CTE[n]
        for m in needs:
            add(m)
        done.setdefault(n, text)

    for n in names:
        add(n)
    done.update(extra)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in done.items()) + "\n" + body


# --- sales, dishes, bridge -------------------------------------------------------------------------------------------


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines are negative sales; line status 'O' is eaten in, 'F' is reserved."""
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("close_work_date"),
        F.col("l_partkey").alias("food_id"),
        F.when(F.col("l_linestatus") == "O", quantity).otherwise(0).alias("dinein_qty"),
        F.when(F.col("l_linestatus") == "F", quantity).otherwise(0).alias("reserve_qty"),
        quantity.alias("qty"),
    )


CTE["sales"] = (
    [],
    """SELECT CAST(l_shipdate AS DATE) AS close_work_date, l_partkey AS food_id,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS qty,
  CASE WHEN l_linestatus = 'O' THEN CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT)
       ELSE 0 END AS dinein_qty,
  CASE WHEN l_linestatus = 'F' THEN CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT)
       ELSE 0 END AS reserve_qty
FROM lineitem""",
)


def dishes(spark: SparkSession, folder: str) -> DataFrame:
    """Foods of one name are one dish; its id is its smallest food."""
    return table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("canonical_dish_id")).select(
        "canonical_dish_id",
        F.col("p_name").alias("basename"),
        F.lit("single").alias("price_label"),
        F.col("p_name").alias("canonical_name"),
        F.lit(True).alias("is_active"),
    )


CTE["dish"] = (
    [],
    "SELECT min(p_partkey) AS canonical_dish_id, p_name AS basename, 'single' AS price_label, "
    "p_name AS canonical_name FROM part GROUP BY p_name",
)


def bridge(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("food_id"), F.col("p_name").alias("basename"), F.expr("p_size % 7 <> 0").alias("is_active")
    )
    names = dishes(spark, folder).select("basename", "canonical_dish_id")
    return part.join(names, "basename").select("food_id", "canonical_dish_id", "is_active")


CTE["bridge"] = (
    ["dish"],
    "SELECT p_partkey AS food_id, canonical_dish_id, p_size % 7 <> 0 AS is_active "
    "FROM part JOIN dish ON p_name = basename",
)


def menu(spark: SparkSession, folder: str) -> DataFrame:
    """Two menu rows per food: an older one, and one that is newer, equally old or undated."""
    part = table(spark, folder, "part").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size"))
    newer = F.expr("CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 10 END")
    return part.select(
        (F.col("p_partkey") * 2 + F.col("v")).alias("menu_sk"),
        F.col("p_partkey").alias("food_id"),
        F.expr("concat(p_name, '(', p_type, ')')").alias("food_name"),
        F.expr("concat('[', p_size % 3, '] ', p_brand)").alias("category_raw"),
        F.expr("CASE WHEN p_size % 10 = 0 AND v = 1 THEN NULL ELSE CAST(p_retailprice + v AS DECIMAL(12,2)) END").alias(
            "price"
        ),
        F.when(F.col("v") == 0, day).otherwise(F.date_add(day, newer)).cast("timestamp").alias("create_date"),
        F.date_add(F.lit("2002-01-01").cast("date"), F.expr("IF(p_size % 5 = 0, 0, 1 - v)")).cast("timestamp").alias(
            "loaded_at"
        ),
    )


CTE["menu"] = (
    [],
    """SELECT p_partkey * 2 + v AS menu_sk, p_partkey AS food_id, p_name || '(' || p_type || ')' AS food_name,
  '[' || (p_size % 3) || '] ' || p_brand AS category_raw,
  CASE WHEN p_size % 10 = 0 AND v = 1 THEN NULL ELSE CAST(p_retailprice + v AS DECIMAL(12,2)) END AS price,
  DATE '2000-01-01' + p_size + CASE WHEN v = 0 THEN 0 WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 0 ELSE 10 END
    AS create_date,
  DATE '2002-01-01' + CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 - v END AS loaded_at
FROM part, (VALUES (0), (1)) AS t(v)""",
)


# --- demand panel ----------------------------------------------------------------------------------------------------


def panel(spark: SparkSession, folder: str) -> DataFrame:
    from larder.operators.panel import clean_daily_demand

    return clean_daily_demand(sales(spark, folder), bridge(spark, folder), dishes(spark, folder), EXCLUDED)


def stored_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written once, for jobs that read it many times."""
    return materialize(panel(spark, folder), "panel")


CTE["kept"] = (
    ["sales"],
    f"SELECT * FROM sales WHERE NOT (close_work_date >= DATE '{EXCLUDED[0]}' AND close_work_date < DATE '{EXCLUDED[1]}')",
)
CTE["daily"] = (
    ["kept"],
    """SELECT close_work_date, food_id, sum(greatest(coalesce(qty, 0), 0)) AS qty,
  sum(greatest(coalesce(dinein_qty, 0), 0)) AS dinein_qty, sum(greatest(coalesce(reserve_qty, 0), 0)) AS reserve_qty,
  count(*) AS src_row_cnt
FROM kept GROUP BY ALL""",
)
CTE["mapped"] = (
    ["daily", "bridge"],
    "SELECT d.*, b.canonical_dish_id FROM daily d LEFT JOIN bridge b ON d.food_id = b.food_id AND b.is_active",
)
CTE["panel"] = (
    ["mapped", "dish"],
    f"""SELECT g.close_work_date, g.canonical_dish_id, basename, price_label, canonical_name,
  CAST(coalesce(s.qty, 0) AS BIGINT) AS qty, CAST(coalesce(s.dinein_qty, 0) AS BIGINT) AS dinein_qty,
  CAST(coalesce(s.reserve_qty, 0) AS BIGINT) AS reserve_qty, s.canonical_dish_id IS NULL AS is_zero_filled,
  isodow(g.close_work_date) = 1 AS is_shop_closed, false AS has_unmapped_food,
  CAST(coalesce(s.src_row_cnt, 0) AS BIGINT) AS src_row_cnt, coalesce(u.n, 0) AS unmapped_food_cnt,
  g.close_work_date >= DATE '{EXCLUDED[0]}' AND g.close_work_date < DATE '{EXCLUDED[1]}' AS is_excluded
FROM (SELECT CAST(day AS DATE) AS close_work_date, dish.* FROM
        (SELECT unnest(generate_series((SELECT min(close_work_date) FROM kept), (SELECT max(close_work_date) FROM kept),
                                       INTERVAL 1 DAY)) AS day), dish
      WHERE canonical_dish_id IN (SELECT canonical_dish_id FROM mapped)) g
LEFT JOIN (SELECT close_work_date, canonical_dish_id, sum(qty) AS qty, sum(dinein_qty) AS dinein_qty,
             sum(reserve_qty) AS reserve_qty, sum(src_row_cnt) AS src_row_cnt
           FROM mapped WHERE canonical_dish_id IS NOT NULL GROUP BY ALL) s USING (close_work_date, canonical_dish_id)
LEFT JOIN (SELECT close_work_date, count(*) AS n FROM mapped WHERE canonical_dish_id IS NULL GROUP BY ALL) u
  USING (close_work_date)""",
)


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    from larder.operators.panel import model_input

    return model_input(panel(spark, folder), dishes(spark, folder), bridge(spark, folder), menu(spark, folder))


CTE["menu_latest"] = (
    ["menu"],
    """SELECT * FROM menu QUALIFY row_number() OVER (PARTITION BY food_id
  ORDER BY create_date DESC NULLS LAST, menu_sk DESC) = 1""",
)
CTE["model_input"] = (
    ["panel", "menu_latest", "bridge"],
    """SELECT canonical_dish_id, close_work_date, canonical_name AS food_name, dinein_qty, reserve_qty, qty,
  is_shop_closed AS is_closed, category_raw AS category, price, price IS NULL AS is_market_price
FROM panel
LEFT JOIN (SELECT canonical_dish_id, min(CAST(food_id AS VARCHAR)) AS food_key FROM bridge WHERE is_active GROUP BY 1) r
  USING (canonical_dish_id)
LEFT JOIN menu_latest m ON r.food_key = CAST(m.food_id AS VARCHAR)""",
)


# --- forecasts, backtest, policy, serving ----------------------------------------------------------------------------


def forecasts(spark: SparkSession, folder: str, history: DataFrame | None = None) -> DataFrame:
    """The forecast fact after two weekly runs of two model versions."""
    from larder.operators.baseline import fold_forecasts

    history = stored_panel(spark, folder) if history is None else history
    return fold_forecasts(history, ORIGINS, VERSIONS).select(
        "canonical_dish_id",
        F.col("origin").alias("forecast_origin_date"),
        "target_date",
        F.col("yhat").cast("decimal(18,6)").alias("yhat"),
        F.concat("model_version", F.lit(" ")).alias("model_version"),
        F.concat(F.lit("run-"), F.col("origin").cast("string")).alias("run_id"),
        F.col("origin").cast("timestamp").alias("created_at"),
    )


CTE["origins"] = ([], "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{o}')" for o in ORIGINS) + ") AS t(origin)")
CTE["folds"] = (
    [],
    "SELECT * FROM (VALUES " + ", ".join(f"({n}, DATE '{o}')" for n, o in enumerate(FOLDS)) + ") AS t(fold_id, origin)",
)


def _medians(source: str, out: str) -> dict[str, tuple[list[str], str]]:
    """SQL blocks ``<out>``: both baselines for every origin of ``source`` (columns origin, canonical_dish_id, target_date)."""
    return {
        f"{out}_train": (
            ["panel", source],
            f"""SELECT origin, canonical_dish_id, close_work_date, isodow(close_work_date) AS dow, qty,
  row_number() OVER (PARTITION BY origin, canonical_dish_id, isodow(close_work_date) ORDER BY close_work_date DESC) AS rn,
  row_number() OVER (PARTITION BY origin, canonical_dish_id ORDER BY close_work_date DESC) AS rn_id
FROM panel JOIN (SELECT DISTINCT origin FROM {source}) ON close_work_date < origin""",
        ),
        out: (
            [f"{out}_train", source],
            f"""SELECT s.origin, i.canonical_dish_id, CAST(s.origin + d AS DATE) AS target_date, version AS model_version,
  CAST(round_even(greatest(CASE version WHEN 'baseline_k4' THEN coalesce(g4, i4) ELSE coalesce(g, i_all) END, 0), 0)
    AS BIGINT) AS yhat
FROM (SELECT DISTINCT origin FROM {source}) s
JOIN (SELECT origin, canonical_dish_id, median(qty) AS i_all, median(qty) FILTER (WHERE rn_id <= 4) AS i4
      FROM {out}_train GROUP BY ALL) i ON i.origin = s.origin
CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS h(d)
CROSS JOIN (VALUES ('baseline_k4'), ('seasonal')) AS v(version)
LEFT JOIN (SELECT origin, canonical_dish_id, dow, median(qty) AS g, median(qty) FILTER (WHERE rn <= 4) AS g4
           FROM {out}_train GROUP BY ALL) g
  ON g.origin = s.origin AND g.canonical_dish_id = i.canonical_dish_id AND g.dow = isodow(s.origin + d)""",
        ),
    }


CTE.update(_medians("origins", "fc"))
CTE.update(_medians("folds", "bt"))
CTE["forecast"] = (
    ["fc"],
    """SELECT canonical_dish_id, origin AS forecast_origin_date, target_date, yhat, model_version || ' ' AS model_version,
  'run-' || CAST(origin AS VARCHAR) AS run_id, origin AS created_at FROM fc""",
)


def backtest(spark: SparkSession, folder: str, history: DataFrame | None = None) -> DataFrame:
    from larder.operators.baseline import rolling_backtest

    return rolling_backtest(stored_panel(spark, folder) if history is None else history, FOLDS, VERSIONS)


CTE["backtest"] = (
    ["bt", "folds", "panel"],
    """SELECT fold_id, bt.origin AS forecast_origin_date, target_date, bt.canonical_dish_id, model_version, p.qty AS y_true,
  yhat, p.qty - yhat AS residual, abs(p.qty - yhat) AS abs_error,
  CASE model_version WHEN 'seasonal' THEN 'seasonal_median' ELSE 'k_week_median' END AS baseline_method
FROM bt JOIN folds ON bt.origin = folds.origin
JOIN panel p ON p.canonical_dish_id = bt.canonical_dish_id AND p.close_work_date = target_date""",
)


def old_policy(spark: SparkSession, folder: str) -> DataFrame:
    """The policy before this week's write: one row for every dish, some switched off."""
    return dishes(spark, folder).select(
        "canonical_dish_id",
        F.lit("baseline_k4").alias("chosen_model_version"),
        F.lit("2001-01-01").cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.expr("canonical_dish_id % 2 = 0").alias("is_active"),
        F.lit("first policy").alias("note"),
    )


def policy(spark: SparkSession, folder: str, history: DataFrame | None = None) -> DataFrame:
    from larder.operators.policy import write_policy

    return write_policy(old_policy(spark, folder), backtest(spark, folder, history), ORIGIN)


CTE["mae"] = (
    ["backtest"],
    "SELECT canonical_dish_id, model_version, count(*) AS n_rows, avg(abs_error) AS mae FROM backtest GROUP BY ALL",
)
CTE["choice"] = (
    ["mae"],
    """SELECT canonical_dish_id, model_version AS chosen_model_version, mae, n_rows FROM mae
QUALIFY row_number() OVER (PARTITION BY canonical_dish_id ORDER BY mae, model_version) = 1""",
)
CTE["policy"] = (
    ["choice", "dish"],
    f"""SELECT dish.canonical_dish_id, coalesce(c.chosen_model_version, 'baseline_k4') AS chosen_model_version,
  CASE WHEN c.canonical_dish_id IS NULL THEN DATE '2001-01-01' ELSE DATE '{ORIGIN}' END AS effective_from,
  c.canonical_dish_id IS NOT NULL OR dish.canonical_dish_id % 2 = 0 AS is_active,
  CASE WHEN c.canonical_dish_id IS NULL THEN 'first policy' ELSE 'offline policy from backtest: min MAE' END AS note
FROM dish LEFT JOIN choice c USING (canonical_dish_id)""",
)


def price_bridge(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("basename"), "p_size")
    names = dishes(spark, folder).select("basename", "canonical_dish_id")
    return part.join(names, "basename").select(
        "canonical_dish_id", F.col("p_partkey").alias("dish_price_id"), F.expr("p_size % 3 <> 0").alias("is_active")
    )


CTE["price_bridge"] = (
    ["dish"],
    "SELECT canonical_dish_id, p_partkey AS dish_price_id, p_size % 3 <> 0 AS is_active "
    "FROM part JOIN dish ON p_name = basename",
)


def serving(spark: SparkSession, folder: str) -> DataFrame:
    from larder.operators.policy import serving_view

    history = stored_panel(spark, folder)
    return serving_view(forecasts(spark, folder, history), policy(spark, folder, history), price_bridge(spark, folder))


CTE["latest"] = (
    ["forecast", "policy"],
    """SELECT f.* FROM forecast f JOIN policy p ON p.canonical_dish_id = f.canonical_dish_id AND p.is_active
  AND trim(f.model_version) = trim(p.chosen_model_version)
QUALIFY row_number() OVER (PARTITION BY f.canonical_dish_id, f.target_date
  ORDER BY f.forecast_origin_date DESC, f.created_at DESC, f.run_id DESC) = 1""",
)
CTE["serving"] = (
    ["latest", "price_bridge"],
    """SELECT price_id, l.canonical_dish_id, forecast_origin_date, target_date, yhat, model_version, run_id
FROM latest l JOIN (SELECT canonical_dish_id, min(dish_price_id) AS price_id FROM price_bridge WHERE is_active GROUP BY 1) b
  USING (canonical_dish_id)""",
)
