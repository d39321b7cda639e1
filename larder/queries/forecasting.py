"""Feature, baseline, backtest, policy, serving and gate queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.context import materialize
from larder.operators import baseline, features, gates
from larder.operators import policy as policies
from larder.plans import weekly
from larder.queries import bindings as b
from larder.queries.registry import query

CONFIG = features.FeatureConfig(
    static=["category", "price", "is_market_price"],
    use_closed=True,
    use_weekday=True,
    use_target_day=True,
    lags=[7, 14],
    windows=[7, 28],
    stats=["mean", "std", "min", "max", "sum", "median"],
)
# A history that stops before its origin: the last known day is nine days earlier.
SHORT_ORIGIN = dt.date(2001, 6, 4)
SHORT_END = dt.date(2001, 5, 26)


@query(
    b.with_(
        ["panel"],
        f"""SELECT canonical_dish_id, CAST(CAST(DATE '{b.ORIGIN}' + d AS DATE) AS VARCHAR) AS target_date,
  CAST(d - 1 AS BIGINT) AS target_day, CAST(isodow(DATE '{b.ORIGIN}' + d) - 1 AS BIGINT) AS day_of_week
FROM (SELECT DISTINCT canonical_dish_id FROM panel), (VALUES (1), (2), (3), (4), (5), (6)) AS h(d)""",
    )
)
def horizon_skeleton(spark: SparkSession, folder: str) -> DataFrame:
    from larder.functions.dates import horizon_index

    rows = features.horizon_skeleton(b.panel(spark, folder).select("canonical_dish_id").distinct(), b.ORIGIN)
    return rows.withColumns(
        {"target_day": horizon_index(F.col("target_date"), F.lit(b.ORIGIN)), "day_of_week": F.weekday("target_date")}
    )


@query(
    b.with_(
        ["panel"],
        """SELECT canonical_dish_id, CAST(close_work_date AS VARCHAR) AS close_work_date, qty,
  lag(qty, 1) OVER w AS lag_1, lag(qty, 7) OVER w AS lag_7, lag(qty, 28) OVER w AS lag_28 FROM panel
WINDOW w AS (PARTITION BY canonical_dish_id ORDER BY close_work_date)""",
    )
)
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    order = W.partitionBy("canonical_dish_id").orderBy("close_work_date")
    rows = b.panel(spark, folder).select("canonical_dish_id", "close_work_date", "qty")
    return rows.withColumns(features.lag_columns(F.col("qty"), order, [1, 7, 28]))


@query(
    b.with_(
        ["panel"],
        """SELECT canonical_dish_id, CAST(close_work_date AS VARCHAR) AS close_work_date, round(avg(qty) OVER w, 6) AS roll_mean_7,
  round(stddev_samp(qty) OVER w, 6) AS roll_std_7, CAST(min(qty) OVER w AS DOUBLE) AS roll_min_7,
  CAST(max(qty) OVER w AS DOUBLE) AS roll_max_7, CAST(sum(qty) OVER w AS DOUBLE) AS roll_sum_7,
  CAST(median(qty) OVER w AS DOUBLE) AS roll_median_7 FROM panel
WINDOW w AS (PARTITION BY canonical_dish_id ORDER BY close_work_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    )
)
def rolling_features(spark: SparkSession, folder: str) -> DataFrame:
    order = W.partitionBy("canonical_dish_id").orderBy("close_work_date")
    rows = b.panel(spark, folder).select("canonical_dish_id", "close_work_date", F.col("qty").cast("double").alias("y"))
    rolled = features.rolling_columns(F.col("y"), order, [7], list(features.ROLLING))
    out = rows.withColumns(rolled).drop("y")
    return out.withColumns({c: F.round(c, 6) for c in ["roll_mean_7", "roll_std_7"]})


def _feature_sql(source: str, end: dt.date, origin: dt.date) -> str:
    days = ", ".join(f"({i})" for i in range(1, 7))
    stats = ", ".join(
        f"round({fn}(y) FILTER (WHERE n <= {w}), 6) AS roll_{s}_{w}"
        for w in CONFIG.windows
        for s, fn in dict(mean="avg", std="stddev_samp", min="min", max="max", sum="sum", median="median").items()
    )
    return b.with_(
        [source],
        f"""SELECT t.canonical_dish_id, CAST(t.target_date AS VARCHAR) AS target_date, s.category, CAST(s.price AS DOUBLE) AS price,
  s.is_market_price, CAST(0 AS BIGINT) AS is_closed, isodow(t.target_date) - 1 AS day_of_week, CAST(t.d - 1 AS BIGINT) AS target_day,
  l7.y AS lag_7, l14.y AS lag_14, r.* EXCLUDE (canonical_dish_id, d)
FROM targets t
LEFT JOIN hist l7 ON l7.canonical_dish_id = t.canonical_dish_id AND l7.day = t.target_date - 7
LEFT JOIN hist l14 ON l14.canonical_dish_id = t.canonical_dish_id AND l14.day = t.target_date - 14
LEFT JOIN (SELECT canonical_dish_id, max_by(category, day) AS category, max_by(price, CASE WHEN price IS NOT NULL THEN day END) AS price,
             max_by(is_market_price, day) AS is_market_price FROM hist GROUP BY 1) s ON s.canonical_dish_id = t.canonical_dish_id
LEFT JOIN (SELECT canonical_dish_id, d, {stats}
           FROM (SELECT t.canonical_dish_id, t.d, h.y, t.target_date - h.day AS n
                 FROM targets t JOIN hist h ON h.canonical_dish_id = t.canonical_dish_id AND h.day < t.target_date)
           GROUP BY ALL) r ON r.canonical_dish_id = t.canonical_dish_id AND r.d = t.d""",
        hist=f"SELECT *, close_work_date AS day, CAST(qty AS DOUBLE) AS y FROM {source} WHERE close_work_date <= DATE '{end}'",
        targets=f"SELECT DISTINCT canonical_dish_id, d, CAST(DATE '{origin}' + d AS DATE) AS target_date FROM hist, (VALUES {days}) AS h(d)",
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("roll_")})


@query(_feature_sql("model_input", b.ORIGIN, b.ORIGIN))
def forecast_features(spark: SparkSession, folder: str) -> DataFrame:
    history = materialize(b.model_rows(spark, folder), "history")
    return _rounded(features.forecast_features(history, b.ORIGIN, CONFIG))


@query(_feature_sql("model_input", SHORT_END, SHORT_ORIGIN))
def dense_calendar_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Features when the history ends nine days before the origin: a lag of k rows must still be a lag of k days."""
    history = materialize(b.model_rows(spark, folder), "history").filter(F.col("close_work_date") <= F.lit(SHORT_END))
    return _rounded(features.forecast_features(history, SHORT_ORIGIN, CONFIG))


@query(
    b.with_(
        ["model_input"],
        f"""SELECT canonical_dish_id, max_by(category, close_work_date) FILTER (WHERE category IS NOT NULL) AS category,
  CAST(max_by(price, close_work_date) FILTER (WHERE price IS NOT NULL) AS DOUBLE) AS price,
  max_by(CASE WHEN qty > 0 THEN qty END, close_work_date) FILTER (WHERE qty > 0) AS last_sold
FROM model_input WHERE close_work_date <= DATE '{b.ORIGIN}' GROUP BY 1""",
    )
)
def last_known_static(spark: SparkSession, folder: str) -> DataFrame:
    """Latest known category, price and non-zero demand of each dish."""
    past = b.model_rows(spark, folder).filter(F.col("close_work_date") <= F.lit(b.ORIGIN))
    rows = past.withColumn("last_sold", F.when(F.col("qty") > 0, F.col("qty")))
    return features.last_known(rows, "canonical_dish_id", "close_work_date", ["category", "price", "last_sold"])


@query(
    """SELECT CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS brand, median(l_quantity) AS median_quantity,
  any_value(overall) AS overall_median, count(*) AS n_rows
FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT median(l_quantity) AS overall FROM lineitem) GROUP BY 1"""
)
def exact_median(spark: SparkSession, folder: str) -> DataFrame:
    """Median line quantity per brand (an unknown brand is a group too) beside the overall median."""
    from larder.context import table

    lines = table(spark, folder, "lineitem").select("l_partkey", F.col("l_quantity").alias("quantity"))
    part = table(spark, folder, "part").selectExpr(
        "p_partkey AS l_partkey", "IF(p_size % 10 = 0, NULL, p_brand) AS brand"
    )
    # Lines are first counted per food and quantity, so the join and the medians see counts instead of lines.
    counted = lines.groupBy("l_partkey", "quantity").agg(F.count(F.lit(1)).alias("n"))
    overall = baseline.exact_median(counted, [], "quantity", "m", F.col("n")).select("m").scalar()
    found = baseline.exact_median(counted.join(part, "l_partkey"), ["brand"], "quantity", "median_quantity", F.col("n"))
    return found.withColumn("overall_median", overall)


def _lookup_sql(picked: str) -> str:
    return b.with_(
        ["panel"],
        f"""SELECT canonical_dish_id, CAST(isodow(close_work_date) - 1 AS BIGINT) AS day_of_week, CAST(median(qty) AS DOUBLE) AS y_pred
FROM (SELECT *, row_number() OVER (PARTITION BY canonical_dish_id, isodow(close_work_date) ORDER BY close_work_date DESC) AS rn
      FROM panel WHERE close_work_date < DATE '{b.ORIGIN}') WHERE {picked} GROUP BY ALL""",
    )


def _trained(spark: SparkSession, folder: str, method: str) -> baseline.Baseline:
    past = b.panel(spark, folder).filter(F.col("close_work_date") < F.lit(b.ORIGIN))
    past = past.withColumn("day_of_week", F.weekday("close_work_date"))
    return baseline.train_baseline(past, method, ["canonical_dish_id", "day_of_week"])


@query(_lookup_sql("rn <= 4"))
def k_week_median(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder, baseline.K_WEEK_MEDIAN).lookup


@query(_lookup_sql("true"))
def seasonal_median(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder, baseline.SEASONAL_MEDIAN).lookup


@query(
    b.with_(
        ["fc"],
        f"""SELECT canonical_dish_id, CAST(target_date AS VARCHAR) AS target_date, yhat FROM fc
WHERE origin = DATE '{b.ORIGIN}' AND model_version = 'baseline_k4'""",
    )
)
def baseline_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return baseline.baseline_forecast(b.stored_panel(spark, folder), b.ORIGIN)


@query(
    b.with_(
        ["backtest"],
        """SELECT * REPLACE (CAST(fold_id AS BIGINT) AS fold_id, CAST(forecast_origin_date AS VARCHAR) AS forecast_origin_date,
  CAST(target_date AS VARCHAR) AS target_date) FROM backtest""",
    )
)
def rolling_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return b.backtest(spark, folder)


LINEAR = features.FeatureConfig(use_id=False, use_target_day=True, lags=[7, 14], windows=[28], stats=["max"])
#: Weights of ``target_day``, ``lag_7``, ``lag_14`` and, beyond the best iteration, of the window's maximum.
WEIGHTS = [1.25, 0.5, 0.25, 100.0]


class Linear:
    """A foreign model: one weight per column in the configured order, of which it uses the first ``num_iteration``."""

    def predict(self, frame, num_iteration=None):
        n = num_iteration or len(WEIGHTS)
        return frame.iloc[:, :n].astype(float).fillna(0).to_numpy() @ WEIGHTS[:n]


def linear_scores_of(history: DataFrame, origin: dt.date) -> DataFrame:
    rows = features.forecast_features(history, origin, LINEAR)
    return weekly.score_with(Linear, rows, LINEAR, best_iteration=3)


b.CTE["linear"] = (
    ["panel"],
    f"""SELECT canonical_dish_id, target_date, CAST(round_even(greatest(1.25 * (d - 1) + 0.5 * coalesce(l7.qty, 0) + 0.25 * coalesce(l14.qty, 0), 0), 0) AS BIGINT) AS yhat
FROM (SELECT DISTINCT canonical_dish_id, d, CAST(DATE '{b.ORIGIN}' + d AS DATE) AS target_date FROM panel, (VALUES (1), (2), (3), (4), (5), (6)) AS h(d)
      WHERE close_work_date <= DATE '{b.ORIGIN}') t
LEFT JOIN (SELECT canonical_dish_id, qty, close_work_date + 7 AS target_date FROM panel WHERE close_work_date <= DATE '{b.ORIGIN}') l7
  USING (canonical_dish_id, target_date)
LEFT JOIN (SELECT canonical_dish_id, qty, close_work_date + 14 AS target_date FROM panel WHERE close_work_date <= DATE '{b.ORIGIN}') l14
  USING (canonical_dish_id, target_date)""",
)


@query(b.with_(["linear"], "SELECT canonical_dish_id, CAST(CAST(target_date AS DATE) AS VARCHAR) AS target_date, yhat FROM linear"))
def linear_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of an object that only has ``predict``, in the configured feature order and up to its best iteration."""
    return linear_scores_of(b.stored_panel(spark, folder), b.ORIGIN)


@query(
    b.with_(
        ["fc", "linear"],
        f"""SELECT canonical_dish_id, '{b.ORIGIN}' AS forecast_origin_date, CAST(CAST(target_date AS DATE) AS VARCHAR) AS target_date,
  CAST(yhat AS DOUBLE) AS yhat, model_version, 'weekly' AS run_id FROM (
  SELECT canonical_dish_id, target_date, yhat, model_version FROM fc WHERE origin = DATE '{b.ORIGIN}' AND model_version = 'baseline_k4'
  UNION ALL SELECT canonical_dish_id, target_date, yhat, 'linear_v1' FROM linear)""",
    )
)
def weekly_run_with_model(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly job with a model beside the baseline; its version comes from the configuration."""
    from larder.context import scratch_folder

    run = weekly.WeeklyRun(
        origin=b.ORIGIN, run_id="weekly", baseline_version="baseline_k4", score_model=linear_scores_of, config={"model": {"model_version": "linear_v1"}}
    )
    path = scratch_folder(spark, "forecast-fact")
    weekly.weekly_forecast(b.stored_panel(spark, folder), run, path)
    return spark.read.parquet(path).select(
        "canonical_dish_id", "forecast_origin_date", "target_date", "yhat", "model_version", "run_id"
    )


@query(
    b.with_(
        ["fc", "linear"],
        f"""SELECT model_version, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique FROM (
  SELECT model_version, count(*) AS n FROM (
    SELECT canonical_dish_id, target_date, model_version FROM fc WHERE origin = DATE '{b.ORIGIN}' AND model_version = 'baseline_k4'
    UNION ALL SELECT canonical_dish_id, target_date, 'linear_v1' FROM linear
    UNION ALL SELECT canonical_dish_id, target_date, 'linear_v1' FROM linear WHERE canonical_dish_id % 2 = 0)
  GROUP BY model_version, canonical_dish_id, target_date) GROUP BY 1""",
    )
)
def run_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and unique keys of a run's two versions, where half of the model's rows came twice."""
    run = weekly.WeeklyRun(b.ORIGIN, "weekly", "baseline_k4", model_version="linear_v1", score_model=linear_scores_of)
    rows = materialize(weekly.forecast_rows(b.stored_panel(spark, folder), run), "forecast-rows")
    return weekly.key_report(rows.unionByName(rows.filter("model_version = 'linear_v1' AND canonical_dish_id % 2 = 0")))


@query()
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted-tree scores of the forecast days (library training, so checked by shape only)."""
    history = materialize(b.model_rows(spark, folder), "history")
    config = features.FeatureConfig(
        use_weekday=True, use_target_day=True, lags=[7, 14], windows=[28], stats=["mean", "min", "max"]
    )
    model = weekly.fit_trees(history, config, b.ORIGIN - dt.timedelta(days=365), b.ORIGIN)
    scored = weekly.score(model, features.forecast_features(history, b.ORIGIN, config), config)
    return scored.select("canonical_dish_id", "target_date", "yhat")


@query(
    b.with_(
        ["panel"],
        """SELECT 6 * count(DISTINCT canonical_dish_id) AS n_rows, count(DISTINCT canonical_dish_id) AS n_dishes, 0 AS n_missing, 0 AS n_negative,
  0 AS n_fractions FROM panel""",
    )
)
def gbt_report(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for these scores whatever the trees learned: one whole, non-negative number for each dish and day."""
    rows = gbt_scores(spark, folder)
    return rows.agg(
        F.count_distinct("canonical_dish_id", "target_date").alias("n_rows"),
        F.count_distinct("canonical_dish_id").alias("n_dishes"),
        F.count_if(F.col("yhat").isNull()).alias("n_missing"),
        F.count_if(F.col("yhat") < 0).alias("n_negative"),
        F.count_if(F.col("yhat") != F.floor("yhat")).alias("n_fractions"),
    )


@query(b.with_(["mae"], "SELECT canonical_dish_id, model_version, n_rows, round(mae, 6) AS mae FROM mae"))
def mae_by_dish(spark: SparkSession, folder: str) -> DataFrame:
    return policies.mae_by_dish(b.backtest(spark, folder)).withColumn("mae", F.round("mae", 6))


@query(b.with_(["choice"], "SELECT canonical_dish_id, chosen_model_version, round(mae, 6) AS mae, n_rows FROM choice"))
def policy_choice(spark: SparkSession, folder: str) -> DataFrame:
    errors = policies.mae_by_dish(b.backtest(spark, folder))
    return policies.choose_models(errors).withColumn("mae", F.round("mae", 6))


@query(
    b.with_(
        ["policy"],
        "SELECT * REPLACE (CAST(effective_from AS VARCHAR) AS effective_from), CAST(NULL AS VARCHAR) AS effective_to FROM policy",
    )
)
def policy_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return b.policy(spark, folder)


@query(
    b.with_(
        ["policy"],
        "SELECT chosen_model_version, count(*) AS cnt FROM policy WHERE is_active GROUP BY 1",
    )
)
def policy_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return policies.policy_distribution(b.policy(spark, folder))


@query(
    b.with_(
        ["latest"],
        """SELECT canonical_dish_id, CAST(forecast_origin_date AS VARCHAR) AS forecast_origin_date,
  CAST(target_date AS VARCHAR) AS target_date, CAST(yhat AS DOUBLE) AS yhat, model_version, run_id FROM latest""",
    )
)
def serving_latest(spark: SparkSession, folder: str) -> DataFrame:
    history = b.stored_panel(spark, folder)
    allowed = policies.allowed_forecasts(b.forecasts(spark, folder, history), b.policy(spark, folder, history))
    return policies.latest_forecasts(allowed).drop("created_at")


@query(
    b.with_(
        ["serving"],
        """SELECT price_id, canonical_dish_id, CAST(forecast_origin_date AS VARCHAR) AS forecast_origin_date,
  CAST(target_date AS VARCHAR) AS target_date, CAST(yhat AS DOUBLE) AS yhat, model_version, run_id FROM serving""",
    )
)
def serving_view(spark: SparkSession, folder: str) -> DataFrame:
    return b.serving(spark, folder)


HEALTH = {
    "F1": ("forecast", 15, ">=", "error", "(SELECT count(DISTINCT canonical_dish_id) FROM made)"),
    "F2": (
        "forecast", 0.8, ">=", "error",
        "(SELECT count(*) FILTER (WHERE n >= 6) / count(*) FROM (SELECT count(DISTINCT target_date) AS n FROM made GROUP BY canonical_dish_id))",
    ),
    "F3": ("forecast", 0.1, "<=", "error", "(SELECT count(*) FILTER (WHERE yhat = 0) / count(*) FROM made)"),
    "B1": ("backtest", 15, ">=", "error", "(SELECT count(DISTINCT canonical_dish_id) FROM backtest)"),
    "B2": ("backtest", 2, ">=", "error", "(SELECT count(DISTINCT model_version) FROM backtest)"),
    "P1": ("policy", 1, ">=", "error", "(SELECT count(*) FROM policy WHERE is_active)"),
    "P2": (
        "policy", 0.9, "<=", "error",
        "(SELECT count(*) FILTER (WHERE lower(chosen_model_version) LIKE '%baseline%') / count(*) FROM policy WHERE is_active)",
    ),
    "P3": (
        "policy", 1, ">=", "warning",
        "(SELECT count(DISTINCT canonical_dish_id) FILTER (WHERE canonical_dish_id IN (SELECT canonical_dish_id FROM policy WHERE is_active)) / count(DISTINCT canonical_dish_id) FROM made)",
    ),
    "S1": ("serving", 1, ">=", "error", "(SELECT count(*) FROM served)"),
    "S2": (
        "serving", 0.7, ">=", "error",
        "(SELECT (SELECT count(DISTINCT canonical_dish_id) FROM served) / count(DISTINCT canonical_dish_id) FROM price_bridge WHERE is_active)",
    ),
    "S3": ("serving", 0.1, "<=", "error", "(SELECT count(*) FILTER (WHERE yhat = 0) / count(*) FROM served)"),
}


HEALTH_MADE = {
    "made": f"SELECT * FROM forecast WHERE forecast_origin_date = DATE '{b.ORIGIN}'",
    "served": f"SELECT * FROM serving WHERE forecast_origin_date = DATE '{b.ORIGIN}'",
}
HEALTH_SQL = (
    "SELECT layer, check_id, round(value, 9) AS value, threshold, severity, CASE op WHEN '>=' THEN value >= threshold "
    "ELSE value <= threshold END AS passed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{c}' AS check_id, CAST({value} AS DOUBLE) AS value, CAST({t} AS DOUBLE) AS threshold, "
        f"'{sev}' AS severity, '{op}' AS op"
        for c, (layer, t, op, sev, value) in HEALTH.items()
    )
    + ")"
)
HEALTH_NEEDS = ["serving", "backtest", "policy", "price_bridge", "forecast"]


def _report(spark: SparkSession, folder: str) -> DataFrame:
    """All gates of one origin. Each stage is written once, as the weekly run does."""
    history = b.stored_panel(spark, folder)
    forecasts = materialize(b.forecasts(spark, folder, history), "forecasts")
    backtest = materialize(b.backtest(spark, folder, history), "backtest")
    policy = materialize(policies.write_policy(b.old_policy(spark, folder), backtest, b.ORIGIN), "policy")
    price_bridge = b.price_bridge(spark, folder)
    serving = materialize(policies.serving_view(forecasts, policy, price_bridge), "serving")
    return gates.health_report(forecasts, backtest, policy, serving, price_bridge, b.ORIGIN)


@query(b.with_(HEALTH_NEEDS, HEALTH_SQL, **HEALTH_MADE))
def health_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder).withColumn("value", F.round("value", 9))


@query(
    b.with_(
        HEALTH_NEEDS,
        f"""SELECT layer, check_id, '[' || layer || '] ' || check_id || ': ' || printf('%.4f', value) || ' (threshold ' || printf('%.4f', threshold) || ', '
  || severity || ')' AS line, NOT passed AND severity = 'error' AS blocking FROM ({HEALTH_SQL})""",
        **HEALTH_MADE,
    )
)
def health_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The report as text lines, and those that stop the run."""
    return gates.report_lines(_report(spark, folder))


@query(
    b.with_(
        ["backtest"],
        "SELECT row_number() OVER (ORDER BY model_version) AS place, model_version FROM (SELECT DISTINCT model_version FROM backtest)",
    )
)
def backtest_versions(spark: SparkSession, folder: str) -> DataFrame:
    return gates.backtest_versions(b.backtest(spark, folder))


@query(
    b.with_(
        ["fc"],
        f"""SELECT canonical_dish_id, CAST(origin AS VARCHAR) AS forecast_origin_date, CAST(target_date AS VARCHAR) AS target_date,
  CAST(yhat AS DOUBLE) AS yhat, model_version, 'weekly' AS run_id
FROM fc WHERE origin = DATE '{b.ORIGIN}' AND model_version = 'baseline_k4'""",
    )
)
def weekly_run(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly job without a model file: history loaded, baseline made, rows stored and read back."""
    from larder.context import scratch_folder

    run = weekly.WeeklyRun(origin=b.ORIGIN, run_id="weekly", baseline_version="baseline_k4")
    path = scratch_folder(spark, "forecast-fact")
    weekly.weekly_forecast(b.stored_panel(spark, folder), run, path)
    return spark.read.parquet(path).select(
        "canonical_dish_id", "forecast_origin_date", "target_date", "yhat", "model_version", "run_id"
    )


@query(
    b.with_(
        ["fc"],
        f"""SELECT canonical_dish_id, CAST(origin AS VARCHAR) AS forecast_origin_date, CAST(target_date AS VARCHAR) AS target_date,
  CAST(yhat AS DOUBLE) AS yhat, model_version, 'weekly' AS run_id
FROM fc WHERE origin = DATE '{b.ORIGIN}' AND model_version = 'baseline_k4'""",
    )
)
def weekly_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """The same weekly job twice over the stored fact: the second run updates its rows in place."""
    from larder.context import scratch_folder

    run = weekly.WeeklyRun(origin=b.ORIGIN, run_id="weekly", baseline_version="baseline_k4")
    path, history = scratch_folder(spark, "forecast-fact"), b.stored_panel(spark, folder)
    weekly.weekly_forecast(history, run, path)
    weekly.weekly_forecast(history, run, path, stored=spark.read.parquet(path))
    return spark.read.parquet(path).select(
        "canonical_dish_id", "forecast_origin_date", "target_date", "yhat", "model_version", "run_id"
    )


@query(
    b.with_(
        ["serving", "policy"],
        f"""SELECT 'active_policies' AS check_id, CAST((SELECT count(*) FROM policy WHERE is_active) AS DOUBLE) AS value,
  (SELECT count(*) FROM policy WHERE is_active) >= 1 AS passed
UNION ALL SELECT 'serving_rows', CAST((SELECT count(*) FROM serving WHERE forecast_origin_date = DATE '{b.ORIGIN}') AS DOUBLE),
  (SELECT count(*) FROM serving WHERE forecast_origin_date = DATE '{b.ORIGIN}') >= 1""",
    )
)
def smoke_checks(spark: SparkSession, folder: str) -> DataFrame:
    history = b.stored_panel(spark, folder)
    policy = materialize(b.policy(spark, folder, history), "policy")
    serving = policies.serving_view(b.forecasts(spark, folder, history), policy, b.price_bridge(spark, folder))
    return gates.smoke_checks(policy, serving, b.ORIGIN).select("check_id", "value", "passed")


@query(
    b.with_(
        ["backtest"],
        """SELECT 'run' AS run_id, CAST(fold_id AS BIGINT) AS fold_id, CAST(forecast_origin_date AS VARCHAR) AS forecast_origin_date,
  CAST(target_date AS VARCHAR) AS target_date, canonical_dish_id, model_version, CAST(y_true AS DOUBLE) AS y_true,
  CAST(CASE WHEN fold_id < 2 THEN -1 ELSE yhat END AS DOUBLE) AS yhat, CAST(residual AS DOUBLE) AS residual,
  CAST(abs_error AS DOUBLE) AS abs_error, CASE WHEN fold_id < 2 THEN NULL ELSE baseline_method END AS baseline_method FROM backtest""",
    )
)
def backtest_load(spark: SparkSession, folder: str) -> DataFrame:
    """A backtest file loaded onto a table that holds its first folds already (with other values)."""
    from larder.plans import staging

    rows = materialize(b.backtest(spark, folder), "backtest").withColumn("run_id", F.lit("run"))
    landed = rows.select(*[F.col(c).cast("string").alias(c) for c in [*staging.BACKTEST_REQUIRED, "baseline_method"]])
    stored = staging.parse_backtest(landed.filter("fold_id < 2").drop("baseline_method")).withColumns(
        {"yhat": F.lit(-1.0), "baseline_method": F.lit(None).cast("string")}
    )
    return staging.load_backtest(stored, landed)
