"""Health gates of a weekly run, all evaluated before any failure is reported."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the gates.
MIN_FORECAST_DISHES = 15
HORIZON_DAYS = 6
MIN_HORIZON_SHARE = 0.80
MIN_BACKTEST_DISHES = 15
MIN_BACKTEST_VERSIONS = 2
MAX_BASELINE_SHARE = 0.90
MIN_SERVING_COVERAGE = 0.70
MAX_ZERO_SHARE = 0.10


class GateFailed(RuntimeError):
    """At least one blocking gate failed; the message lists all of them."""


def _part(some: Column, all_: Column) -> Column:
    """Part of the rows; 0 when there are none."""
    return F.coalesce(F.try_divide(some.cast("double"), all_), F.lit(0.0))


def share(condition: Column) -> Column:
    return _part(F.count_if(condition), F.count(F.lit(1)))


def _lines(df: DataFrame, layer: str, checks: list[tuple[str, Column, str, float, str]]) -> DataFrame:
    """All checks (id, value, ``>=`` or ``<=``, threshold, severity) of one layer from one aggregation."""
    measured = df.agg(*[value.cast("double").alias(name) for name, value, *_ in checks])
    rows = [
        F.struct(
            F.lit(layer).alias("layer"),
            F.lit(name).alias("check_id"),
            F.col(name).alias("value"),
            F.lit(float(limit)).alias("threshold"),
            F.lit(severity).alias("severity"),
            (F.col(name) >= limit if sign == ">=" else F.col(name) <= limit).alias("passed"),
        )
        for name, _, sign, limit, severity in checks
    ]
    return measured.select(F.inline(F.array(*rows)))


def smoke_checks(policy: DataFrame, serving: DataFrame, origin: dt.date) -> DataFrame:
    """At least one active policy and one served row of the origin."""
    n = F.count(F.lit(1))
    active = _lines(policy.filter("is_active"), "smoke", [("active_policies", n, ">=", 1, "error")])
    return active.unionByName(_lines(_of(serving, origin), "smoke", [("serving_rows", n, ">=", 1, "error")]))


def _of(df: DataFrame, origin: dt.date) -> DataFrame:
    return df.filter(F.col("forecast_origin_date") == F.lit(origin))


def health_report(
    forecasts: DataFrame,
    backtest: DataFrame,
    policy: DataFrame,
    serving: DataFrame,
    price_bridge: DataFrame,
    origin: dt.date,
) -> DataFrame:
    """One row per check: layer, check, value, threshold, severity, passed. Each layer's table is read once.

    Forecast and serving rows are counted per dish first; all shares follow from those counts.
    """
    dish = "canonical_dish_id"
    active = policy.filter("is_active")
    rows, zeros = F.count(F.lit(1)).alias("n"), F.count_if(F.col("yhat") == 0).alias("zeros")
    made = _of(forecasts, origin).groupBy(dish).agg(F.count_distinct("target_date").alias("days"), rows, zeros)
    covered = made.join(active.select(dish).distinct().withColumn("ok", F.lit(True)), dish, "left")
    served = _of(serving, origin).groupBy(dish).agg(rows, zeros).withColumn("served", F.lit(True))
    mapped = price_bridge.filter("is_active").select(dish).distinct().withColumn("mapped", F.lit(True))
    visible = served.join(mapped, dish, "full_outer")
    n = F.count(F.lit(1))
    total, none = F.coalesce(F.sum("n"), F.lit(0)), F.sum("zeros")
    forecast = _lines(
        covered,
        "forecast",
        [
            ("F1", n, ">=", MIN_FORECAST_DISHES, "error"),
            ("F2", share(F.col("days") >= HORIZON_DAYS), ">=", MIN_HORIZON_SHARE, "error"),
            ("F3", _part(none, total), "<=", MAX_ZERO_SHARE, "error"),
            ("P3", share(F.col("ok").isNotNull()), ">=", 1.0, "warning"),
        ],
    ).withColumn("layer", F.when(F.col("check_id") == "P3", "policy").otherwise(F.col("layer")))
    tested = _lines(
        backtest,
        "backtest",
        [
            ("B1", F.count_distinct(dish), ">=", MIN_BACKTEST_DISHES, "error"),
            ("B2", F.count_distinct("model_version"), ">=", MIN_BACKTEST_VERSIONS, "error"),
        ],
    )
    chosen = _lines(
        active,
        "policy",
        [
            ("P1", n, ">=", 1, "error"),
            ("P2", share(F.lower("chosen_model_version").like("%baseline%")), "<=", MAX_BASELINE_SHARE, "error"),
        ],
    )
    shown = _lines(
        visible,
        "serving",
        [
            ("S1", total, ">=", 1, "error"),
            ("S2", _part(F.count_if(F.col("mapped") & F.col("served")), F.count("mapped")), ">=", MIN_SERVING_COVERAGE, "error"),
            ("S3", _part(none, total), "<=", MAX_ZERO_SHARE, "error"),
        ],
    )
    return forecast.unionByName(tested).unionByName(chosen).unionByName(shown)


def backtest_versions(backtest: DataFrame) -> DataFrame:
    """``place, model_version``: the versions (a handful) in the backtest, in order."""
    versions = backtest.select("model_version").distinct()
    return versions.select(F.row_number().over(Window.orderBy("model_version")).alias("place"), "model_version")


def report_lines(report: DataFrame) -> DataFrame:
    """``layer, check_id, line, blocking``: the report as text, and which lines stop a run."""
    line = F.format_string("[%s] %s: %.4f (threshold %.4f, %s)", "layer", "check_id", "value", "threshold", "severity")
    return report.select("layer", "check_id", line.alias("line"), (~F.col("passed") & (F.col("severity") == "error")).alias("blocking"))


def require_healthy(report: DataFrame) -> list[str]:
    """Text lines of the report (at most one per check); raises once, with every blocking failure."""
    rows = report_lines(report).collect()  # one row per check
    failed = [r.line for r in rows if r.blocking]
    if failed:
        raise GateFailed("; ".join(failed))
    return [r.line for r in rows]
