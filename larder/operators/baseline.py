"""Median baselines: lookup tables trained on the past, with two fallbacks.

Medians are exact. Spark's ``percentile`` keeps one counter per distinct value and merges the counters of the map tasks,
so the state of a group is bounded by its distinct quantities, not by its rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.dates import horizon_dates
from larder.functions.money import whole_units
from larder.functions.text import let
from larder.operators.features import horizon_skeleton
from larder.operators.grouping import running_sum, top_per_key

K_WEEKS = 4
K_WEEK_MEDIAN, SEASONAL_MEDIAN = "k_week_median", "seasonal_median"


@dataclass(frozen=True)
class Baseline:
    """``lookup`` (group columns, y_pred), ``by_id`` (id, y_pred) or None, ``overall`` (one row, y_pred)."""

    group_cols: list[str]
    id_col: str
    lookup: DataFrame
    by_id: DataFrame | None
    overall: DataFrame


def exact_median(
    df: DataFrame, keys: list[str], value: str, name: str = "y_pred", weight: Column | None = None, parts: int | None = None
) -> DataFrame:
    """Exact median per key; rows with a NULL key form a group of their own, NULL values do not count.

    ``weight`` (whole, at least 0) tells how many rows a row stands for. The result also has ``n_rows``, the number that counted.
    """
    key = F.struct(*(keys or [F.lit(0).alias("_all")])).alias("_key")
    times = F.lit(1) if weight is None else weight
    counted = df.select(key, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_n")).groupBy("_key", "_v").agg(
        F.sum(F.when(F.col("_v").isNull(), 0).otherwise(F.col("_n"))).alias("_n")
    )
    ranked = running_sum(counted, ["_key"], "_v", {"_c": F.col("_n")}, parts)
    totals = ranked.groupBy("_key").agg(F.max("_c").alias("n_rows"))
    placed = ranked.filter("_n > 0").join(totals, "_key")
    middle = F.lit(False)
    for place in (F.floor((F.col("n_rows") + 1) / 2), F.floor((F.col("n_rows") + 2) / 2)):
        middle = middle | ((F.col("_c") >= place) & (F.col("_c") - F.col("_n") < place))
    medians = placed.filter(middle).groupBy("_key").agg(F.avg("_v").alias(name))
    return totals.join(medians, "_key", "left").select(*[F.col("_key")[k].alias(k) for k in keys], name, "n_rows")


def _small_median(values: Column) -> Column:
    """Median of a short array of numbers; NULL for an empty one."""

    def middle(v: Column) -> Column:
        n = F.size(v)
        return (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2

    return let(F.array_sort(values), lambda v: F.when(F.size(v) > 0, middle(v)))


def recent_median(df: DataFrame, keys: list[str], date: str, value: str, k: int, unique: list[str]) -> DataFrame:
    """Median of the last k rows per key; ``unique`` breaks ties between rows of one date."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = [F.col(date).desc(), *[F.col(c) for c in unique]]
    return top_per_key(df, keys, order, k).groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), 0.5).alias("y_pred"))


def train_baseline(
    train: DataFrame,
    method: str,
    group_cols: list[str],
    id_col: str = "canonical_dish_id",
    date_col: str = "close_work_date",
    target_col: str = "qty",
    k: int = K_WEEKS,
) -> Baseline:
    overall = exact_median(train, [], target_col).select("y_pred")
    if method == K_WEEK_MEDIAN:
        lookup = recent_median(train, group_cols, date_col, target_col, k, [id_col])
        by_id = recent_median(train, [id_col], date_col, target_col, k, [])
    elif method == SEASONAL_MEDIAN:
        lookup = exact_median(train, group_cols, target_col).drop("n_rows")
        by_id = exact_median(train, [id_col], target_col).drop("n_rows") if id_col in group_cols else None
    else:
        raise ValueError(f"unknown baseline method {method}")
    return Baseline(group_cols, id_col, lookup, by_id, overall)


def predict_baseline(model: Baseline, rows: DataFrame) -> DataFrame:
    """Add ``y_pred``: the group's median, else the id's, else the overall one. NULL group keys match each other."""
    lookup = model.lookup.select(*[F.col(c).alias(f"_k_{c}") for c in model.group_cols], F.col("y_pred").alias("_g"))
    match = F.lit(True)
    for c in model.group_cols:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = rows.join(lookup, match, "left")
    tiers = ["_g"]
    if model.by_id is not None:
        by_id = model.by_id.select(F.col(model.id_col).alias("_id"), F.col("y_pred").alias("_i"))
        out = out.join(by_id, F.col(model.id_col).eqNullSafe(F.col("_id")), "left")
        tiers.append("_i")
    fallback = model.overall.scalar()
    return out.select(*rows.columns, F.coalesce(*tiers, fallback).alias("y_pred"))


def baseline_forecast(
    history: DataFrame, origin: dt.date, method: str = K_WEEK_MEDIAN, k: int = K_WEEKS, ids: DataFrame | None = None
) -> DataFrame:
    """(dish, target_date, yhat) for every dish and forecast day, trained strictly before the origin.

    Dishes come from the history unless ``ids`` lists others (a dish unknown to the history gets the overall median).
    """
    past = history.filter(F.col("close_work_date") < F.lit(origin)).withColumn(
        "day_of_week", F.weekday("close_work_date")
    )
    model = train_baseline(past, method, ["canonical_dish_id", "day_of_week"], k=k)
    ids = (past if ids is None else ids).select("canonical_dish_id").distinct()
    rows = horizon_skeleton(ids, origin).withColumn("day_of_week", F.weekday("target_date"))
    return predict_baseline(model, rows).select(
        "canonical_dish_id", "target_date", whole_units(F.col("y_pred")).alias("yhat")
    )


def fold_forecasts(history: DataFrame, origins: list[dt.date], versions: dict[str, dict]) -> DataFrame:
    """Baseline forecasts of many origins and versions in one job: (fold_id, origin, dish, target_date, version, yhat).

    A dish's days, one row each, are brought together once, newest first, whatever the number of folds; each fold then looks at those
    before its origin. So a history row moves once, and a row of the result comes from one array as long as the history has days.
    ``versions`` maps a version name to ``{"method": ..., "k": ...}``.
    """
    for spec in versions.values():
        if spec["method"] not in (K_WEEK_MEDIAN, SEASONAL_MEDIAN):
            raise ValueError(f"unknown baseline method {spec['method']}")
    folds = F.array(*[F.struct(F.lit(n).alias("fold_id"), F.lit(o).alias("origin")) for n, o in enumerate(origins)])
    day = F.struct(F.col("close_work_date").alias("date"), F.weekday("close_work_date").alias("weekday"), F.col("qty").cast("double").alias("qty"))
    whole = history.filter(F.col("close_work_date") < F.lit(max(origins))).groupBy("canonical_dish_id").agg(F.sort_array(F.collect_list(day), asc=False).alias("_days"))
    seen = whole.select("canonical_dish_id", "_days", F.inline(folds))
    seen = seen.withColumn("_days", F.filter("_days", lambda d: d["date"] < F.col("origin"))).filter(F.size("_days") > 0)

    def medians(days: Column) -> list[Column]:
        quantities = F.transform(days, lambda d: d["qty"])
        present = lambda x: F.filter(x, lambda q: q.isNotNull())
        return [_small_median(present(quantities if v["method"] == SEASONAL_MEDIAN else F.slice(quantities, 1, v.get("k", K_WEEKS)))) for v in versions.values()]

    of_dish = seen.withColumn("_i", F.array(*medians(F.col("_days"))))
    dated = of_dish.select("*", F.explode(horizon_dates(F.col("origin"))).alias("target_date"))
    own_days = F.filter("_days", lambda d: d["weekday"] == F.weekday("target_date"))
    fitted = dated.withColumn("_own", own_days).withColumn("_g", F.array(*medians(F.col("_own")))).drop("_days", "_own")
    made = [
        F.struct(
            F.lit(version).alias("model_version"),
            F.lit(spec["method"]).alias("baseline_method"),
            whole_units(F.coalesce(F.col("_g")[n], F.col("_i")[n])).alias("yhat"),
        )
        for n, (version, spec) in enumerate(versions.items())
    ]
    return fitted.select("fold_id", "origin", "canonical_dish_id", "target_date", F.inline(F.array(*made)))


def rolling_backtest(history: DataFrame, origins: list[dt.date], versions: dict[str, dict]) -> DataFrame:
    """Forecast errors for every origin and model version on the days whose demand is known."""
    truth = history.select("canonical_dish_id", F.col("close_work_date").alias("target_date"), F.col("qty").alias("y_true"))
    scored = fold_forecasts(history, origins, versions).join(truth, ["canonical_dish_id", "target_date"])
    residual = F.col("y_true") - F.col("yhat")
    return scored.select(
        "fold_id",
        F.col("origin").alias("forecast_origin_date"),
        "target_date",
        "canonical_dish_id",
        "model_version",
        "y_true",
        "yhat",
        residual.alias("residual"),
        F.abs(residual).alias("abs_error"),
        "baseline_method",
    )
