"""Leakage-safe forecast features, driven by a feature configuration.

The panel holds one short series per dish, so each window below is bounded by the number of days. Lag, rolling and
last-known columns share one shuffle and one sort because they use the same partition and order.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions.dates import horizon_dates, horizon_index
from larder.operators.grouping import top_per_key

# Rolling statistics that a configuration may name.
ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, 0.5),
}
STATIC = ["category", "price", "is_market_price"]


@dataclass(frozen=True)
class FeatureConfig:
    """Which features to build; ``columns`` is their one and only order."""

    id_col: str = "canonical_dish_id"
    date_col: str = "close_work_date"
    target_col: str = "qty"
    use_id: bool = True
    static: list[str] = field(default_factory=list)
    use_closed: bool = False
    use_weekday: bool = False
    use_target_day: bool = False
    lags: list[int] = field(default_factory=list)
    windows: list[int] = field(default_factory=list)
    stats: list[str] = field(default_factory=list)

    def __post_init__(self):
        unknown = [s for s in self.stats if s not in ROLLING] + [s for s in self.static if s not in STATIC]
        if unknown:
            raise ValueError(f"unknown features {unknown}")

    @property
    def columns(self) -> list[str]:
        names = [self.id_col] if self.use_id else []
        names += [s for s in STATIC if s in self.static]
        names += ["is_closed"] * self.use_closed
        names += ["day_of_week"] * self.use_weekday + ["target_day"] * self.use_target_day
        names += [f"lag_{k}" for k in self.lags]
        names += [f"roll_{s}_{w}" for w in self.windows for s in self.stats]
        return list(dict.fromkeys(names))


def horizon_skeleton(ids: DataFrame, origin: dt.date) -> DataFrame:
    """Every id with each forecast day of the origin."""
    return ids.select("*", F.explode(horizon_dates(F.lit(origin))).alias("target_date"))


def lag_columns(series: Column, window, lags: list[int]) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(series, k).over(window) for k in lags}


def rolling_columns(series: Column, window, windows: list[int], stats: list[str]) -> dict[str, Column]:
    """Statistics over the w rows before the current one; one known value is enough."""
    return {
        f"roll_{s}_{w}": ROLLING[s](series).over(window.rowsBetween(-w, -1)) for w in windows for s in stats
    }


def last_known(history: DataFrame, id_col: str, date_col: str, columns: list[str]) -> DataFrame:
    """Per id the latest non-NULL value of each column (each column on its own)."""
    return history.groupBy(id_col).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date_col))).alias(c) for c in columns]
    )


def extend_to_origin(history: DataFrame, origin: dt.date, id_col: str, date_col: str) -> DataFrame:
    """Rows with unknown demand for the days between an id's last history day and the origin.

    With them a lag of k rows is a lag of k days also when the history stops early.
    """
    last = history.groupBy(id_col).agg(F.max(date_col).alias("_last")).filter(F.col("_last") < F.lit(origin))
    return last.select(id_col, F.explode(F.sequence(F.date_add("_last", 1), F.lit(origin))).alias(date_col))


def forecast_features(
    history: DataFrame, origin: dt.date, config: FeatureConfig, ids: DataFrame | None = None
) -> DataFrame:
    """(id, target_date) with the configured features for the days after the origin.

    Demand after the origin is dropped before anything is computed, so it cannot leak.
    """
    i, d, y = config.id_col, config.date_col, config.target_col
    known = history.filter(F.col(d) <= F.lit(origin))
    ids = known.select(i).distinct() if ids is None else ids.select(i).distinct()
    skeleton = horizon_skeleton(ids, origin).withColumnRenamed("target_date", d)
    # A lag or window of n rows on the last horizon day reaches at most n rows back: older history is not needed.
    reach = max([1, *config.lags, *config.windows])
    recent = top_per_key(known.select(i, d, F.col(y).cast("double").alias("_y")), [i], [F.col(d).desc()], reach)
    combined = (
        recent
        .unionByName(extend_to_origin(known, origin, i, d), allowMissingColumns=True)
        .unionByName(skeleton, allowMissingColumns=True)
    )
    order = W.partitionBy(i).orderBy(d)
    built = combined.withColumns(
        {
            **lag_columns(F.col("_y"), order, config.lags),
            **rolling_columns(F.col("_y"), order, config.windows, config.stats),
        }
    ).filter(F.col(d) > F.lit(origin))
    built = built.join(ids, i, "left_semi").withColumns(
        {
            "day_of_week": F.weekday(d),
            "target_day": horizon_index(F.col(d), F.lit(origin)),
            "is_closed": F.lit(0),
        }
    )
    if config.static:
        built = built.join(last_known(known, i, d, config.static), i, "left")
    missing = [c for c in config.columns if c not in built.columns]
    if missing:
        raise ValueError(f"missing forecast features {missing}")
    out = list(dict.fromkeys([i, "target_date", *config.columns]))
    return built.withColumnRenamed(d, "target_date").select(*out)


def training_features(history: DataFrame, config: FeatureConfig, start: dt.date, origin: dt.date) -> DataFrame:
    """The same features for past days in (start, origin], with the known demand as ``label``."""
    i, d, y = config.id_col, config.date_col, config.target_col
    order = W.partitionBy(i).orderBy(d)
    built = history.filter(F.col(d) <= F.lit(origin)).withColumn("_y", F.col(y).cast("double"))
    built = built.withColumns(
        {
            **lag_columns(F.col("_y"), order, config.lags),
            **rolling_columns(F.col("_y"), order, config.windows, config.stats),
            "day_of_week": F.weekday(d),
            "target_day": F.pmod(F.weekday(d) - 1, F.lit(7)),
            "is_closed": F.coalesce(F.col("is_closed").cast("int"), F.lit(0)) if "is_closed" in history.columns else F.lit(0),
        }
    )
    past = built.filter((F.col(d) > F.lit(start)) & F.col("_y").isNotNull())
    return past.select(i, F.col(d).alias("target_date"), *[c for c in config.columns if c != i], F.col("_y").alias("label"))
