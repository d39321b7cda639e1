"""The weekly forecast job: baseline always, a model when there is one, one stored state of the forecast fact."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.dates import monday_on_or_before, require_monday
from larder.functions.money import whole_units
from larder.operators import validate
from larder.operators.baseline import K_WEEK_MEDIAN, K_WEEKS, baseline_forecast
from larder.operators.features import FeatureConfig, forecast_features, training_features
from larder.sources.sinks import upsert_forecasts

CATEGORIES = ["category"]


def fit_trees(history: DataFrame, config: FeatureConfig, start: dt.date, origin: dt.date, rounds: int = 5) -> PipelineModel:
    """Boosted trees on the configured features in their order; unseen categories get an index of their own."""
    texts = [c for c in config.columns if c in CATEGORIES]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in texts]
    inputs = [f"{c}_index" if c in texts else c for c in config.columns]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=4, seed=7),
    ]
    rows = _numbers(training_features(history, config, start, origin), config)
    return Pipeline(stages=stages).fit(rows)


def _numbers(rows: DataFrame, config: FeatureConfig) -> DataFrame:
    """Numeric features as doubles; a missing one is -1, which no demand or lag can be."""
    numeric = [c for c in config.columns if c not in CATEGORIES]
    return rows.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numeric if c != config.id_col}
    )


def score(model: PipelineModel, rows: DataFrame, config: FeatureConfig) -> DataFrame:
    scored = model.transform(_numbers(rows, config))
    return scored.withColumn("yhat", whole_units(F.col("prediction"))).select(config.id_col, "target_date", "yhat")


def score_with(
    load: Callable[[], object], rows: DataFrame, config: FeatureConfig, best_iteration: int | None = None
) -> DataFrame:
    """Score with any object that has ``predict(frame)``; ``load`` runs once per task, on the executor."""
    columns, key = config.columns, config.id_col

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        extra = {} if best_iteration is None else {"num_iteration": best_iteration}
        for batch in batches:
            yield pd.DataFrame(
                {key: batch[key], "target_date": batch["target_date"], "y": model.predict(batch[columns], **extra)}
            )

    made = rows.mapInPandas(run, f"{key} long, target_date date, y double")
    return made.select(key, "target_date", whole_units(F.col("y")).alias("yhat"))


@dataclass(frozen=True)
class WeeklyRun:
    """One run. ``score_model(history, origin)`` is optional; a scorer that finds no model file may return None."""

    origin: dt.date
    run_id: str
    baseline_version: str | None = None
    method: str = K_WEEK_MEDIAN
    k: int = K_WEEKS
    model_version: str | None = None
    score_model: Callable[[DataFrame, dt.date], DataFrame | None] | None = None
    config: dict = field(default_factory=dict)

    def version(self, given: str | None, section: str) -> str:
        """From the argument, else from the configuration; a run without a version must not write."""
        found = given or self.config.get(section, {}).get("model_version")
        if not found:
            raise ValueError(f"{section} version is missing")
        return found


def origin_for(day: dt.date, given: dt.date | None = None) -> dt.date:
    """The given origin (must be a Monday) or the latest Monday."""
    return require_monday(given) if given else monday_on_or_before(day)


def forecast_rows(history: DataFrame, run: WeeklyRun) -> DataFrame:
    """Baseline and model rows of the origin under their versions."""
    require_monday(run.origin)
    version = run.version(run.baseline_version, "baseline")
    past = history.filter(F.col("close_work_date") < F.lit(run.origin))
    validate.require_rows(past, f"history before {run.origin}")
    rows = _stamped(baseline_forecast(history, run.origin, run.method, run.k), run, version)
    scored = run.score_model(history, run.origin) if run.score_model else None
    if scored is not None:
        rows = rows.unionByName(_stamped(scored, run, run.version(run.model_version, "model")))
    return rows


#: What a forecast row must be unique in.
GRAIN = ["run_id", "canonical_dish_id", "forecast_origin_date", "target_date", "model_version"]


def key_report(rows: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Per version: ``n_rows`` and ``n_unique`` keys; they differ where rows repeat a key."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("model_version").agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))


def _stamped(rows: DataFrame, run: WeeklyRun, version: str) -> DataFrame:
    return rows.select(
        "canonical_dish_id",
        F.lit(run.origin).alias("forecast_origin_date"),
        "target_date",
        F.col("yhat").cast("decimal(18,6)").alias("yhat"),
        F.lit(version).alias("model_version"),
        F.lit(run.run_id).alias("run_id"),
    )


def weekly_forecast(history: DataFrame, run: WeeklyRun, path: str, stored: DataFrame | None = None) -> int:
    """Upsert the run's rows into the forecast table at ``path``; returns the attempted rows."""
    return upsert_forecasts(stored, forecast_rows(history, run), path)
