"""Backtest errors to model policy to served forecasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.grouping import first_per_key
from larder.operators.mutate import upsert

POLICY_NOTE = "offline policy from backtest: min MAE"


def mae_by_dish(backtest: DataFrame) -> DataFrame:
    return backtest.groupBy("canonical_dish_id", "model_version").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("abs_error").alias("mae")
    )


def choose_models(errors: DataFrame) -> DataFrame:
    """The version with the lowest error per dish; equal errors go to the first name."""
    best = first_per_key(errors, ["canonical_dish_id"], [F.col("mae"), F.col("model_version")])
    return best.select("canonical_dish_id", F.col("model_version").alias("chosen_model_version"), "mae", "n_rows")


def write_policy(policy: DataFrame, backtest: DataFrame, effective_from: dt.date) -> DataFrame:
    """Upsert the chosen models as open-ended active rows; dishes without a new choice keep theirs."""
    choice = choose_models(mae_by_dish(backtest)).select(
        "canonical_dish_id",
        "chosen_model_version",
        F.lit(effective_from).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.lit(True).alias("is_active"),
        F.lit(POLICY_NOTE).alias("note"),
    )
    return upsert(policy, choice, ["canonical_dish_id"])


def allowed_forecasts(forecasts: DataFrame, policy: DataFrame) -> DataFrame:
    """Forecasts of each dish's active chosen model; versions are compared without surrounding blanks."""
    active = policy.filter("is_active").select(
        "canonical_dish_id", F.trim("chosen_model_version").alias("_version")
    )
    named = forecasts.withColumn("_version", F.trim("model_version"))
    return named.join(active, ["canonical_dish_id", "_version"]).drop("_version")


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """Per dish and day the forecast of the newest origin, newest creation, then the last run id.

    Ranking happens over all origins, so filtering the result by origin hides days a later origin has replaced.
    """
    order = [F.col("forecast_origin_date").desc(), F.col("created_at").desc(), F.col("run_id").desc()]
    return first_per_key(forecasts, ["canonical_dish_id", "target_date"], order)


def serving_price(price_bridge: DataFrame) -> DataFrame:
    """One price id per dish: the smallest active one."""
    return price_bridge.filter("is_active").groupBy("canonical_dish_id").agg(F.min("dish_price_id").alias("price_id"))


def serving_view(forecasts: DataFrame, policy: DataFrame, price_bridge: DataFrame) -> DataFrame:
    chosen = latest_forecasts(allowed_forecasts(forecasts, policy))
    return chosen.join(serving_price(price_bridge), "canonical_dish_id").select(
        "price_id", "canonical_dish_id", "forecast_origin_date", "target_date", "yhat", "model_version", "run_id"
    )


def policy_distribution(policy: DataFrame) -> DataFrame:
    counts = policy.filter("is_active").groupBy("chosen_model_version").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), "chosen_model_version")
