"""Writers. Operators return new table states; these put them on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.operators.mutate import upsert


def write_staging(df: DataFrame, path: str, truncate: bool = True) -> str:
    """Full refresh (default) or append."""
    df.write.mode("overwrite" if truncate else "append").parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> str:
    """Overwrite only the partitions present in ``df``; each partition value is written by tasks of its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


FORECAST_KEY = ["run_id", "canonical_dish_id", "forecast_origin_date", "target_date", "model_version"]


def upsert_forecasts(stored: DataFrame | None, rows: DataFrame, path: str) -> int:
    """Batch upsert of forecast rows into the table at ``path``, which is partitioned by origin; returns the attempted
    rows. ``stored`` is that table, None if it does not exist yet.

    The origin is part of the key, so only the partitions of the batch's origins can change: they alone are read,
    merged, written to the shared folder and then swapped in. A repeated run gives the same table.
    """
    batch = materialize(rows, "forecast-rows")
    merged = batch.withColumn("created_at", F.current_timestamp())
    if stored is not None:
        origins = batch.select("forecast_origin_date").distinct()
        touched = stored.join(origins, "forecast_origin_date", "left_semi").select(*merged.columns)
        merged = materialize(upsert(touched, merged, FORECAST_KEY), "forecast-merge")
    write_partitioned(merged, path, ["forecast_origin_date"])
    return batch.count()


def write_json_with_metadata(items: DataFrame, path: str, error_col: str = "error") -> DataFrame:
    """Write the items as JSON and, beside them, one metadata row: totals, successes, errors."""
    tally = items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(error_col).isNull()).alias("success"),
        F.count_if(F.col(error_col).isNotNull()).alias("errors"),
    )
    items.write.mode("overwrite").json(f"{path}/items")
    tally.write.mode("overwrite").json(f"{path}/metadata")
    return tally
