"""The query registry.

A query function returns typed columns. At the edge dates and timestamps become ISO text, decimals become doubles and
small integers become longs, so that a result means the same to every client.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def edge(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(sql: str | None = None, name: str | None = None):
    """Register a (spark, folder) function under its name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return edge(fn(spark, folder))

        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return run

    return register
