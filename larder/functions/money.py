"""Money is DECIMAL, rounded half up to two places; forecasts round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: Column) -> Column:
    """Round half up to two places (double input goes through its decimal text, not its binary value)."""
    return F.round(c.cast("decimal(24,8)"), 2).cast("decimal(18,2)")


def line_total(price: Column, quantity: Column) -> Column:
    return F.round(cents(price) * quantity.cast("decimal(12,0)"), 2).cast("decimal(18,2)")


def whole_units(yhat: Column) -> Column:
    """Forecast to a count: negatives become 0, halves go to the even neighbour."""
    return F.rint(F.greatest(yhat, F.lit(0.0))).cast("int")
