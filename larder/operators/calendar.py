"""The date dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import dates

# Span of the calendar when there are no sales yet, and its margin around the sales.
DEFAULT_START, DEFAULT_END = "2020-01-01", "2030-12-31"
MARGIN_DAYS = 365


def calendar_columns(days: DataFrame, date: str = "date") -> DataFrame:
    """Describe every date of a one-column frame."""
    d = F.col(date)
    return days.select(
        dates.day_key(d).alias("date_key"),
        d.alias("date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.day(d).alias("day"),
        dates.iso_weekday(d).alias("day_of_week_iso"),
        F.date_format(d, "EEEE").alias("day_name_en"),
        (dates.iso_weekday(d) >= 6).alias("is_weekend"),
        F.weekofyear(d).alias("iso_week"),
        F.trunc(d, "WEEK").alias("week_start_date"),
        F.trunc(d, "MM").alias("month_start_date"),
        F.last_day(d).alias("month_end_date"),
        dates.is_closed_day(d).alias("is_shop_closed"),
    )


def sales_span(sales: DataFrame, date: str = "close_work_date", margin: int = MARGIN_DAYS) -> DataFrame:
    """One row (start_date, end_date): the sales span with a margin, or the default span; bounds put in order."""
    found = sales.agg(
        F.coalesce(F.date_sub(F.min(date), margin), F.lit(DEFAULT_START).cast("date")).alias("a"),
        F.coalesce(F.date_add(F.max(date), margin), F.lit(DEFAULT_END).cast("date")).alias("b"),
    )
    return found.select(F.least("a", "b").alias("start_date"), F.greatest("a", "b").alias("end_date"))


def date_dimension(sales: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Calendar rows around the sales that ``existing`` does not hold yet."""
    days = sales_span(sales).select(F.explode(F.sequence("start_date", "end_date")).alias("date"))
    if existing is not None:
        days = days.join(existing.select("date"), "date", "left_anti")
    return calendar_columns(days)
