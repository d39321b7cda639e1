"""Calendar expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON_DAYS = 6


def day_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def iso_weekday(d: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(d) + 1


def is_closed_day(d: Column) -> Column:
    """The shop rests on Mondays."""
    return F.weekday(d) == 0


def horizon_index(d: Column, origin: Column) -> Column:
    """0 for the day after the origin's weekday, counted modulo a week."""
    return F.pmod(F.weekday(d) - F.weekday(origin) - 1, F.lit(7))


def horizon_dates(origin: Column, days: int = HORIZON_DAYS) -> Column:
    """The forecast days of an origin as an array: the ``days`` days after it."""
    return F.sequence(F.date_add(origin, 1), F.date_add(origin, days))


def monday_on_or_before(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def require_monday(day: dt.date) -> dt.date:
    if day.weekday() != 0:
        raise ValueError(f"forecast origin {day} is not a Monday")
    return day
