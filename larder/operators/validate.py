"""Checks as violation rows, and gates that refuse a load.

Report functions stay lazy. ``require_*`` functions run one small action (an existence test, at most 20 rows) because a
load must stop before anything is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larder.context import materialize

SAMPLE_ROWS = 20


class LoadRejected(ValueError):
    """A load broke a rule; the message names it and shows sample rows."""


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise LoadRejected(f"missing required columns {missing}, seen {df.columns}")
    return df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Project to the mapped columns under their new names (a column may be absent only if the caller allowed it)."""
    require_columns(df, list(mapping))
    return df.select([F.col(f"`{a}`").alias(b) for a, b in mapping.items()])


def require_none(bad: DataFrame, rule: str) -> None:
    sample = bad.limit(SAMPLE_ROWS).collect()
    if sample:
        raise LoadRejected(f"{rule}: " + "; ".join(str(r.asDict()) for r in sample))


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def require_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    require_none(null_rows(df, columns).select(columns), f"NULL in {columns}")
    return df


def fractional(c: Column) -> Column:
    """True for a number that an integer column could only hold by truncation."""
    n = c.try_cast("double")
    return F.coalesce(n != F.floor(n), F.lit(False))


def require_whole(df: DataFrame, columns: list[str]) -> DataFrame:
    """Integer-safe cast: fractional quantities are an error, unreadable ones become NULL."""
    bad = reduce(lambda a, b: a | b, [fractional(F.col(c)) for c in columns])
    require_none(df.filter(bad).select(columns), f"fractional value in {columns}")
    return df.withColumns({c: F.col(c).try_cast("double").try_cast("long") for c in columns})


class Counted:
    """Rows whose rule breakers are counted while they are written, so that a gate needs no scan of its own."""

    def __init__(self, df: DataFrame, broken: dict[str, Column]):
        self._seen = Observation()
        totals = [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in broken.items()]
        self._df = df.observe(self._seen, F.count(F.lit(1)).alias("n_rows"), *totals)
        self.n_rows: int | None = None
        self.counts: dict[str, int] = {}

    def store(self, purpose: str) -> DataFrame:
        """Write the rows to the scratch folder and read them back; ``n_rows`` and ``counts`` are known then."""
        stored = materialize(self._df, purpose)
        seen = dict(self._seen.get)
        self.n_rows, self.counts = seen.pop("n_rows"), seen
        return stored


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise LoadRejected(f"{what} is empty")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; keys holding a NULL never collide."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: how many rows break it. As in SQL a rule that is NULL for a row is not broken."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n_violations")) for n in rules]
    return counts.select(F.inline(F.array(*pairs)))


def check_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The (rule, n_violations) row of a unique constraint: how many key values repeat."""
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("rule"), "*")


def not_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def not_before(later: Column, earlier: Column) -> Column:
    """Range constraint; open ends pass."""
    return later >= earlier


def zero_or_one(c: Column) -> Column:
    return c.cast("int").isin(0, 1)
