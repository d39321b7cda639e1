"""The row rules of the stored tables, as one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.validate import check_constraints

#: Rules by table. A rule that is NULL for a row (an open end) is not broken.
TABLE_RULES: dict[str, dict[str, str]] = {
    "forecast": {"yhat is not negative": "yhat >= 0", "target not before origin": "target_date >= forecast_origin_date"},
    "backtest": {"error is not negative": "abs_error >= 0"},
    "price_bridge": {"validity ends after its start": "valid_to >= valid_from"},
    "policy": {"effect ends after its start": "effective_to >= effective_from"},
    "food_bridge": {"last seen not before first": "last_seen_date >= first_seen_date"},
}


def broken_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rule, n_violations`` of every rule of the given tables; one scan a table."""
    parts = [
        check_constraints(df, {rule: F.expr(test) for rule, test in TABLE_RULES[name].items()}).select(F.lit(name).alias("table_name"), "rule", "n_violations")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
