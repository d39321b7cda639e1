"""Numbers inside free text, written with Arabic or Chinese digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let

# Chinese digits and units.
DIGITS = {"零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "萬": 10000}


def _lookup(values: dict[str, int], ch: Column) -> Column:
    table = F.create_map(*[F.lit(x).cast(t) for k, v in values.items() for x, t in ((k, "string"), (v, "long"))])
    return F.try_element_at(table, ch)


def first_number(text: Column) -> Column:
    """The number a text speaks of, or NULL.

    A run of Arabic digits wins. Otherwise the Chinese numerals are read with their place values (digits times units,
    sections of ten thousand); digits without any unit count only once: the first one is the number.
    """
    numerals = f"([{''.join(DIGITS)}{''.join(UNITS)}])"
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit"))

    def step(state: Column, ch: Column) -> Column:
        total, section, digit = state["total"], state["section"], state["digit"]
        unit, value = _lookup(UNITS, ch), _lookup(DIGITS, ch)
        several = F.greatest(digit, F.lit(1).cast("long"))
        myriad = F.when(section + digit > 0, section + digit).otherwise(1)
        return F.struct(
            F.when(unit == 10000, total + myriad * unit).otherwise(total).alias("total"),
            F.when(unit == 10000, 0).when(unit.isNotNull(), section + several * unit).otherwise(section).alias("section"),
            F.coalesce(value, zero).alias("digit"),
        )

    def spoken(chars: Column) -> Column:
        placed = F.aggregate(chars, start, step, lambda s: s["total"] + s["section"] + s["digit"])
        return (
            F.when(F.size(chars) == 0, F.lit(None).cast("long"))
            .when(text.rlike(f"[{''.join(UNITS)}]"), placed)
            .otherwise(_lookup(DIGITS, F.try_element_at(chars, F.lit(1))))
        )

    chinese = let(F.regexp_extract_all(text, F.lit(numerals), F.lit(1)), spoken)
    return let(
        F.regexp_extract(text, r"(\d+)", 1), lambda a: F.when(a != "", a.try_cast("long")).otherwise(chinese)
    )
