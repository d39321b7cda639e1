"""Parsers for raw landed strings; whatever cannot be read becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let, strip

# Spreadsheet day zero, and the largest serial day accepted.
SERIAL_DAY_ZERO = "1899-12-30"
SERIAL_DAY_MAX = 60000
WRITTEN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$"

# Characters that count as digits inside a label. Decimal digits of any script, super- and subscripts
# and circled digits do; vulgar fractions and numerals such as U+5341 do not.
DIGIT = r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]"
DEFAULT_LABEL = "single"
SET_WORDS = ["桌菜", "套餐"]


def _dashed(s: Column) -> Column:
    """Written dates (2023/1/5, 2023.1.5, 1/5/2023, with or without a time) with the date part as y-m-d."""
    s = F.regexp_replace(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    return let(s, lambda d: F.when(d.rlike(WRITTEN), d))


def landed_date(c: Column) -> Column:
    """yyyymmdd, a spreadsheet serial day, or a written date (a time part is dropped).

    Shapes are tested by pattern before any cast: a failing format parse costs an exception per row.
    """

    def read(s: Column) -> Column:
        number = F.when(s.rlike(r"^[+-]?[0-9.]+([eE][+-]?\d+)?$"), s.try_cast("double"))
        serial = (number == F.floor(number)) & number.between(1, SERIAL_DAY_MAX)
        return (
            F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s.try_cast("date"))
            .when(s.rlike(r"^\d{8}$"), F.regexp_replace(s, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3").try_cast("date"))
            .when(serial, F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), number.cast("int")))
            .otherwise(_dashed(s).try_cast("date"))
        )

    return let(strip(c.cast("string")), read)


def landed_timestamp(c: Column) -> Column:
    """A written date or date and time."""
    return _dashed(strip(c.cast("string"))).try_cast("timestamp")


def messy_price(c: Column) -> Column:
    """Price text with separators and currency signs to DECIMAL(12,2), half up."""
    s = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.round(s.try_cast("decimal(38,10)"), 2).try_cast("decimal(12,2)")


def menu_price(c: Column) -> Column:
    """Menu file price: blank and the word NULL mean no price."""
    s = strip(c)
    return F.when(~F.upper(s).isin("", "NULL"), s.try_cast("double"))


def number(c: Column) -> Column:
    return c.try_cast("double")


def split_name(c: Column) -> tuple[Column, Column]:
    """``name(label)`` to (base name, price label).

    The last bracket only splits when both parts are non-empty and the label holds no digit; a blank name has no base.
    """
    s = strip(c)
    pattern = r"^(.*)\(([^)]+)\)$"
    base, label = strip(F.regexp_extract(s, pattern, 1)), strip(F.regexp_extract(s, pattern, 2))
    splits = (base != "") & (label != "") & ~label.rlike(DIGIT)
    return (
        F.when(splits, base).when(s != "", s),
        F.when(splits, label).otherwise(F.lit(DEFAULT_LABEL)),
    )


def display_name(base: Column, label: Column) -> Column:
    return F.when(label == DEFAULT_LABEL, base).otherwise(F.concat(base, F.lit("("), label, F.lit(")")))


def category_name(c: Column) -> Column:
    """Drop a leading ``[...]`` marker unless nothing would be left."""
    cleaned = strip(F.regexp_replace(c, r"^\[.*?\]", ""))
    return F.when(cleaned != "", cleaned).otherwise(c)


def is_set_name(c: Column) -> Column:
    """Set menus are recognised by their name."""
    return c.contains(SET_WORDS[0]) | c.contains(SET_WORDS[1])
