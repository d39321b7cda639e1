"""Golden cells of the column expressions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.functions import dates, html, money, numerals, parsing, text


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_landed_dates(spark):
    cells = {
        "20230101": dt.date(2023, 1, 1), "45213": dt.date(2023, 10, 14), "45213.0": dt.date(2023, 10, 14),
        "2023/01/01": dt.date(2023, 1, 1), "2023-1-5": dt.date(2023, 1, 5), "2023/1/5 10:20": dt.date(2023, 1, 5),
        "2023-01-05T10:20:30": dt.date(2023, 1, 5), "1/5/2023": dt.date(2023, 1, 5), "x": None, "20231399": None, "60001": None,
        "2023-02-30": None, "2023-01-01 later": None, "": None, " 20230101　": dt.date(2023, 1, 1), None: None, "12.5": None,
    }
    assert values(spark, list(cells), "s string", parsing.landed_date(F.col("s"))) == list(cells.values())


def test_landed_timestamps(spark):
    cells = {"2023/1/5 10:20:30": dt.datetime(2023, 1, 5, 10, 20, 30), " ": None, "2023-01-05": dt.datetime(2023, 1, 5), "no": None}
    assert values(spark, list(cells), "s string", parsing.landed_timestamp(F.col("s"))) == list(cells.values())


def test_messy_prices(spark):
    cells = {
        "1,200": "1200.00", "$1200": "1200.00", " 1200 ": "1200.00", "": None, "-": None, ".": None, "-.": None, "1-2": None,
        "10.005": "10.01", "-3.5": "-3.50", None: None,
    }
    want = [None if v is None else Decimal(v) for v in cells.values()]
    assert values(spark, list(cells), "s string", parsing.messy_price(F.col("s"))) == want


def test_menu_prices(spark):
    assert values(spark, ["NULL", "null ", "", "280", "1e2", "x", None], "s string", parsing.menu_price(F.col("s"))) == [
        None, None, None, 280.0, 100.0, None, None,
    ]


def test_names_split_only_on_plain_labels(spark):
    cells = {
        "A(大)": ("A", "大"), "A(12)": ("A(12)", "single"), "A": ("A", "single"), "(大)": ("(大)", "single"),
        "A(３)": ("A(３)", "single"), "A(²)": ("A(²)", "single"), "A(½)": ("A", "½"), "A(十)": ("A", "十"), " ": (None, "single"),
        None: (None, "single"), "A (大) ": ("A", "大"), "A(a)(b)": ("A(a)", "b"),
    }
    base, label = parsing.split_name(F.col("s"))
    assert values(spark, list(cells), "s string", F.struct(base, label)) == list(cells.values())
    shown = values(spark, ["A(大)", "A"], "s string", parsing.display_name(*parsing.split_name(F.col("s"))))
    assert shown == ["A(大)", "A"]


def test_category_and_set_names(spark):
    assert values(spark, ["[1] 湯", "[1]", "湯"], "s string", parsing.category_name(F.col("s"))) == ["湯", "[1]", "湯"]
    assert values(spark, ["桌菜A", "雙人套餐", "湯"], "s string", parsing.is_set_name(F.col("s"))) == [True, True, False]


@pytest.mark.parametrize(
    "price, quantity, total",
    [
        ("10.001", 1, "10.00"), ("10.005", 1, "10.01"), ("10.004", 1, "10.00"), ("10.006", 1, "10.01"), ("33.333", 3, "99.99"),
        ("0.01", 100, "1.00"), ("99.999", 2, "200.00"), ("7.777", 7, "54.46"),
    ],
)
def test_line_totals_round_each_price_half_up(spark, price, quantity, total):
    got = values(spark, [(float(price), quantity)], "p double, q long", money.line_total(F.col("p"), F.col("q")))
    assert got == [Decimal(total)]


def test_forecasts_round_half_to_even_and_never_negative(spark):
    assert values(spark, [0.5, 1.5, 2.5, -3.0, 2.6], "y double", money.whole_units(F.col("y"))) == [0, 2, 2, 0, 3]


def test_numbers_in_text(spark):
    cells = {
        "3": 3, "十": 10, "我要3份": 3, "來五碗湯": 5, "3個和5個": 3, "一二三": 1, "一百": 100, "零": 0, "沒有數字": None, "": None,
        "兩萬五": 20005, "十萬": 100000, "三十二": 32, "一千零五": 1005, "二十萬三千": 203000, "0": 0, None: None,
    }
    got = values(spark, list(cells), "s string", numerals.first_number(F.col("s")))
    assert got == list(cells.values())


def test_tags(spark):
    rows = [([" a", "b", None, "", "a "],), ([],), (None,)]
    assert values(spark, rows, "t array<string>", text.join_tags(F.col("t"))) == ["a, b", "", None]
    allowed = F.array(F.lit("a"), F.lit("c"))
    assert values(spark, [(["a", "b", "a"],)], "t array<string>", text.allowed_only(F.col("t"), allowed)) == [["a", "a"]]


def test_keyword_match(spark):
    match = text.keyword_match([F.col("a"), F.col("b")], " HOT ")
    assert values(spark, [("red", "hotpot"), ("red", None), (None, "Hot")], "a string, b string", match) == [True, False, True]
    assert values(spark, [("x", "y")], "a string, b string", text.keyword_match([F.col("a")], " ")) == [True]


def test_calendar_helpers(spark):
    origin = dt.date(2024, 12, 30)
    got = values(spark, [(origin,)], "d date", dates.horizon_dates(F.col("d")))
    assert got == [[origin + dt.timedelta(days=i) for i in range(1, 7)]]
    assert values(spark, [(dt.date(2024, 12, 31),), (dt.date(2025, 1, 5),)], "d date", dates.horizon_index(F.col("d"), F.lit(origin))) == [0, 5]
    assert dates.monday_on_or_before(dt.date(2025, 1, 5)) == origin
    with pytest.raises(ValueError):
        dates.require_monday(dt.date(2025, 1, 5))


def test_html_to_text(spark):
    pages = {
        "<p>a<script>x</p></script>b</p>": "a b",
        "<nav>1<nav>2</nav>3</nav>a": "a",
        "<aside><p>x</aside>y<aside>never closed": "y",
        "a &amp;lt; b&copy;&#8217;&#x41;&unknown; c": "a &lt; b©’A&unknown; c",
        "<!-- <p>no</p> -->1 < 2 <b>x</b>": "1 < 2 x",
        "a　\n\t b": "a b",
    }
    assert values(spark, list(pages), "h string", html.html_to_text(F.col("h"))) == list(pages.values())
    assert values(spark, ["<p>abcdef"], "h string", html.html_to_text(F.col("h"), 3)) == ["abc"]


def test_keyword_segments(spark):
    body = "a" * 300 + "KEY" + "b" * 400 + "key."
    want = body[120:623] + "\n...\n" + body[523:]
    assert values(spark, [body, "none" * 300, None], "t string", html.keyword_segments(F.col("t"), ["key", "k."])) == [
        want, "none" * 300, None,
    ]
    assert values(spark, ["abc"], "t string", html.keyword_segments(F.col("t"), [])) == ["abc"]
