"""Recommendation joins: candidates to dishes, prices and forecasts, and the menu without avoided dishes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.context import materialize
from larder.functions.text import contains_any
from larder.operators.grouping import first_per_key, top_per_key

HORIZON_DAYS = 6
TOP = 3
MENU_LINE_DISHES = 10
#: Fixed value: the text for a request without candidates.
NO_FORECASTS = "（無可用預測資料）"
DEFAULT_REASON = "精選推薦"
# Menu sections that are never shown.
BLOCKED_SECTIONS = ["2025年菜", "2025年菜桌菜附餐"]


def dish_cards(dishes: DataFrame, prices: DataFrame) -> DataFrame:
    """One card per dish name: the dish with the smallest id, its first price (NULL and 0 become 0.0) and image path."""
    one = dishes.groupBy("name").agg(F.min("dish_id").alias("dish_id"))
    first = first_per_key(prices, ["dish_id"], [F.col("price_id").asc_nulls_last()])
    return one.join(first, "dish_id", "left").select(
        "name",
        "dish_id",
        "price_id",
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        F.col("price_label").alias("size"),
        image_path(F.col("dish_id")).alias("image_url"),
    )


def image_path(dish_id: Column) -> Column:
    return F.concat(F.lit("/images/dish/"), dish_id.cast("string"), F.lit(".webp"))


def enrich(candidates: DataFrame, cards: DataFrame, default_reason: str = DEFAULT_REASON) -> DataFrame:
    """Candidates (request, position, name, reason) with their card; unknown names are dropped, positions are kept."""
    known = candidates.join(cards, "name")
    return known.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit(default_reason)))


def forecast_coverage(serving: DataFrame) -> DataFrame:
    """One row with the first and last served day; NULLs when nothing is served."""
    return serving.agg(F.min("target_date").alias("min_target_date"), F.max("target_date").alias("max_target_date"))


def price_series(serving: DataFrame, start: dt.date, days: int = HORIZON_DAYS) -> DataFrame:
    """Per price id the served days in [start, start + days): ordered series, mean, and the earliest peak day.

    A price has at most one row per day, so a series is never longer than ``days``.
    """
    end = start + dt.timedelta(days=days - 1)
    wanted = serving.filter(F.col("target_date").between(F.lit(start), F.lit(end)))
    day = F.struct("target_date", "yhat", "model_version", "forecast_origin_date")
    peak = F.struct(F.col("yhat").cast("double").alias("y"), (-F.unix_date("target_date")).alias("earlier"))
    return wanted.groupBy("price_id").agg(
        F.array_sort(F.collect_list(day)).alias("forecast"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.col("yhat").cast("double")).alias("avg_yhat"),
        F.max_by("target_date", peak).alias("peak_date"),
        F.max(F.col("yhat").cast("double")).alias("peak_yhat"),
    )


def attach_forecast(candidates: DataFrame, serving: DataFrame, start: dt.date, days: int = HORIZON_DAYS) -> DataFrame:
    """Add the forecast of each candidate's price and its status.

    ``ok``: days of the window are served. ``stale``: the window starts after everything served, but the price was
    served once. ``missing``: anything else. (Days after the last served one do not exist, so the end needs no clamp.)
    """
    last = forecast_coverage(serving).select("max_target_date").scalar()
    known = serving.select("price_id").distinct().withColumn("_known", F.lit(True))
    joined = candidates.join(price_series(serving, start, days), "price_id", "left").join(known, "price_id", "left")
    status = (
        F.when(F.col("n_days").isNotNull(), "ok")
        .when((F.lit(start) > last) & F.col("_known"), "stale")
        .otherwise("missing")
    )
    return joined.withColumn("forecast_status", status).drop("_known")


def summary_line(df: DataFrame) -> DataFrame:
    """Add the demand sentence of each candidate (one decimal, halves to even)."""

    def one(c: Column) -> Column:
        return F.format_string("%.1f", F.bround(c, 1))

    ok = F.concat(
        F.lit("- "), "name", F.lit("：預測近"), "n_days", F.lit("日平均需求 "), one(F.col("avg_yhat")), F.lit("，高峰日 "),
        "peak_date", F.lit(" 需求 "), one(F.col("peak_yhat")),
    )
    stale = F.concat(F.lit("- "), "name", F.lit("：預測資料過時，請參考菜單實際情況"))
    missing = F.concat(F.lit("- "), "name", F.lit("：無預測資料"))
    status = F.col("forecast_status")
    return df.withColumn("summary", F.when(status == "ok", ok).when(status == "stale", stale).otherwise(missing))


def summary_text(requests: DataFrame, lines: DataFrame, request: str = "request_id") -> DataFrame:
    """``request, summary``: the sentences (request, position, summary) of each request as one text, or the sentence that there is none.

    A request has as many sentences as candidates, a short list.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "summary")))
    texts = lines.groupBy(request).agg(F.array_join(F.transform(ordered, lambda x: x["summary"]), "\n").alias("summary"))
    return requests.select(request).distinct().join(texts, request, "left").withColumn("summary", F.coalesce("summary", F.lit(NO_FORECASTS)))


def demand_top(candidates: DataFrame, request: str = "request_id", k: int = TOP) -> DataFrame:
    """Per request the k candidates with the highest mean forecast; without one the original order decides."""
    order = [F.col("avg_yhat").desc_nulls_last(), F.col("position").asc()]
    return top_per_key(candidates, [request], order, k)


#: Terms in one automaton.
TERM_ROWS = 100_000


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, the terms of a cell before its names: (name, term) of each term inside a name."""
    import ahocorasick

    cell, automaton = None, None
    for batch in batches:
        found_name, found_term = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "is_term", "text")), strict=True)
        for here, is_term, text in rows:
            if here != cell:
                cell, automaton = here, ahocorasick.Automaton()
            if is_term:
                automaton.add_word(text, text)
                continue
            if automaton.kind == ahocorasick.TRIE:
                automaton.make_automaton()
            if automaton.kind == ahocorasick.AHOCORASICK:  # else the cell has no terms
                terms = {term for _, term in automaton.iter(text)}
                found_name += [text] * len(terms)
                found_term += terms
        yield pa.RecordBatch.from_arrays([pa.array(found_name, pa.string()), pa.array(found_term, pa.string())], names=["name", "term"])


def blocked_names(names: DataFrame, terms: DataFrame, name: str = "name", term: str = "term") -> DataFrame:
    """(name, term) pairs where the name contains the term.

    Each task builds one automaton (Aho-Corasick) over a block of at most about ``TERM_ROWS`` terms and reads its names once, however
    many terms there are and however long. Names are sent once per block of terms, terms once per group of names; nothing passes the
    driver and only matches are rows. Empty terms match nothing.
    """
    spark = names.sparkSession
    wanted = materialize(terms.select(F.col(term).alias("text")).filter("text <> ''").distinct(), "terms")
    blocks = max(1, -(-wanted.count() // TERM_ROWS))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    sent = wanted.select(place(blocks).alias("b"), every(groups).alias("g"), F.lit(True).alias("is_term"), "text")
    read = names.select(F.col(name).alias("text")).filter("text IS NOT NULL").distinct()
    cells = sent.unionByName(read.select(every(blocks).alias("b"), place(groups).alias("g"), F.lit(False).alias("is_term"), "text"))
    cells = cells.withColumn("cell", F.col("b") * groups + F.col("g")).repartition(blocks * groups, "cell")
    return cells.sortWithinPartitions("cell", F.desc("is_term")).select("cell", "is_term", "text").mapInArrow(_matches, "name string, term string")


def term_sets(memory: DataFrame, conversation: str) -> tuple[DataFrame, DataFrame]:
    """(term_set, term) of every distinct set of avoided terms, and (conversation, term_set)."""
    people = memory.groupBy(conversation).agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    people = people.withColumn("term_set", F.sha2(F.to_json(F.col("_terms")), 256))
    sets = people.groupBy("term_set").agg(F.first("_terms").alias("_terms")).select("term_set", F.explode("_terms").alias("term"))
    return sets, people.select(conversation, "term_set")


def blocked_by_set(menu: DataFrame, sets: DataFrame) -> DataFrame:
    """(term_set, name): the dish names that hold a term of the set."""
    return blocked_names(menu, sets).join(sets, "term").select("term_set", "name").distinct()


def menu_blocked(menu: DataFrame, memory: DataFrame, conversation: str) -> tuple[DataFrame, DataFrame]:
    """What each conversation must not be shown: (conversation, term_set) and the blocked dishes (term_set, dish_id, name).

    Conversations that avoid the same terms share the dishes of their set.
    """
    sets, people = term_sets(memory, conversation)
    return people, blocked_by_set(menu, sets).join(menu.select("name", "dish_id"), "name").select("term_set", "dish_id", "name")


def without_avoided(menu: DataFrame, terms: DataFrame) -> DataFrame:
    """Menu rows whose name holds none of the avoided terms."""
    return menu.join(blocked_names(menu, terms).select("name"), "name", "left_anti")


def visible_sections(menu: DataFrame, title: str, blocked: list[str]) -> DataFrame:
    return menu.filter(~F.coalesce(contains_any(F.col(title), blocked), F.lit(False)))


def category_lines(menu: DataFrame, k: int = MENU_LINE_DISHES) -> DataFrame:
    """Per category the names of its first k dishes as one line of text."""
    top = top_per_key(menu, ["category_id"], [F.col("sort_order"), F.col("dish_id")], k)
    parts = F.array_sort(F.collect_list(F.struct("sort_order", "dish_id", "name")))
    return top.groupBy("category_id").agg(F.array_join(F.transform(parts, lambda p: p["name"]), "、").alias("line"))


def menu_left(menu: DataFrame, memory: DataFrame, conversation: str) -> DataFrame:
    """How much of the menu each conversation's avoided terms leave.

    One row per conversation: dishes on the menu, dishes blocked, dishes left, and whether nothing is left. Conversations
    that avoid the same terms share one count, so dishes meet distinct term sets, not conversations.
    """
    sets, people = term_sets(memory, conversation)
    per_name = menu.groupBy("name").agg(F.count(F.lit(1)).alias("n_named"))
    blocked = blocked_by_set(menu, sets).join(per_name, "name")
    lost = blocked.groupBy("term_set").agg(F.sum("n_named").alias("n_blocked"))
    size = menu.agg(F.count(F.lit(1)).alias("n")).scalar()
    people = people.join(lost, "term_set", "left")
    counted = people.select(
        conversation, size.alias("n_menu"), F.coalesce("n_blocked", F.lit(0).cast(T.LongType())).alias("n_blocked")
    )
    return counted.withColumn("n_left", F.col("n_menu") - F.col("n_blocked")).withColumn("is_empty", F.col("n_left") == 0)
