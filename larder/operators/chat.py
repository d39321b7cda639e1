"""Rules over chat messages: intents, avoided terms and budget slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numerals import first_number
from larder.functions.text import strip
from larder.operators.grouping import running_sum

# Message patterns.
ASK_EXACT = r"^我不吃什麼$"
FORGET = r"(忘記|清除|重置)(所有|一切|記憶|忌口)"
ASK = r"(我)?不吃(什麼|啥)|有(哪些|什麼)忌口"
AVOID = r"不吃([A-Za-z0-9一-鿿]+)"
MONEY_TEST = r"(\d+|[一二兩三四五六七八九十萬千]+)\s*(?:元|塊|NT|新台幣)"
MONEY = r"([一二兩三四五六七八九十\d萬千]+)\s*(?:元|塊|NT|新台幣)"
PEOPLE = r"([一二兩三四五六七八九十\d]+)\s*(?:位|個)?人"
PER_PERSON = r"(?:每人|人均|人)\s*([一二兩三四五六七八九十\d]+)"
TOTAL_MODE, PERSON_MODE = "總預算模式", "人均預算模式"
# What a message that leaves a slot open means.
PEOPLE_IN_TOTAL_MODE, PEOPLE_DEFAULT, PER_PERSON_DEFAULT, TOTAL_DEFAULT = 4, 2, 200, 1000


def intents(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``action`` (query, clear, add, none), the routed ``intent`` and the ``avoided`` terms of each message.

    Rules apply in order: the exact question, forgetting, asking, naming something not eaten; anything else is chat.
    """
    msg = strip(F.col(text))
    lower = F.lower(msg)
    terms = F.regexp_extract_all(msg, F.lit(AVOID), F.lit(1))
    action = (
        F.when(msg.rlike(ASK_EXACT), "query")
        .when(lower.rlike(FORGET), "clear")
        .when(lower.rlike(ASK), "query")
        .when(F.size(terms) > 0, "add")
        .otherwise("none")
    )
    return (
        messages.withColumn("action", action)
        .withColumn("intent", F.when(F.col("action") == "add", "RECOMMEND").otherwise("CHAT"))
        .withColumn("avoided", F.when(F.col("action") == "add", F.array_distinct(terms)))
    )


def avoid_memory(messages: DataFrame, conversation: str, turn: str, text: str = "text") -> DataFrame:
    """(conversation, epoch, term, since_turn, is_current): what each conversation asked to avoid.

    Forgetting starts a new epoch; the memory of the last epoch is current. Epochs come from a running count of the
    resets, so no list of terms is carried from turn to turn.
    """
    routed = intents(messages, text)
    resets = F.when(F.col("action") == "clear", 1).otherwise(0)
    counted = running_sum(routed.filter("action in ('clear', 'add')"), [conversation], turn, {"epoch": resets})
    last = routed.filter("action = 'clear'").groupBy(conversation).agg(F.count(F.lit(1)).alias("_last"))
    terms = counted.select(conversation, "epoch", turn, F.explode("avoided").alias("term"))
    kept = terms.groupBy(conversation, "epoch", "term").agg(F.min(turn).alias("since_turn"))
    marked = kept.join(last, conversation, "left")
    current = F.col("epoch") == F.coalesce("_last", F.lit(0))
    return marked.select(conversation, "epoch", "term", "since_turn", current.alias("is_current"))


def _slot(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", first_number(found))


def budget_slots(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add plan mode, people, budget per person and total budget.

    A sum of money without a per-person amount is a total for four; otherwise the slots are people (default 2) and
    budget per person (default 200).
    """
    msg = strip(F.col(text))
    by_total = msg.rlike(MONEY_TEST) & ~msg.rlike(PER_PERSON)
    total = F.coalesce(_slot(msg, MONEY), F.lit(TOTAL_DEFAULT))
    people = F.when(by_total, PEOPLE_IN_TOTAL_MODE).otherwise(F.coalesce(_slot(msg, PEOPLE), F.lit(PEOPLE_DEFAULT)))
    each = F.coalesce(_slot(msg, PER_PERSON), F.lit(PER_PERSON_DEFAULT))
    return (
        messages.withColumns({"people": people.cast("long"), "_total": total, "_each": each, "_by_total": by_total})
        .withColumns(
            {
                "plan_mode": F.when(F.col("_by_total"), TOTAL_MODE).otherwise(PERSON_MODE),
                "per_person": F.when(F.col("_by_total"), F.floor(F.col("_total") / PEOPLE_IN_TOTAL_MODE)).otherwise(F.col("_each")),
                "total_budget": F.when(F.col("_by_total"), F.col("_total")).otherwise(F.col("people") * F.col("_each")),
            }
        )
        .drop("_total", "_each", "_by_total")
    )
