"""Chat rule and recommendation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import materialize, table
from larder.functions.numerals import first_number
from larder.operators import chat
from larder.operators import recommend as rec
from larder.queries import bindings as b
from larder.queries import menus, ordering
from larder.queries.registry import query

# --- chat messages: the user turns of all conversations, most with a request attached ----------------------------------

WORDS = "array('red', 'gear', 'hot', 'widget', 'bolt', 'blue', 'zzz')"
WORD_LIST = "['red', 'gear', 'hot', 'widget', 'bolt', 'blue', 'zzz']"
MESSAGE = """CASE n % 14 WHEN 0 THEN concat(text, ' 我不吃', w1) WHEN 1 THEN concat('不吃', w1, '，也不吃', w2) WHEN 2 THEN '我不吃什麼'
  WHEN 3 THEN concat('請忘記所有 ', text) WHEN 4 THEN concat(text, ' 有哪些忌口') WHEN 5 THEN concat(' 不吃', w2, ' ')
  WHEN 6 THEN concat('預算', 300 + n, '元 ', text) WHEN 7 THEN concat(text, '每人', 100 + n, '元，', 2 + n % 7, '個人')
  WHEN 8 THEN '兩千元' WHEN 9 THEN concat('三萬五千 塊 ', text) WHEN 10 THEN '四位人均三十' WHEN 11 THEN concat(n % 50, '人來吃飯')
  WHEN 12 THEN text ELSE concat(text, ' 我不吃', w2, w1) END"""

b.CTE["msg"] = (
    [],
    f"""SELECT conv_id, turn, {MESSAGE} AS text, n FROM (
  SELECT conv_id, turn, text, conv_id * 3 + turn AS n, {WORD_LIST}[1 + (conv_id + turn) % 7] AS w1,
    {WORD_LIST}[1 + (conv_id * 5 + turn) % 7] AS w2 FROM conversations WHERE role = 'user')""",
)
b.CTE["routed"] = (
    ["msg"],
    """SELECT *, CASE WHEN trim(text) = '我不吃什麼' THEN 'query' WHEN regexp_matches(text, '(忘記|清除|重置)(所有|一切|記憶|忌口)') THEN 'clear'
  WHEN regexp_matches(text, '不吃(什麼|啥)|有(哪些|什麼)忌口') THEN 'query' WHEN regexp_matches(text, '不吃[A-Za-z0-9一-鿿]') THEN 'add'
  ELSE 'none' END AS action FROM msg""",
)
b.CTE["memory"] = (
    ["routed"],
    """SELECT conv_id, epoch, term, min(turn) AS since_turn, epoch = any_value(last_epoch) AS is_current FROM (
  SELECT conv_id, turn, epoch, last_epoch, action, unnest(regexp_extract_all(text, '不吃([A-Za-z0-9一-鿿]+)', 1)) AS term FROM (
    SELECT *, count(*) FILTER (WHERE action = 'clear') OVER (PARTITION BY conv_id ORDER BY turn) AS epoch,
      count(*) FILTER (WHERE action = 'clear') OVER (PARTITION BY conv_id) AS last_epoch FROM routed) WHERE action = 'add')
GROUP BY conv_id, epoch, term""",
)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    numbered = turns.selectExpr(
        "conv_id", "turn", "text", "conv_id * 3 + turn AS n", f"{WORDS}[(conv_id + turn) % 7] AS w1", f"{WORDS}[(conv_id * 5 + turn) % 7] AS w2"
    )
    return numbered.selectExpr("conv_id", "turn", f"{MESSAGE} AS text", "n")


@query(
    b.with_(
        ["routed"],
        """SELECT conv_id, turn, action, CASE action WHEN 'add' THEN 'RECOMMEND' ELSE 'CHAT' END AS intent,
  CASE action WHEN 'add' THEN list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '不吃([A-Za-z0-9一-鿿]+)', 1))), 'string_agg', ',') END
    AS avoided FROM routed""",
    )
)
def intent_rules(spark: SparkSession, folder: str) -> DataFrame:
    routed = chat.intents(messages(spark, folder))
    return routed.select("conv_id", "turn", "action", "intent", F.array_join(F.array_sort("avoided"), ",").alias("avoided"))


@query(b.with_(["memory"], "SELECT * FROM memory"))
def avoid_memory(spark: SparkSession, folder: str) -> DataFrame:
    return chat.avoid_memory(messages(spark, folder), "conv_id", "turn")


@query(
    b.with_(
        ["msg"],
        """SELECT conv_id, turn, CASE WHEN k IN (6, 8, 9) THEN '總預算模式' ELSE '人均預算模式' END AS plan_mode,
  CASE WHEN k IN (6, 8, 9) THEN 4 WHEN k = 7 THEN 2 + n % 7 WHEN k = 10 THEN 4 WHEN k = 11 THEN n % 50 ELSE 2 END AS people,
  CASE k WHEN 6 THEN (300 + n) // 4 WHEN 8 THEN 500 WHEN 9 THEN 8750 WHEN 7 THEN 100 + n WHEN 10 THEN 30 ELSE 200 END AS per_person,
  CASE k WHEN 6 THEN 300 + n WHEN 8 THEN 2000 WHEN 9 THEN 35000 WHEN 7 THEN (2 + n % 7) * (100 + n) WHEN 10 THEN 120
    WHEN 11 THEN (n % 50) * 200 ELSE 400 END AS total_budget
FROM (SELECT *, n % 14 AS k FROM msg)""",
    )
)
def budget_slots(spark: SparkSession, folder: str) -> DataFrame:
    return chat.budget_slots(messages(spark, folder)).drop("text", "n")


NUMBER_TEXT = """CASE WHEN n % 3 = 0 THEN concat('預算', n, '元或', n + 1) WHEN n % 3 = 1 AND n > 1 THEN concat('我要',
    IF(d5 > 0, concat(DIGIT(d5), '萬'), ''), IF(d4 > 0, concat(DIGIT(d4), '千'), ''), IF(d3 > 0, concat(DIGIT(d3), '百'), ''),
    IF(d2 > 0, concat(DIGIT(d2), '十'), ''), IF(d1 > 0, DIGIT(d1), ''), '份') ELSE '來一些湯' END"""


@query(
    """SELECT o_orderkey, CASE WHEN n % 3 = 0 OR n % 3 = 1 AND n > 1 THEN n ELSE 1 END AS number
FROM (SELECT o_orderkey, o_orderkey * 7919 % 100000 AS n FROM orders)"""
)
def number_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers up to 99,999 written out in Arabic or Chinese inside a sentence; the SQL side knows what was written."""
    import re

    digits = "element_at(array('一','二','三','四','五','六','七','八','九'), CAST({} AS INT))"
    text = re.sub(r"DIGIT\((\w+)\)", lambda m: digits.format(m.group(1)), NUMBER_TEXT)
    orders = table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderkey * 7919 % 100000 AS n")
    cut = orders.selectExpr(
        "o_orderkey", "n", "n div 10000 AS d5", "n div 1000 % 10 AS d4", "n div 100 % 10 AS d3", "n div 10 % 10 AS d2", "n % 10 AS d1"
    )
    return cut.select("o_orderkey", F.expr(text).alias("text")).select("o_orderkey", first_number(F.col("text")).alias("number"))


# --- recommendations: an order asks, its lines are the candidates --------------------------------------------------------

START, STALE_START = dt.date(2001, 6, 6), dt.date(2001, 7, 1)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    lines = ordering.order_items(spark, folder).select("order_id", "line_no", "dish_id")
    part = table(spark, folder, "part").selectExpr("p_partkey AS dish_id", "p_name")
    return lines.join(part, "dish_id").selectExpr(
        "order_id AS request_id", "line_no AS position", "IF(dish_id % 11 = 0, concat('no ', p_name), p_name) AS name",
        "CASE line_no % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'tasty' END AS reason",
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Dishes are the distinct names, every part of a name is a price of it."""
    part = table(spark, folder, "part").selectExpr(
        "p_name AS basename", "p_partkey AS price_id", "p_type AS price_label", "IF(p_size % 10 = 0, NULL, CAST(p_retailprice AS DECIMAL(12,2))) AS price"
    )
    names = b.dishes(spark, folder).selectExpr("canonical_dish_id AS dish_id", "basename AS name")
    prices = part.join(names, F.col("basename") == F.col("name")).select("dish_id", "price_id", "price_label", "price")
    return rec.dish_cards(names, prices)


b.CTE["card"] = (
    [],
    """SELECT p_name AS name, p_partkey AS dish_id, p_partkey AS price_id,
  CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice END AS price, p_type AS size, '/images/dish/' || p_partkey || '.webp' AS image_url
FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""",
)
b.CTE["cand"] = (
    ["oitem", "card"],
    """SELECT order_id AS request_id, line_no AS position, c.*,
  CASE WHEN line_no % 3 = 2 THEN 'tasty' ELSE '精選推薦' END AS reason
FROM oitem JOIN part ON p_partkey = oitem.dish_id AND p_partkey % 11 <> 0 JOIN card c ON c.name = p_name""",
)
b.CTE["series"] = (
    ["serving"],
    f"""SELECT price_id, count(*) AS n_days, avg(yhat) AS avg_yhat, CAST(max(yhat) AS DOUBLE) AS peak_yhat,
  CAST(arg_min(target_date, (-yhat, target_date)) AS VARCHAR) AS peak_date,
  string_agg(CAST(target_date AS VARCHAR) || '=' || CAST(yhat AS INTEGER), '|' ORDER BY target_date) AS forecast
FROM serving WHERE target_date BETWEEN DATE '{START}' AND DATE '{START}' + 5 GROUP BY 1""",
)


@query(
    b.with_(["cand"], "SELECT request_id, CAST(position AS BIGINT) AS position, name, reason, dish_id, price_id, price, size, image_url FROM cand")
)
def enriched_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return rec.enrich(candidates(spark, folder), cards(spark, folder))


def attached(spark: SparkSession, folder: str, start: dt.date = START) -> DataFrame:
    known = rec.enrich(candidates(spark, folder), cards(spark, folder))
    return rec.attach_forecast(known, materialize(b.serving(spark, folder), "serving"), start)


@query(
    b.with_(
        ["cand", "series", "serving"],
        f"""SELECT request_id, CAST(position AS BIGINT) AS position, name, price_id, '{START}' AS start_date,
  CASE WHEN s.price_id IS NULL THEN 'missing' ELSE 'ok' END AS forecast_status, forecast
FROM cand LEFT JOIN series s USING (price_id)
UNION ALL SELECT request_id, position, name, price_id, '{STALE_START}',
  CASE WHEN price_id IN (SELECT price_id FROM serving) THEN 'stale' ELSE 'missing' END, NULL FROM cand""",
    )
)
def attach_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with their served days from one start inside the coverage and one behind it."""
    serving = materialize(b.serving(spark, folder), "serving")
    known = rec.enrich(candidates(spark, folder), cards(spark, folder))
    out = None
    for start in (START, STALE_START):
        rows = rec.attach_forecast(known, serving, start)
        day = F.transform("forecast", lambda d: F.concat(d["target_date"].cast("string"), F.lit("="), d["yhat"].cast("int").cast("string")))
        rows = rows.select(
            "request_id", "position", "name", "price_id", F.lit(start).alias("start_date"), "forecast_status",
            F.nullif(F.array_join(day, "|"), F.lit("")).alias("forecast"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    b.with_(
        ["cand", "series"],
        """SELECT request_id, CAST(position AS BIGINT) AS position, '- ' || name || CASE WHEN s.price_id IS NULL THEN '：無預測資料' ELSE
  '：預測近' || n_days || '日平均需求 ' || printf('%.1f', avg_yhat) || '，高峰日 ' || peak_date || ' 需求 ' || printf('%.1f', peak_yhat) END AS summary
FROM cand LEFT JOIN series s USING (price_id)""",
    )
)
def demand_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rec.summary_line(attached(spark, folder)).select("request_id", "position", "summary")


@query(
    b.with_(
        ["cand", "series"],
        """SELECT o_orderkey AS request_id, coalesce(summary, '（無可用預測資料）') AS summary FROM orders LEFT JOIN (
  SELECT request_id, string_agg('- ' || name || CASE WHEN s.price_id IS NULL THEN '：無預測資料' ELSE
    '：預測近' || n_days || '日平均需求 ' || printf('%.1f', avg_yhat) || '，高峰日 ' || peak_date || ' 需求 ' || printf('%.1f', peak_yhat) END, chr(10)
    ORDER BY position, name) AS summary
  FROM cand LEFT JOIN series s USING (price_id) GROUP BY 1) ON request_id = o_orderkey""",
    )
)
def demand_text(spark: SparkSession, folder: str) -> DataFrame:
    """The demand sentences of every request as one text; requests without a known dish get the sentence that there is none."""
    requests = table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"))
    return rec.summary_text(requests, rec.summary_line(attached(spark, folder)))


@query(
    b.with_(
        ["cand", "series"],
        """SELECT request_id, CAST(position AS BIGINT) AS position, name, price, round(avg_yhat, 6) AS avg_yhat FROM cand LEFT JOIN series USING (price_id)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY avg_yhat DESC NULLS LAST, position) <= 3""",
    )
)
def demand_top3(spark: SparkSession, folder: str) -> DataFrame:
    best = rec.demand_top(attached(spark, folder))
    return best.select("request_id", "position", "name", "price", F.round("avg_yhat", 6).alias("avg_yhat"))


# --- menus for diners ------------------------------------------------------------------------------------------------


@query(
    b.with_(
        ["mdish", "memory"],
        """SELECT terms, d.dish_id, d.name FROM (SELECT DISTINCT terms FROM people) s, UNNEST(s.terms) AS u(term) JOIN mdish d ON contains(d.name, term)
GROUP BY ALL""".replace("SELECT terms, d", "SELECT array_to_string(terms, ',') AS avoided, d", 1),
        people="SELECT conv_id, list(DISTINCT term ORDER BY term) AS terms FROM memory WHERE is_current GROUP BY 1",
    )
)
def menu_avoid(spark: SparkSession, folder: str) -> DataFrame:
    """For every set of terms that some conversation avoids, the dishes it must not be shown."""
    menu = menus.dishes(spark, folder).select("category_id", "dish_id", "name")
    memory = chat.avoid_memory(messages(spark, folder), "conv_id", "turn").filter("is_current").select("conv_id", "term")
    memory = materialize(memory, "memory")
    sets, _ = rec.term_sets(memory, "conv_id")
    spelled = sets.groupBy("term_set").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("avoided"))
    _, blocked = rec.menu_blocked(menu, memory, "conv_id")
    return blocked.join(spelled, "term_set").select("avoided", "dish_id", "name")


@query(
    b.with_(
        ["mdish"],
        """SELECT category_id, string_agg(name, '、' ORDER BY sort_order, dish_id) AS line FROM (
  SELECT * FROM mdish QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY sort_order, dish_id) <= 10) GROUP BY 1""",
    )
)
def category_top10(spark: SparkSession, folder: str) -> DataFrame:
    return rec.category_lines(menus.dishes(spark, folder))


@query(
    b.with_(
        ["mdish", "memory", "category"],
        """SELECT m.conv_id, (SELECT count(*) FROM shown) AS n_menu,
  count(dish_id) AS n_blocked, (SELECT count(*) FROM shown) - count(dish_id) AS n_left,
  (SELECT count(*) FROM shown) = count(dish_id) AS is_empty
FROM (SELECT DISTINCT conv_id FROM memory WHERE is_current) m LEFT JOIN (
  SELECT DISTINCT conv_id, dish_id FROM memory JOIN shown ON contains(name, term) WHERE is_current) h USING (conv_id) GROUP BY 1""",
        shown="""SELECT d.* FROM mdish d JOIN category USING (category_id)
WHERE NOT contains(category_name, '#1') AND NOT contains(category_name, '#25')""",
    )
)
def menu_for_diner(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the shown menu sections for every conversation that avoids something."""
    titled = menus.dishes(spark, folder).join(menus.categories(spark, folder).select("category_id", "category_name"), "category_id")
    shown = rec.visible_sections(titled, "category_name", ["#1", "#25"])
    memory = chat.avoid_memory(messages(spark, folder), "conv_id", "turn").filter("is_current")
    memory = materialize(memory.select("conv_id", "term"), "memory")
    return rec.menu_left(shown, memory, "conv_id")
