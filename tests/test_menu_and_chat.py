"""Menu nesting, chat rules, recommendations, documents and vectors."""

import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from larder.operators import chat, documents, menu, recommend, vectors


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def menu_frames(spark):
    categories = spark.createDataFrame([(1, "soup", 2), (2, "fish", None), (3, "empty", 1)], "category_id long, category_name string, sort_order int")
    dishes = spark.createDataFrame(
        [(1, 11, "a", False, 1), (1, 12, "b", True, 0), (2, 21, "c", False, 0)], "category_id long, dish_id long, name string, is_set boolean, sort_order int"
    )
    prices = spark.createDataFrame(
        [(11, 3, "大", Decimal(320)), (11, 2, "小", None), (11, 1, None, Decimal(5)), (21, 4, None, None)], "dish_id long, price_id long, price_label string, price decimal(12,2)"
    )
    texts = spark.createDataFrame([(11, "zh", "translated"), (11, "en", "no"), (21, "zh", "t21")], "dish_id long, lang string, description string")
    details = spark.createDataFrame([(11, "", "i", "t"), (21, "detail", None, None)], "dish_id long, description string, image_url string, tags string")
    return categories, dishes, prices, texts, details


def test_menu_tree(spark):
    rows = menu.menu_tree(*menu_frames(spark)).orderBy(*menu.MENU_ORDER).collect()
    assert [(r.category_name, r.dish_id) for r in rows] == [("fish", 21), ("empty", None), ("soup", 12), ("soup", 11), ("soup", 11), ("soup", 11)]
    assert [(r.label, r.price) for r in rows if r.dish_id == 11] == [(None, Decimal(5)), ("小", None), ("大", Decimal(320))]
    by_dish = {r.dish_id: r for r in rows}
    assert by_dish[21].price_id is None and by_dish[21].description == "detail" and by_dish[11].description == "translated"


def test_sets_and_category_lists(spark):
    categories, dishes, prices, texts, details = menu_frames(spark)
    members = spark.createDataFrame([(12, 21, 2, 1), (12, 11, 1, 0), (12, 99, 1, 2)], "set_id long, item_id long, quantity int, sort_order int")
    rows = menu.menu_with_sets(dishes.select("dish_id", "name", "is_set"), members, dishes).orderBy("dish_id", "sort_order").collect()
    assert [(r.dish_id, r.item_id, r.quantity) for r in rows] == [(11, None, None), (12, 11, 1), (12, 21, 2), (21, None, None)]
    assert [r.item_id for r in menu.set_item_list(members, dishes, 12).collect()] == [11, 21]
    listed = {r.dish_id: r for r in menu.category_dishes(1, dishes, prices, details).collect()}
    assert sorted(listed) == [11, 12] and (listed[11].default_price, listed[11].n_sizes) == (5, 2) and (listed[12].default_price, listed[12].n_sizes) == (0, 0)
    assert [r.category_id for r in menu.category_index(categories).collect()] == [2, 3, 1]
    assert [r.dish_id for r in menu.set_index(dishes).collect()] == [12]


def test_a_set_with_very_many_members_stays_whole(spark):
    dishes = spark.range(1, 2001).selectExpr("1L AS category_id", "id AS dish_id", "concat('d', id) AS name", "id = 1 AS is_set", "0 AS sort_order")
    members = spark.range(2, 2001).selectExpr("1L AS set_id", "id AS item_id", "1 AS quantity", "CAST(id % 3 AS INT) AS sort_order")
    rows = menu.menu_with_sets(dishes.select("dish_id", "name", "is_set"), members, dishes)
    assert rows.filter("dish_id = 1").select("item_id").distinct().count() == 1999 and rows.count() == 1999 + 1999


def test_terms_of_conversations(spark):
    dishes = spark.createDataFrame([(1, "beef soup"), (2, "fish"), (3, "beef")], "dish_id long, name string")
    memory = spark.createDataFrame([(1, "beef"), (2, "beef"), (2, "fish"), (3, "beef"), (4, "x")], "conv long, term string")
    people, blocked = recommend.menu_blocked(dishes, memory, "conv")
    got = people.join(blocked, "term_set").select("conv", "dish_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3)]
    assert people.select("term_set").distinct().count() == 3


def test_intents_and_memory(spark):
    turns = [
        (1, 1, "我不吃牛肉，不吃beef"), (1, 2, "我不吃什麼"), (1, 3, "請清除記憶"), (1, 4, "不吃蔥"), (1, 5, "不吃蔥"), (1, 6, "有什麼忌口？"), (2, 1, "你好"), (2, 2, "我不吃啥"), (2, 3, " 不吃魚 "),
    ]
    df = spark.createDataFrame(turns, "conv long, turn long, text string")
    got = {(r.conv, r.turn): (r.action, r.intent) for r in chat.intents(df).collect()}
    assert got[1, 1] == ("add", "RECOMMEND") and got[1, 2] == ("query", "CHAT") and got[1, 3] == ("clear", "CHAT")
    assert got[1, 6] == ("query", "CHAT") and got[2, 1] == ("none", "CHAT") and got[2, 2][0] == "query"
    memory = pairs(chat.avoid_memory(df, "conv", "turn"), "conv", "epoch", "term", "since_turn", "is_current")
    assert memory == sorted([(1, 0, "牛肉", 1, False), (1, 0, "beef", 1, False), (1, 1, "蔥", 4, True), (2, 0, "魚", 3, True)], key=repr)


def test_budget_slots(spark):
    cells = {
        "預算2000元": ("總預算模式", 4, 500, 2000), "每人300元，5個人": ("人均預算模式", 5, 300, 1500), "三千塊": ("總預算模式", 4, 750, 3000),
        "我們六位人": ("人均預算模式", 6, 200, 1200), "隨便": ("人均預算模式", 2, 200, 400), "人均 五百": ("人均預算模式", 2, 5, 10), "1001 NT": ("總預算模式", 4, 250, 1001),
    }
    df = spark.createDataFrame([(t,) for t in cells], "text string")
    got = {r.text: (r.plan_mode, r.people, r.per_person, r.total_budget) for r in chat.budget_slots(df).collect()}
    assert got == cells


START = dt.date(2024, 1, 2)


def serving_frame(spark):
    rows = [(7, START + dt.timedelta(days=i), y, "m", START) for i, y in enumerate([3, 9, 9, 4])] + [(8, START - dt.timedelta(days=3), 5, "m", START)]
    return spark.createDataFrame(rows, "price_id long, target_date date, yhat int, model_version string, forecast_origin_date date")


def candidates(spark):
    dishes = spark.createDataFrame([(1, "fish"), (2, "greens"), (3, "soup"), (9, "fish")], "dish_id long, name string")
    prices = spark.createDataFrame([(1, 7, None, Decimal(280)), (2, 8, "小", Decimal(180)), (2, 18, "大", Decimal(320)), (3, 30, "x", None)], "dish_id long, price_id long, price_label string, price decimal(12,2)")
    asked = spark.createDataFrame([("r", 1, "soup", None), ("r", 2, "nothing", "w"), ("r", 3, "fish", "good"), ("r", 4, "greens", "")], "request_id string, position int, name string, reason string")
    return recommend.enrich(asked, recommend.dish_cards(dishes, prices))


def test_enrichment(spark):
    got = pairs(candidates(spark), "position", "name", "dish_id", "price", "size", "reason", "image_url")
    assert got == [
        (1, "soup", 3, 0.0, "x", "精選推薦", "/images/dish/3.webp"), (3, "fish", 1, 280.0, None, "good", "/images/dish/1.webp"),
        (4, "greens", 2, 180.0, "小", "精選推薦", "/images/dish/2.webp"),
    ]


def test_forecast_status_summary_and_ranking(spark):
    rows = recommend.attach_forecast(candidates(spark), serving_frame(spark), START)
    got = {r.name: r for r in recommend.summary_line(rows).collect()}
    assert [got[n].forecast_status for n in ("fish", "greens", "soup")] == ["ok", "missing", "missing"]
    assert [d.yhat for d in got["fish"].forecast] == [3, 9, 9, 4] and got["fish"].peak_date == START + dt.timedelta(days=1)
    assert got["fish"].summary == "- fish：預測近4日平均需求 6.2，高峰日 2024-01-03 需求 9.0"
    assert got["soup"].summary == "- soup：無預測資料"
    late = recommend.attach_forecast(candidates(spark), serving_frame(spark), dt.date(2024, 3, 1))
    assert dict(pairs(late, "name", "forecast_status")) == {"fish": "stale", "greens": "stale", "soup": "missing"}
    assert pairs(recommend.demand_top(rows, k=2), "name") == [("fish",), ("soup",)]
    nothing = recommend.attach_forecast(candidates(spark), serving_frame(spark).limit(0), START)
    assert {r.forecast_status for r in nothing.collect()} == {"missing"}


def test_avoided_dishes(spark):
    dishes = spark.createDataFrame([(1, 1, "牛肉麵", 0), (1, 2, "魚湯", 1), (2, 3, "牛", 0)], "category_id long, dish_id long, name string, sort_order int")
    terms = spark.createDataFrame([(1, "牛"), (2, "雞"), (3, "牛"), (3, "魚湯"), (3, "湯")], "conv long, term string")
    assert pairs(recommend.without_avoided(dishes, terms.filter("conv = 1")), "dish_id") == [(2,)]
    assert pairs(recommend.menu_left(dishes, terms, "conv"), "conv", "n_blocked", "n_left", "is_empty") == [(1, 2, 1, False), (2, 0, 3, False), (3, 3, 0, True)]
    assert pairs(recommend.category_lines(dishes, 1), "category_id", "line") == [(1, "牛肉麵"), (2, "牛")]
    assert recommend.visible_sections(dishes, "name", ["湯", "雞"]).count() == 2


def test_unique_pages_and_sources(spark):
    rows = [(1, "u", "T", "abc", "d1"), (2, "u", "T2", "zz", "d2"), (3, "u", "x", "", "d1"), (4, "", "x", "y", "d"), (5, "v", None, "12345", "d3")]
    df = spark.createDataFrame(rows, "pos long, url string, title string, content string, dish_name string")
    pages = documents.unique_pages(df)
    assert pairs(pages, "url", "title", "content", "content_length", "n_dishes") == [("u", "T", "abc", 3, 2), ("v", None, "12345", 5, 1)]
    assert pairs(documents.page_dishes(df), "url", "place", "dish_name") == [("u", 1, "d1"), ("u", 2, "d2"), ("v", 1, "d3")]
    assert documents.corpus_stats(pages).first().asDict() == {"n_pages": 2, "total_length": 8, "avg_length": 4.0}
    summaries = spark.createDataFrame([("u", "d1", "first", 1), ("u", "d1", "second", 2)], "url string, dish_name string, description string, pos long")
    intros = spark.createDataFrame([("u", "intro"), ("v", None)], "url string, restaurant_intro string")
    got = pairs(documents.assemble_sources(df.filter("url <> ''"), summaries, intros, 2), "pos", "snippet", "summary")
    assert got == [(1, "ab", "first"), (2, "zz", "intro"), (3, "", "first"), (5, "12", "")]
    text = documents.source_text(documents.assemble_sources(df.filter("pos = 2"), summaries, intros)).first().text
    assert text == "### 來源 2: u\n原始文字片段：\nzz\n摘要：\nintro"


def test_import_of_details(spark):
    items = spark.createDataFrame([("A", "old", ["t"], 0), (" A ", "new", ["t", "t", " s"], 1), ("B", "", [], 2), ("C", "c", [], 3), ("", "x", [], 4)], "name string, description string, tags array<string>, line long")
    names = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("B", 99)], "name string, dish_id long")
    dishes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "dish_id long")
    details = spark.createDataFrame([(1, "new", "t, s"), (3, None, ""), (4, "keep", None)], "dish_id long, description string, tags string")
    new, report = documents.import_details(items, names, dishes, details)
    assert pairs(new, "dish_id", "description", "tags") == [(1, "new", "t, s"), (2, "new", "t, s"), (3, None, None), (4, "keep", None)]
    assert report.first().asDict() == {"n_items": 3, "skipped_no_id": 1, "skipped_not_in_db": 1, "updated": 1}
    again, report = documents.import_details(items, names, dishes, new)
    assert sorted(again.collect()) == sorted(new.collect()) and report.first().updated == 0


def test_tags_and_taxonomy(spark):
    items = spark.createDataFrame([(["a", " a", "", "b"],), (["c", None],)], "tags array<string>")
    top = documents.top_tags(documents.tag_counts(items), 2)
    assert [(r.tag, r.n, r.n_tags, r.n_uses) for r in top.collect()] == [("a", 2, 3, 4), ("b", 1, 3, 4)]
    allowed = documents.allowed_tags(F.lit('{"x":{"g":["a","c"],"h":["a"]},"y":{"tags":["d"]}}'))
    assert items.limit(1).select(allowed).first()[0] == ["a", "c", "d"]
    assert pairs(documents.first_line_per_name(spark.createDataFrame([("n", 2), ("n", 1)], "name string, line int")), "line") == [(1,)]


def test_vector_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 6)).astype(np.float32)
    base[17] = base[3]
    corpus = spark.createDataFrame([(i, [float(x) for x in v], [str(i % 3)]) for i, v in enumerate(base)], "vec_id long, vector array<float>, tags array<string>").repartition(5)
    unit = base.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T

    def best(i, ok, k):
        order = sorted((j for j in range(300) if ok(j)), key=lambda j: (-round(sims[i, j], 12), j))
        return order[:k]

    monkeypatch.setattr(vectors, "REQUEST_ROWS", 7)
    got = {}
    for r in vectors.similar_items(corpus, corpus.filter("vec_id < 20").select("vec_id")).collect():
        got.setdefault(r.request_id, []).append((-round(r.similarity, 12), r.vec_id))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: best(i, lambda j, i=i: j != i, 5) for i in range(20)}

    asked = corpus.filter("vec_id < 10").select(F.col("vec_id").alias("request_id"), "vector", "tags")
    found = vectors.semantic_search(corpus, asked, k=4, threshold=0.5, by_tag=True)
    want = [(i, j) for i in range(10) for j in best(i, lambda j, i=i: sims[i, j] >= 0.5 and j % 3 == i % 3, 4)]
    assert pairs(found, "request_id", "vec_id") == sorted(want, key=repr)
    assert vectors.semantic_search(corpus, asked.limit(0)).count() == 0


def test_many_requests_take_one_scan_of_the_corpus(spark, tmp_path, monkeypatch):
    """5,000 requests with ties, more candidates than a task holds, and no driver in between."""
    monkeypatch.setattr(vectors, "REQUEST_ROWS", 2_000)
    monkeypatch.setattr(vectors, "HELD", 500)
    draw = np.random.default_rng(0)
    stored = np.round(draw.normal(size=(240, 4)), 1)
    stored[100:120] = stored[0]
    asked = np.round(draw.normal(size=(5_000, 4)), 1)
    asked[:5] = 0
    path = str(tmp_path / "corpus")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "vec_id long, vector array<double>").write.parquet(path)
    requests = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "request_id long, vector array<double>")
    found = vectors.nearest(spark.read.parquet(path), requests, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(path[-60:]) <= 1 and plan.count("FileScan parquet [vec_id") == 1
    got = {}
    for r in found.collect():
        got.setdefault(r.request_id, []).append(r.vec_id)
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    sims = np.round(unit(asked) @ unit(stored).T, 12)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v.tolist()) for k, v in enumerate(best)}


def test_very_many_avoided_terms(spark, monkeypatch):
    """10^5 terms of 1 to 40 characters, some inside others, in several automata."""
    import random

    monkeypatch.setattr(recommend, "TERM_ROWS", 30_000)
    draw = random.Random(0)
    names = ["".join(draw.choices("abcdeé湯 ", k=draw.randint(1, 60))) for _ in range(300)] + ["", None, "aaa"]
    terms = {"".join(draw.choices("abcdeé湯 ", k=draw.randint(3, 40))) for _ in range(100_000)} | {"a", "aa", "é湯", "", names[0], names[1][:20]}
    got = recommend.blocked_names(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in terms], "term string"))
    lengths = sorted({len(t) for t in terms if t})
    want = {(n, n[i : i + k]) for n in set(names) - {None} for k in lengths for i in range(len(n) - k + 1) if n[i : i + k] in terms}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 500
    assert recommend.blocked_names(spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([], "term string")).count() == 0
