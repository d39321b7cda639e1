"""Landing, validation, table changes, mapping and sinks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import grouping, mapping, mutate, replay, validate
from larder.plans import staging
from larder.sources import readers, sinks


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def sales_frame(spark, rows):
    names = list(staging.SALES_COLUMNS)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def test_sales_landing_rejects_the_whole_load(spark):
    good = [("20230101", " f1 ", "n", "1", "2", "3.0")]
    row = staging.land_sales(sales_frame(spark, good)).first()
    assert (row.close_work_date, row.food_id, row.qty) == (dt.date(2023, 1, 1), "f1", 3)
    for bad in [("x", "f", "n", "1", "2", "3"), ("20230101", "f", "n", "1.5", "2", "3"), ("20230101", "f", "n", "", "2", "3")]:
        with pytest.raises(validate.LoadRejected):
            staging.land_sales(sales_frame(spark, [*good, bad]))
    with pytest.raises(validate.LoadRejected, match="missing"):
        staging.land_sales(sales_frame(spark, good).drop("FoodID"))


def test_menu_landing(spark):
    raw = spark.createDataFrame([("1 ", "A", "c", "$1,200.005", "2023/1/5", " s")], "food_id string, food_name string, category string, price string, create_date string, shop_id string")
    row = staging.land_menu(raw).first()
    assert (row.food_id, str(row.price), row.create_date, row.shop_id) == ("1", "1200.01", dt.datetime(2023, 1, 5), "s")
    with pytest.raises(validate.LoadRejected):
        staging.land_menu(raw.withColumn("food_id", F.lit(None).cast("string")))


def model_frame(spark, rows):
    names = list(staging.MODEL_INPUT_COLUMNS)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", line int")


def test_model_input_contract(spark):
    base = ("1", "2024-01-01", "A", "1", "1", "2", "0", "c", "x", "1")
    later = ("1", "2024-01-01", "A", "1", "1", "5", "0", "c", "10", "1")
    other = ("2", "2024-01-02", "B", "1", "1", "2", "0", "c", "10", "0")
    raw = model_frame(spark, [(*base, 0), (*later, 1), (*other, 0)])
    with pytest.raises(validate.LoadRejected, match="one row per key"):
        staging.load_and_clean(raw, staging.InputConfig(line="line"))
    config = staging.InputConfig(drop_duplicates=True, line="line")
    assert pairs(staging.load_and_clean(raw, config), "canonical_dish_id", "qty", "price") == [("1", 5.0, 10.0), ("2", 2.0, 10.0)]
    first = staging.InputConfig(drop_duplicates=True, line="line", keep="first", end=dt.date(2024, 1, 1))
    assert pairs(staging.load_and_clean(raw, first), "qty", "price") == [(2.0, None)]
    ids = spark.createDataFrame([(2,)], "id int")
    assert staging.load_and_clean(raw, staging.InputConfig(ids=ids, line="line")).count() == 1
    for column, value in [("數量", "-1"), ("IsClosed", "2"), ("數量", "many")]:
        with pytest.raises(validate.LoadRejected):
            staging.load_and_clean(raw.filter("line = 0").withColumn(column, F.lit(value)), config)
    with pytest.raises(validate.LoadRejected, match="price"):
        staging.load_and_clean(raw.drop("price"), config)


def test_constraints_are_three_valued(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 1)], "a int, b int")
    got = dict(pairs(validate.check_constraints(df, {"order": validate.not_before(F.col("b"), F.col("a"))}), "rule", "n_violations"))
    assert got == {"order": 1}
    dup = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, 1)], "a int, b int")
    assert validate.check_unique(dup, ["a", "b"], "u").first().n_violations == 1


def test_upsert_keeps_defaults_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "t0", "m0", "x"), (2, "b", "t0", "m0", "x")], "id int, v string, made string, touched string, extra string")
    source = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    once = mutate.upsert(target, source, ["id"], insert_only={"made": F.lit("t1")}, touched={"touched": F.lit("m1")})
    want = [(1, "a", "t0", "m0", "x"), (2, None, "t0", "m1", "x"), (3, "c", "t1", "m1", None)]
    assert pairs(once, *target.columns) == want
    twice = mutate.upsert(once, source, ["id"], insert_only={"made": F.lit("t1")}, touched={"touched": F.lit("m1")})
    assert pairs(twice, *target.columns) == want


def test_insert_ignore(spark):
    target = spark.createDataFrame([(1, "old")], "id int, v string")
    source = spark.createDataFrame([(1, "new", 0), (2, "late", 1), (2, "early", 0), (None, "n", 0), (None, "n", 1)], "id int, v string, line int")
    got = mutate.insert_ignore(target, source, ["id"], [F.col("line")])
    assert pairs(got, "id", "v") == [(1, "old"), (2, "early"), (None, "n"), (None, "n")]


def test_versioned_replace(spark):
    state = spark.createDataFrame([("a", 1), ("b", 4)], "s string, version int")
    asked = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 3, 3), ("b", 4, None)], "s string, request_id int, expected_version int")
    got = pairs(replay.versioned_replace(state, asked, "s"), "s", "request_id", "applied", "current_version")
    assert got == [("a", 1, True, 2), ("a", 2, False, 2), ("b", 3, False, 4), ("b", 4, True, 5)]


def replayed(state, rows):
    """One request after the other."""
    version, out = dict(state), []
    for key, i, e in sorted(rows, key=lambda r: r[1]):
        if key in version:
            fits = e is None or e == version[key]
            version[key] += fits
            out.append((key, i, e, fits, version[key]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_replay_of_a_busy_key_in_ranges(spark, parts):
    """One key has most requests; expectations are right, stale, early or missing."""
    draw = random.Random(parts)
    state, guess, rows = {"a": 5, "b": 0, "c": -3, "quiet": 1}, {"a": 5, "b": 0, "c": -3, "none": 0}, []
    for i in range(600):
        key = draw.choice(["a"] * 9 + ["b", "c", "none"])
        kind = draw.random()
        e = None if kind < 0.2 else guess[key] + (0 if kind < 0.6 else draw.randint(-3, 4))
        guess[key] += e is None or e == guess[key]
        rows.append((key, i * 10**9, e))
    asked = spark.createDataFrame(rows, "s string, request_id long, expected_version long")
    got = replay.versioned_replace(spark.createDataFrame(list(state.items()), "s string, version long"), asked, "s", parts)
    assert sorted((tuple(r[c] for c in ("s", "request_id", "expected_version", "applied", "current_version")) for r in got.collect()), key=repr) == replayed(state, rows)


def test_range_maps_equal_replays_from_every_start():
    draw = random.Random(8)
    for _ in range(300):
        expected = [draw.choice([None, *range(-2, 9)]) for _ in range(draw.randint(0, 12))]
        found, free = replay.range_map(expected)
        for start in range(-8, 15):
            version = start
            for e in expected:
                version += e is None or e == version
            assert found.get(start, start + free) == version


def test_a_busy_session_spreads_over_tasks(spark):
    asked = spark.range(4000).selectExpr("IF(id % 3 > 0, 1L, id) AS s", "id AS request_id", "CAST(NULL AS LONG) AS expected_version")
    cut = grouping.segments(asked, ["s", "request_id"], 12)
    assert cut.filter("s = 1").select("_seg").distinct().count() >= 4


def test_small_table_changes(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "id int, p string, q string")
    patch = spark.createDataFrame([(1, None, "new"), (2, "B", "ignored")], "id int, p string, q string")
    assert pairs(mutate.patch_fields(t, patch, ["id"]), "id", "p", "q") == [(1, "a", "new"), (2, "B", "ignored")]
    assert pairs(mutate.fill_missing(t, patch, ["id"], ["q"]), "id", "q") == [(1, "new"), (2, "y")]
    assert pairs(mutate.null_out(t, spark.createDataFrame([(2,)], "k int"), "id", "k"), "id", "p") == [(2, "b"), (None, "a")]
    kids = spark.createDataFrame([(1, "x"), (2, "y")], "id int, c string")
    new = spark.createDataFrame([(1, "z"), (3, "not listed")], "id int, c string")
    assert pairs(mutate.replace_children(kids, new, t.filter("id = 1"), "id"), "id", "c") == [(1, "z"), (2, "y")]
    left = mutate.cascade_delete(t, t.filter("id = 1"), "id", kids=kids)
    assert (left["parents"].count(), left["kids"].count()) == (1, 1)
    assert pairs(mutate.blocked_by(t, kids.filter("id = 2"), "id", "id"), "id") == [(2,)]


def test_mapping_refresh(spark):
    t = dt.datetime
    menu = spark.createDataFrame(
        [
            (1, "f1", "A(大)", "c", t(2024, 1, 1), t(2024, 2, 1)), (2, "f1", "B", "c", None, t(2024, 3, 1)),
            (3, "f2", "A(12)", "c", t(2024, 1, 1), t(2024, 2, 1)), (4, "f3", " ", "c", t(2024, 1, 1), t(2024, 2, 1)), (5, None, "Z", "c", None, None),
        ],
        "menu_sk long, food_id string, food_name string, category_raw string, create_date timestamp, loaded_at timestamp",
    )
    sales = spark.createDataFrame([("f1", dt.date(2024, 1, 2)), ("f1", dt.date(2024, 1, 9)), ("f8", dt.date(2024, 1, 1))], "food_id string, close_work_date date")
    dishes = spark.createDataFrame([(7, "A", "大", "kept name", True)], "canonical_dish_id long, basename string, price_label string, canonical_name string, is_active boolean")
    bridge = spark.createDataFrame(
        [("f1", 1, "old", None, None, dt.date(2023, 1, 1), None, False), ("f7", 7, "gone", None, None, None, None, True)],
        "food_id string, canonical_dish_id long, source_menu_food_name string, source_menu_category_raw string, source_menu_snapshot_date date, first_seen_date date, last_seen_date date, is_active boolean",
    )
    all_dishes, new = mapping.build_mapping(menu, sales, dishes, bridge)
    assert pairs(all_dishes, "canonical_dish_id", "basename", "price_label", "canonical_name") == [(7, "A", "大", "kept name"), (8, "A(12)", "single", "A(12)")]
    assert pairs(new, "food_id", "canonical_dish_id", "first_seen_date", "last_seen_date", "is_active") == [
        ("f1", 7, dt.date(2023, 1, 1), dt.date(2024, 1, 9), True), ("f2", 8, None, None, True), ("f7", 7, None, None, True),
    ]
    wide = mapping.backfill_seen(new, mapping.sales_span_by_food(sales).withColumn("last_seen_date", F.lit(dt.date(2025, 1, 1))), extend=True)
    assert wide.filter("food_id = 'f1'").first().last_seen_date == dt.date(2025, 1, 1)
    assert pairs(mapping.unmapped_foods(sales, new, 200), "food_id") == [("f8",)]


def test_files_in_and_out(spark, tmp_path):
    csv = tmp_path / "sales.csv"
    csv.write_text("﻿ FoodID ,qty\n1,2\n", encoding="utf-8")
    assert readers.read_landing(spark, str(csv)).columns == ["FoodID", "qty"]
    assert readers.read_typed(spark, str(csv), "FoodID int, qty int").first().qty == 2

    with_header, without = tmp_path / "a.csv", tmp_path / "b.csv"
    with_header.write_text("Dish,category\nA,x\n ,y\nA,z\n", encoding="utf-8")
    without.write_text("A,x\nB,\nA,z\n", encoding="utf-8")
    assert pairs(readers.read_name_list(spark, str(with_header)), "name", "category") == [("A", "x")]
    assert pairs(readers.read_name_list(spark, str(without)), "name", "category") == [("A", "x"), ("B", None)]

    doc = {"items": [
        {"disg_detil": {"dish_name": " A ", "dish_describer": "d", "tags": ["t"]}}, {"dish_detail": {"dish_name": "B", "description": "e"}},
        {"dish_detail": {"dish_name": " "}}, {},
    ]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc), encoding="utf-8")
    items = readers.dish_items(readers.read_dish_documents(spark, str(path)))
    assert pairs(items, "name", "description", "tags") == [("A", "d", ["t"]), ("B", "e", [])]

    df = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    stage = str(tmp_path / "stage")
    sinks.write_staging(df, stage)
    sinks.write_staging(df, stage)
    sinks.write_staging(df, stage, truncate=False)
    assert spark.read.parquet(stage).count() == 4
    tally = sinks.write_json_with_metadata(df, str(tmp_path / "out")).first()
    assert (tally.total, tally.success, tally.errors) == (2, 1, 1)
    assert spark.read.json(str(tmp_path / "out" / "metadata")).first().total == 2
    assert pairs(readers.pending(df, df.filter("id = 1"), "id"), "id") == [(2,)]
    sinks.write_partitioned(df, str(tmp_path / "p"), ["id"])
    sinks.write_partitioned(df.filter("id = 2").withColumn("error", F.lit("x")), str(tmp_path / "p"), ["id"])
    assert pairs(spark.read.parquet(str(tmp_path / "p")), "id", "error") == [(1, None), (2, "x")]


def test_forecast_sink_counts_attempts_and_touches_only_its_origins(spark, tmp_path):
    day, later = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    schema = "canonical_dish_id long, forecast_origin_date date, target_date date, yhat int, model_version string, run_id string"
    first = spark.createDataFrame([(1, day, day, 5, "m", "r"), (1, later, later, 7, "m", "r")], schema)
    path = str(tmp_path / "fact")
    assert sinks.upsert_forecasts(None, first, path) == 2
    before = sorted(p.name for p in (tmp_path / "fact" / f"forecast_origin_date={day}").iterdir())
    again = spark.createDataFrame([(1, later, later, 8, "m", "r"), (2, later, later, 9, "m", "r")], schema)
    for _ in range(2):
        assert sinks.upsert_forecasts(spark.read.parquet(path), again, path) == 2
        assert pairs(spark.read.parquet(path), "canonical_dish_id", "forecast_origin_date", "yhat") == [(1, day, 5), (1, later, 8), (2, later, 9)]
    assert before == sorted(p.name for p in (tmp_path / "fact" / f"forecast_origin_date={day}").iterdir())


def test_counts_of_broken_rows_come_with_the_write(spark):
    df = spark.range(100).selectExpr("id", "IF(id % 10 = 0, NULL, id) AS v")
    counted = validate.Counted(df, {"n_missing": F.col("v").isNull(), "n_big": F.col("v") > 95})
    stored = counted.store("counted")
    assert (counted.n_rows, counted.counts, stored.count()) == (100, {"n_missing": 10, "n_big": 4}, 100)


def test_taxonomies_of_any_depth(spark):
    from larder.operators import documents

    cases = {
        '{"a":["x"," y ",""],"b":{"c":{"d":["x","z"]}}}': ["x", "y", "z"],
        '[[["deep [1]","{k: v}"]],{"q":"say \\"hi\\" : now"}]': ["deep [1]", "{k: v}", 'say "hi" : now'],
        '{"n":1,"t":true,"u":null}': [], '"alone"': ["alone"], '{"broken":["x"': [], "": [],
        '{"k" : "v\\u00e9", "w":["\\\\"]}': ["vé", "\\"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.tags for r in df.select("t", documents.taxonomy_tags(F.col("t")).alias("tags")).collect()} == cases
