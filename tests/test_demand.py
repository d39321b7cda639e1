"""Panel, features, baselines, backtest, policy and gates on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import baseline, calendar, features, gates, panel, policy, validate
from larder.plans import weekly

MON = dt.date(2024, 1, 1)


def day(n):
    return MON + dt.timedelta(days=n)


def make_panel(spark, excluded=None):
    sales = spark.createDataFrame(
        [
            (day(0), "f1", 1, 2, 3), (day(0), "f1", -5, None, -1), (day(0), "f2", 1, 1, 2), (day(2), "f9", 4, 4, 4),
            (day(4), "f1", 1, 0, 1), (day(5), "f3", 1, 0, 1), (day(3), "f2", 7, 7, 7),
        ],
        "close_work_date date, food_id string, dinein_qty long, reserve_qty long, qty long",
    )
    bridge = spark.createDataFrame(
        [("f1", 1, True), ("f2", 1, True), ("f3", 3, True), ("f9", 9, False)], "food_id string, canonical_dish_id long, is_active boolean"
    )
    dishes = spark.createDataFrame(
        [(1, "A", "single", "A", True), (2, "B", "single", "B", True), (3, "C", "大", "C(大)", False)],
        "canonical_dish_id long, basename string, price_label string, canonical_name string, is_active boolean",
    )
    return panel.clean_daily_demand(sales, bridge, dishes, excluded)


def test_panel_is_dense_unique_and_clean(spark):
    rows = {(r.close_work_date, r.canonical_dish_id): r for r in make_panel(spark).collect()}
    assert sorted(rows) == [(day(n), 1) for n in range(6)]  # dish 2 never sold, dish 3 is switched off
    first = rows[day(0), 1]
    assert (first.qty, first.dinein_qty, first.reserve_qty, first.src_row_cnt) == (5, 2, 3, 3)
    assert first.is_shop_closed and not first.is_zero_filled and not first.has_unmapped_food
    empty = rows[day(2), 1]
    assert empty.is_zero_filled and empty.qty == 0 and empty.unmapped_food_cnt == 1 and not empty.has_unmapped_food


def test_excluded_days_are_zero_filled_and_marked(spark):
    rows = {r.close_work_date: r for r in make_panel(spark, (day(3), day(4))).collect()}
    assert rows[day(3)].qty == 0 and rows[day(3)].is_excluded and not rows[day(4)].is_excluded


def test_fact_refresh_keeps_the_rest(spark):
    demand = make_panel(spark)
    fact = demand.select(*panel.FACT_KEYS, *panel.FACT_VALUES).withColumn("qty", F.lit(99).cast("long"))
    fresh = {r.close_work_date: r.qty for r in panel.refresh_fact(fact, demand, day(1), day(3)).collect()}
    assert fresh == {day(0): 99, day(1): 0, day(2): 0, day(3): 7, day(4): 99, day(5): 99}


def test_calendar_of_empty_sales_uses_the_default_span(spark):
    empty = spark.createDataFrame([], "close_work_date date")
    row = calendar.sales_span(empty).first()
    assert (row.start_date, row.end_date) == (dt.date(2020, 1, 1), dt.date(2030, 12, 31))
    week = calendar.calendar_columns(spark.createDataFrame([(dt.date(2024, 12, 30),)], "date date")).first()
    assert (week.iso_week, week.day_of_week_iso, week.day_name_en, week.is_shop_closed) == (1, 1, "Monday", True)


def history(spark, days=40, dishes=(1, 2)):
    rows = [(d, day(n), 10 * d + n % 7, "c", None if n < 5 else float(n)) for d in dishes for n in range(days)]
    return spark.createDataFrame(rows, "canonical_dish_id long, close_work_date date, qty long, category string, price double")


CONFIG = features.FeatureConfig(static=["price"], use_weekday=True, use_target_day=True, lags=[1, 7], windows=[3], stats=["mean", "median", "std"])


def feature_rows(df):
    return {(r.canonical_dish_id, r.target_date): r.asDict() for r in df.collect()}


def test_demand_after_the_origin_never_changes_features(spark):
    origin = day(28)
    past = history(spark)
    future = past.withColumn("qty", F.when(F.col("close_work_date") > F.lit(origin), 1_000_000).otherwise(F.col("qty")))
    a = feature_rows(features.forecast_features(past, origin, CONFIG))
    assert a == feature_rows(features.forecast_features(future, origin, CONFIG))
    assert len(a) == 12 and a[1, day(29)]["lag_1"] == 10.0 and a[1, day(30)]["lag_1"] is None
    assert a[1, day(29)]["lag_7"] == 11.0 and a[1, day(29)]["target_day"] == 0 and a[1, day(29)]["price"] == 28.0


def test_lag_is_a_day_lag_when_history_stops_early(spark):
    origin = day(28)
    short = history(spark).filter(F.col("close_work_date") <= F.lit(day(26)))
    rows = feature_rows(features.forecast_features(short, origin, CONFIG))
    full = feature_rows(features.forecast_features(history(spark), origin, CONFIG))
    assert rows[1, day(29)]["lag_7"] == full[1, day(29)]["lag_7"] == 11.0
    assert rows[1, day(29)]["lag_1"] is None


def test_windows_do_not_cross_dishes_and_take_one_value(spark):
    two = history(spark, days=2)
    rows = feature_rows(features.forecast_features(two, day(1), CONFIG))
    assert rows[2, day(2)]["roll_mean_3"] == 20.5 and rows[2, day(4)]["roll_mean_3"] == 21.0
    assert rows[2, day(4)]["roll_std_3"] is None


def test_feature_order_and_white_list():
    assert CONFIG.columns == ["canonical_dish_id", "price", "day_of_week", "target_day", "lag_1", "lag_7", "roll_mean_3", "roll_median_3", "roll_std_3"]
    with pytest.raises(ValueError):
        features.FeatureConfig(stats=["__class__"])


def test_baseline_falls_back_from_group_to_id_to_overall(spark):
    train = history(spark, days=3).withColumn("day_of_week", F.weekday("close_work_date"))
    model = baseline.train_baseline(train, "k_week_median", ["canonical_dish_id", "day_of_week"], k=2)
    ask = spark.createDataFrame([(1, 0), (1, 6), (7, 0), (None, 0)], "canonical_dish_id long, day_of_week int")
    got = {(r.canonical_dish_id, r.day_of_week): r.y_pred for r in baseline.predict_baseline(model, ask).collect()}
    assert got == {(1, 0): 10.0, (1, 6): 11.5, (7, 0): 16.0, (None, 0): 16.0}
    with pytest.raises(ValueError):
        baseline.train_baseline(train, "k_week_median", ["canonical_dish_id"], k=0)
    with pytest.raises(ValueError):
        baseline.train_baseline(train, "mean", ["canonical_dish_id"])


def test_null_group_keys_are_a_group(spark):
    train = spark.createDataFrame(
        [(1, day(0), 4, None), (1, day(7), 8, None), (1, day(1), 100, "x")], "canonical_dish_id long, close_work_date date, qty long, g string"
    )
    model = baseline.train_baseline(train, "seasonal_median", ["g"])
    ask = spark.createDataFrame([(1, None), (1, "x"), (1, "new")], "canonical_dish_id long, g string")
    got = {r.g: r.y_pred for r in baseline.predict_baseline(model, ask).collect()}
    assert got == {None: 6.0, "x": 100.0, "new": 8.0} and model.by_id is None


def test_baseline_trains_strictly_before_the_origin(spark):
    a = baseline.baseline_forecast(history(spark), day(28)).collect()
    changed = history(spark).withColumn("qty", F.when(F.col("close_work_date") >= F.lit(day(28)), 0).otherwise(F.col("qty")))
    assert sorted(a) == sorted(baseline.baseline_forecast(changed, day(28)).collect()) and len(a) == 12


def test_backtest_equals_single_forecasts(spark):
    past, origins = history(spark), [day(14), day(21)]
    versions = {"k": {"method": "k_week_median", "k": 2}, "s": {"method": "seasonal_median"}}
    got = {(r.fold_id, r.model_version, r.canonical_dish_id, r.target_date): r.yhat for r in baseline.rolling_backtest(past, origins, versions).collect()}
    want = {}
    for n, o in enumerate(origins):
        for v, spec in versions.items():
            for r in baseline.baseline_forecast(past, o, spec["method"], spec.get("k", 4)).collect():
                want[n, v, r.canonical_dish_id, r.target_date] = r.yhat
    assert got == want


def test_policy_prefers_low_error_then_name_and_keeps_unseen_dishes(spark):
    back = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (2, "a", 5.0), (2, "b", 1.0)], "canonical_dish_id long, model_version string, abs_error double")
    old = spark.createDataFrame(
        [(2, "a", day(-9), None, False, "x"), (3, "a", day(-9), None, True, "x")],
        "canonical_dish_id long, chosen_model_version string, effective_from date, effective_to date, is_active boolean, note string",
    )
    new = policy.write_policy(old, back, day(0))
    got = {r.canonical_dish_id: (r.chosen_model_version, r.effective_from, r.is_active) for r in new.collect()}
    assert got == {1: ("a", day(0), True), 2: ("b", day(0), True), 3: ("a", day(-9), True)}
    assert sorted(policy.write_policy(new, back, day(0)).collect()) == sorted(new.collect())


def test_serving_takes_the_latest_origin_of_the_chosen_version(spark):
    ts = dt.datetime(2024, 1, 1)
    fc = spark.createDataFrame(
        [(1, day(0), day(1), 5, "a ", "r", ts), (1, day(1), day(1), 6, "a", "r", ts), (1, day(1), day(1), 7, "b", "r", ts), (2, day(1), day(1), 9, "a", "r", ts)],
        "canonical_dish_id long, forecast_origin_date date, target_date date, yhat int, model_version string, run_id string, created_at timestamp",
    )
    pol = spark.createDataFrame([(1, " a", True), (2, "a", False)], "canonical_dish_id long, chosen_model_version string, is_active boolean")
    price = spark.createDataFrame([(1, 12, True), (1, 11, False), (1, 13, True)], "canonical_dish_id long, dish_price_id long, is_active boolean")
    assert [(r.price_id, r.yhat) for r in policy.serving_view(fc, pol, price).collect()] == [(12, 6)]


def gate_frames(spark, dishes=20, days=6):
    rows = [(d, day(0), day(n + 1), 3, "m") for d in range(dishes) for n in range(days)]
    fc = spark.createDataFrame(rows, "canonical_dish_id long, forecast_origin_date date, target_date date, yhat int, model_version string")
    back = spark.createDataFrame([(d, v) for d in range(dishes) for v in ("m", "baseline")], "canonical_dish_id long, model_version string")
    pol = spark.createDataFrame([(d, "m" if d else "Baseline", True) for d in range(dishes)], "canonical_dish_id long, chosen_model_version string, is_active boolean")
    price = spark.createDataFrame([(d, d, True) for d in range(dishes)], "canonical_dish_id long, dish_price_id long, is_active boolean")
    return fc, back, pol, fc, price


def test_gates_pass_and_collect_every_failure(spark):
    fc, back, pol, serving, price = gate_frames(spark)
    assert len(gates.require_healthy(gates.health_report(fc, back, pol, serving, price, day(0)))) == 11
    assert all(r.passed for r in gates.smoke_checks(pol, serving, day(0)).collect())
    fc, back, pol, serving, price = gate_frames(spark, dishes=5, days=2)
    with pytest.raises(gates.GateFailed) as failed:
        gates.require_healthy(gates.health_report(fc, back.filter("model_version = 'm'"), pol, serving, price, day(0)))
    assert all(c in str(failed.value) for c in ["F1", "F2", "B1", "B2"]) and "P3" not in str(failed.value)
    none = gates.health_report(fc, back, pol, serving, price, day(7))
    assert {r.check_id: r.value for r in none.collect()}["F3"] == 0.0


def test_weekly_rows(spark):
    run = weekly.WeeklyRun(origin=day(28), run_id="r", config={"baseline": {"model_version": "base"}})
    rows = weekly.forecast_rows(history(spark), run)
    assert rows.count() == 12 and rows.filter("model_version <> 'base'").isEmpty()
    with pytest.raises(ValueError):
        weekly.forecast_rows(history(spark), weekly.WeeklyRun(origin=day(28), run_id="r"))
    with pytest.raises(ValueError):
        weekly.forecast_rows(history(spark), weekly.WeeklyRun(origin=day(29), run_id="r", baseline_version="b"))
    with pytest.raises(validate.LoadRejected):
        weekly.forecast_rows(history(spark), weekly.WeeklyRun(origin=day(0), run_id="r", baseline_version="b"))
    without = weekly.WeeklyRun(origin=day(28), run_id="r", baseline_version="b", model_version="m", score_model=lambda h, o: None)
    assert weekly.forecast_rows(history(spark), without).count() == 12


def test_any_predictor_scores_in_feature_order(spark):
    class Doubled:
        def predict(self, rows):
            return rows["lag_7"].fillna(0) * 2 + 0.5

    config = features.FeatureConfig(lags=[7])
    rows = features.forecast_features(history(spark), day(28), config)
    got = {(r.canonical_dish_id, r.target_date): r.yhat for r in weekly.score_with(Doubled, rows, config).collect()}
    assert got[1, day(29)] == 22 and len(got) == 12


@pytest.mark.parametrize("parts", [1, 9])
def test_exact_median_of_a_busy_key_with_many_values(spark, parts):
    import random
    import statistics

    draw = random.Random(parts)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([draw.random(), 2.5, -1.0, None])) for _ in range(3000)] + [("none", None), ("one", 4.0), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.y_pred, r.n_rows) for r in baseline.exact_median(df, ["k"], "v", parts=parts).collect()}
    for key in ("a", "b", None, "one", "two"):
        own = [v for k, v in rows if k == key and v is not None]
        assert got[key] == (pytest.approx(statistics.median(own)), len(own))
    assert got["none"] == (None, 0)
    weighted = spark.createDataFrame([("x", 1.0, 3), ("x", 9.0, 4), ("x", 5.0, 0)], "k string, v double, n int")
    assert [tuple(r) for r in baseline.exact_median(weighted, ["k"], "v", weight=F.col("n"), parts=parts).collect()] == [("x", 9.0, 7)]
    whole = baseline.exact_median(df, [], "v", parts=parts).first()
    assert whole.y_pred == pytest.approx(statistics.median([v for _, v in rows if v is not None]))


def test_folds_move_each_history_row_once(spark):
    rows = [(d, dt.date(2024, 1, 1) + dt.timedelta(days=k), (k * d) % 17) for d in (1, 2, 3) for k in range(70)]
    history = spark.createDataFrame(rows, "canonical_dish_id long, close_work_date date, qty long")
    versions = {"k": {"method": "k_week_median", "k": 3}, "s": {"method": "seasonal_median"}}
    origins = [dt.date(2024, 1, 29) + dt.timedelta(weeks=i) for i in range(5)]
    made = baseline.fold_forecasts(history, origins, versions)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") > plan.index("Generate")
    for n, origin in enumerate(origins):
        for name, spec in versions.items():
            alone = baseline.baseline_forecast(history, origin, spec["method"], spec.get("k", 4))
            want = sorted((r.canonical_dish_id, r.target_date, r.yhat) for r in alone.collect())
            own = made.filter((F.col("fold_id") == n) & (F.col("model_version") == name)).collect()
            assert sorted((r.canonical_dish_id, r.target_date, r.yhat) for r in own) == want
