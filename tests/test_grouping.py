"""The per-key helpers against plain Python, with so many ranges that every carry is exercised."""

import random

from pyspark.sql import functions as F

from larder.operators import grouping as g


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def events(spark, n=200, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice("aab"), i, rnd.randint(-3, 3)) for i in rnd.sample(range(10 * n), n)]
    return sorted(rows, key=lambda r: r[1]), spark.createDataFrame(rows, "k string, id long, v long")


def test_running_sum(spark):
    rows, df = events(spark)
    totals, want = {}, []
    for k, i, v in rows:
        totals[k] = totals.get(k, 0) + v
        want.append((k, i, totals[k]))
    assert rows_of(g.running_sum(df, ["k"], "id", {"s": F.col("v")}, parts=23), "k", "id", "s") == sorted(want)


def test_previous_row(spark):
    rows, df = events(spark, seed=2)
    last, want = {}, []
    for k, i, v in rows:
        want.append((k, i, last.get(k)))
        last[k] = v
    got = g.previous_row(df, ["k"], "id", {"p": "v"}, parts=23)
    assert sorted(map(repr, rows_of_any(got, "k", "id", "p"))) == sorted(map(repr, want))


def rows_of_any(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_dense_ids_are_dense_and_repeatable(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("n"))
    first = {r.n: r.num for r in g.dense_ids(df, ["n"], "num", 11, parts=7).collect()}
    again = {r.n: r.num for r in g.dense_ids(df.repartition(13), ["n"], "num", 11).collect()}
    assert first == again and sorted(first.values()) == list(range(11, 5011))


def test_fold_add_floor(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.randint(-4, 4), rnd.choice([None, 1, 2, 5])) for i in range(300)]
    state = {}
    for k, _, add, floor in rows:
        x = state.get(k, 0) + add
        state[k] = x if floor is None else max(x, floor)
    df = spark.createDataFrame(rows, "k string, id long, a long, f long")
    assert dict(rows_of(g.fold_add_floor(df, ["k"], "id", "a", "f", "x", parts=23), "k", "x")) == state


def test_left_join_many(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    right = spark.createDataFrame([(1, 10), (1, 11)], "k int, b int")
    got = {(r.k, r.a, r.b) for r in g.left_join_many(left, right, ["k"]).collect()}
    assert got == {(1, "x", 10), (1, "x", 11), (2, "y", None)}


def test_top_per_key(spark):
    rows, df = events(spark, seed=4)
    got = rows_of(g.top_per_key(df, ["k"], [F.col("v").desc(), F.col("id")], 3), "k", "id")
    want = []
    for k in "ab":
        want += [(k, i) for _, i, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:3]]
    assert got == sorted(want)


def test_ranges_follow_row_counts_not_id_values(spark):
    """One key with most rows under ids that lie far apart; keys may be NULL."""
    rnd = random.Random(6)
    rows = [(rnd.choice([None, "a", "a", "a", "b"]), i * 10**12 + rnd.randint(0, 10**9), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    sizes = [r["count"] for r in g.segments(df, ["k", "id"], 12).groupBy("_seg").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * sorted(sizes)[6]
    got = g.running_sum(df, ["k"], "id", {"s": F.col("v")}, parts=12).collect()
    for key in (None, "a", "b"):
        assert [r.s for r in sorted((r for r in got if r.k == key), key=lambda r: r.id)] == list(range(1, 1 + sum(r[0] == key for r in rows)))
    again = g.previous_row(df, ["k"], "id", {"p": "id"}, parts=12).collect()
    for key in (None, "a", "b"):
        own = sorted((r for r in again if r.k == key), key=lambda r: r.id)
        assert [r.p for r in own] == [None, *(r.id for r in own)][:-1]


def test_carry_is_one_row_per_range(spark):
    df = spark.range(2000).select((F.col("id") % 400).alias("k"), "id", F.lit(1).alias("v"))
    cut = g.segments(df, ["k", "id"], 9)
    assert g.carried(cut, ["k"], {"t": F.sum("v")}, {"c": F.sum("t").over(g.W.partitionBy("k").orderBy("_seg"))}).count() <= 9
