"""Carts and orders against plain-Python step-by-step versions."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from larder.operators import carts, orders


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def cart_frame(spark, docs):
    rows = [(s, v, d if isinstance(d, str) or d is None else json.dumps(d)) for s, v, d in docs]
    return carts.read_cart(spark.createDataFrame(rows, "session_id string, version long, cart string"))


def item(uuid, qty, price=1, **more):
    return {"id": 1, "name": "n", "qty": qty, "price": price, "uuid": uuid, **more}


def test_invalid_items_are_dropped(spark):
    bad = [{"id": "x", "qty": 1}, {"id": 1, "qty": 0}, {"id": 1, "qty": "two"}, {"id": 1, "qty": 1, "price": -1}, {"id": 1, "qty": 1, "price": "p"}, {"qty": 1}]
    df = cart_frame(spark, [("a", 1, {"items": [*bad, item("u", 2, 10.005), {"id": 3, "qty": 1}], "note": "n"}), ("b", 1, "no json"), ("c", 1, None), ("d", 1, {"items": "?"})])
    assert pairs(carts.cart_items(df, ["session_id"]), "session_id", "id", "qty", "price") == [
        ("a", 1, 2, Decimal("10.01")), ("a", 3, 1, Decimal("0.00")),
    ]
    assert pairs(df.select("session_id", "cart_note", carts.cart_size(F.col("raw_items")).alias("n")), "session_id", "cart_note", "n") == [
        ("a", "n", 7), ("b", "", 0), ("c", "", 0), ("d", "", 0),
    ]


def test_changes_between_versions(spark):
    df = cart_frame(spark, [
        ("a", 1, {"items": [item("x", 1), item("y", 2)]}), ("a", 2, {"items": [item("x", 3), item("y", 1)]}), ("a", 3, {"items": []}),
        ("a", 4, {"items": [item("x", 3)]}), ("b", 2, {"items": [item("x", 9)]}),
    ])
    assert pairs(carts.consecutive_changes(df, "session_id", "version"), "session_id", "version", "uuid", "qty", "action") == [
        ("a", 1, "x", 1, "added"), ("a", 1, "y", 2, "added"), ("a", 2, "x", 2, "increased"), ("a", 4, "x", 3, "added"), ("b", 2, "x", 9, "added"),
    ]


def merge_by_hand(server, pending):
    merged = [dict(s) for s in server]
    for p in pending:
        same = [m for m in merged[: len(server)] if m["uuid"] == p["uuid"]]
        if same:
            same[0]["qty"] = max(same[0]["qty"], p["qty"])
            continue
        equal = [m for m in merged if all(m[k] == p[k] for k in carts.LINE)]
        if equal:
            equal[0]["qty"] += p["qty"]
        else:
            merged.append(dict(p))
    return merged


def test_merging_carts(spark):
    rnd = random.Random(5)

    def line(cart, pos, uuid):
        return {"cart": cart, "pos": pos, "uuid": uuid, "id": rnd.randint(1, 2), "size": rnd.choice([None, "L"]), "note": None, "price": 1.0, "qty": rnd.randint(1, 6)}

    schema = "cart int, pos long, uuid string, id long, size string, note string, price double, qty long"
    server, pending, want = [], [], []
    for cart in range(12):
        s = [line(cart, i, f"u{i}") for i in range(rnd.randint(0, 4))]
        p = [line(cart, i, f"u{rnd.randint(0, 3)}" if rnd.random() < 0.5 else f"p{i}") for i in range(5)]
        server, pending = server + s, pending + p
        want += [(cart, m["uuid"], m["id"], m["size"], m["qty"]) for m in merge_by_hand(s, p)]
    make = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = carts.merge_carts(make(server), make(pending), "cart")
    assert pairs(got, "cart", "uuid", "id", "size", "qty") == sorted(want, key=repr)


def fold_by_hand(ops):
    state, note = {}, {}
    for session, _, op, i, size, qty, text in ops:
        lines, key = state.setdefault(session, {}), (i, size)
        if op == "add":
            lines[key] = lines.get(key, 0) + qty
        elif op == "delta" and key in lines:
            lines[key] = max(1, lines[key] + qty)
        elif op == "remove":
            lines.pop(key, None)
        elif op == "clear":
            lines.clear()
            note[session] = ""
        elif op == "note":
            note[session] = text
    return [(s, i, size, q) for s, lines in state.items() for (i, size), q in lines.items()], note


def test_folding_cart_operations(spark):
    rnd = random.Random(6)
    kinds = ["add", "add", "add", "delta", "delta", "remove", "note", "clear"]
    ops = [
        (rnd.choice("ab"), n, rnd.choice(kinds[: 7 if n % 9 else 8]), rnd.randint(1, 2), rnd.choice([None, "L"]), rnd.randint(-4, 4), f"t{n}") for n in range(120)
    ]
    ops = [(s, n, op, i, z, abs(q) + 1 if op == "add" else q, t) for s, n, op, i, z, q, t in ops]
    df = spark.createDataFrame(ops, "session string, op_id long, op string, id long, size string, qty long, text string")
    df = df.withColumns({"note": F.lit(None).cast("string"), "price": F.lit(1.0)})
    lines, notes = fold_by_hand(ops)
    assert pairs(carts.fold_operations(df, "session", "op_id"), "session", "id", "size", "qty") == sorted(lines, key=repr)
    assert dict(pairs(carts.fold_notes(df, "session", "op_id"), "session", "cart_note")) == notes


def test_checkout(spark):
    df = cart_frame(spark, [("a", 1, {"items": [item("u", 3, 33.333), {"id": 99, "name": "x", "qty": 1, "price": 1}], "note": "hi"}), ("a", 2, {"items": []}), ("b", 3, None)])
    df = df.withColumn("table_id", F.lit("T1"))
    known = spark.createDataFrame([(1,)], "dish_id long")
    earlier = spark.createDataFrame([("a",), ("a",)], "session_id string")
    got = {r.version: r for r in carts.checkout(df, "session_id", "version", known, earlier).collect()}
    assert (got[1].status, got[1].total_amount, got[1].n_lines, got[1].n_unknown_dishes, got[1].note) == ("pending", Decimal("100.99"), 2, 1, "hi")
    assert (got[2].error, got[3].error, got[3].status) == ("cannot_submit_empty_cart_after_order", "cart_empty", None)
    snap = json.loads(df.filter("version = 1").select(carts.snapshot(carts.clean_items(F.col("raw_items")), F.col("cart_note"))).first()[0])
    assert snap["note"] == "hi" and snap["items"][0] == {"id": 1, "name": "n", "qty": 3, "price": 33.33, "note": None, "size": None}


ITEMS = "order_id long, order_item_id long, dish_id long, name string, quantity long, unit_price decimal(12,4)"


def edited(spark, items, patches, edits=()):
    head = spark.createDataFrame([(o, "pending", "n", Decimal("1.00")) for o in sorted({i[0] for i in items})], "order_id long, status string, note string, total_amount decimal(18,2)")
    state, rows = orders.edit_orders(
        head, spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(edits), "order_id long, status string, note string"), spark.createDataFrame(patches, ITEMS)
    )
    return {r.order_id: r for r in state.collect()}, rows


def test_order_edits(spark):
    d = Decimal
    items = [(1, 10, 1, "a", 2, d(100)), (2, 20, 1, "a", 1, d(275)), (2, 21, 1, "b", 3, d(50)), (3, 30, 1, "a", 1, d(7)), (4, 40, 1, "a", 1, d(9)), (5, 50, 1, "a", 1, d(9))]
    patches = [
        (1, 10, None, None, 5, None), (1, None, None, "new", 3, d(50)), (1, None, None, None, 0, None), (2, 21, None, "", 0, None),
        (3, 99, None, None, 1, None), (4, None, None, None, 1, d(3)),
    ]
    state, rows = edited(spark, items, patches, [(1, "ready", None), (5, "eaten", "x")])
    assert (state[1].total_amount, state[1].status, state[1].note, state[1].error) == (d("650.00"), "ready", "n", None)
    assert state[2].total_amount == d("275.00")
    assert (state[3].error, state[4].error, state[5].error) == ("order_item_not_found", "order_item_missing_fields", "invalid_status: eaten")
    assert state[5].status == "pending" and state[3].total_amount == d("1.00")
    assert rows.filter("order_id = 1").count() == 2


def test_large_order_totals(spark):
    rows = [(1, i, 1, "n", 1 + i % 5, Decimal(str(10.5 + (i % 10) * 0.5))) for i in range(150)]
    total = orders.order_totals(spark.createDataFrame(rows, ITEMS)).first()
    assert total.total_amount == sum(r[5] * r[4] for r in rows) and total.n_lines == 150


def test_lists_are_clamped(spark):
    head = spark.createDataFrame([(i, i % 3, i) for i in range(10)], "order_id long, session_id long, created_at long")
    assert [r.order_id for r in orders.newest(head, "created_at", "order_id", 0).collect()] == [9]
    items = spark.createDataFrame([(9, 90, 1, "n", 4, Decimal(2)), (9, 91, 1, "n", 1, Decimal(2))], ITEMS)
    assert pairs(orders.recent_orders(head, items, 2), "order_id", "item_count") == [(8, 0), (9, 5)]
    history = orders.session_history(head, items, 1)
    assert pairs(history, "session_id", "order_id", "quantity") == [(0, 9, 1), (0, 9, 4), (1, 7, None), (2, 8, None)]
    found = orders.lookup(spark.createDataFrame([(1,), (77,)], "order_id long"), head, "order_id", "order_not_found")
    assert pairs(found, "order_id", "error") == [(1, None), (77, "order_not_found")]
