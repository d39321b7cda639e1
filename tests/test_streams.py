"""Streams over several micro-batches: state must carry from one to the next."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from larder.operators.carts import consecutive_changes
from larder.streaming import carts, events, run
from larder.streaming.run import end_marker, read_stream, run_to_table


def stream_of(spark, tmp_path, batches):
    """One file per batch, with growing modification times, read one at a time."""
    path = str(tmp_path / "in")
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return read_stream(spark, path, batches[0].schema, files_per_batch=1)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def cart(**quantities):
    return json.dumps({"items": [{"id": 1, "name": u, "qty": q, "price": 1, "uuid": u} for u, q in quantities.items()], "note": ""})


def test_cart_changes_across_batches(spark, tmp_path):
    schema = "session_id long, version long, cart string"
    batches = [
        spark.createDataFrame([(1, 2, cart(x=3)), (1, 1, cart(x=1, y=2)), (2, 1, cart(x=9))], schema),
        spark.createDataFrame([(1, 3, cart(x=5, y=1)), (2, 2, cart(x=9))], schema),
    ]
    out = carts.cart_changes(stream_of(spark, tmp_path, batches))
    assert pairs(out, "session_id", "version", "uuid", "qty", "action") == [
        (1, 1, "x", 1, "added"), (1, 1, "y", 2, "added"), (1, 2, "x", 2, "increased"), (1, 3, "x", 2, "increased"), (1, 3, "y", 1, "added"), (2, 1, "x", 9, "added"),
    ]


def test_conflicts_across_batches(spark, tmp_path):
    schema = "session_id long, request_id long, expected_version long"
    batches = [spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 3, None)], schema), spark.createDataFrame([(1, 4, 2), (2, 5, 2), (2, 6, 2)], schema)]
    out = carts.version_conflicts(stream_of(spark, tmp_path, batches))
    assert pairs(out, "session_id", "request_id", "current_version") == [(1, 2, 2), (2, 6, 3)]


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_held_versions(spark, tmp_path):
    schema = "session_id long, version long, arrival long"
    batches = [
        spark.createDataFrame([(1, 5, 1), (1, 5, 0), (2, 7, 2)], schema),
        spark.createDataFrame([(1, 5, 3), (1, 6, 4), (1, 5, 5), (2, 8, 6)], schema),  # however late, a new version passes
    ]
    out = run_to_table(events.new_versions(stream_of(spark, tmp_path, batches)), "t")
    assert pairs(out, "session_id", "version", "arrival") == [(1, 5, 0), (1, 5, 5), (1, 6, 4), (2, 7, 2), (2, 8, 6)]


def test_a_replay_of_many_batches_loses_nothing(spark, tmp_path):
    schema = "session_id long, change_id long, ts timestamp"
    day = 86_400_000
    rows = [(1, 1, at(0)), (1, 2, at(200)), (1, 3, at(400)), (1, 4, at(900)), (2, 5, at(100)), (1, 6, at(40 * day)), (1, 7, at(day))]
    batches = [spark.createDataFrame([rows[k]], schema) for k in (5, 0, 3, 1, 6, 4, 2)]  # one event a batch, the newest first
    stream = stream_of(spark, tmp_path, batches)
    close = end_marker(str(tmp_path / "in"), batches[0].schema, "ts")
    sent = run_to_table(events.debounced(stream, "change_id", delay=events.REPLAY), "t", close)
    assert pairs(sent, "session_id", "change_id", "n_changes") == [(1, 3, 3), (1, 4, 1), (1, 6, 1), (1, 7, 1), (2, 5, 1)]


def test_counts_of_a_replay(spark, tmp_path):
    schema = "session_id long, change_id long, ts timestamp"
    batches = [spark.createDataFrame([r], schema) for r in [(1, 1, at(7_200_000)), (1, 2, at(0)), (2, 3, at(100)), (1, 4, at(10)), (1, 5, at(7_200_001))]]
    stream = stream_of(spark, tmp_path, batches)
    close = end_marker(str(tmp_path / "in"), batches[0].schema, "ts")
    counts = run_to_table(events.session_counts(stream, "1 hour", delay=events.REPLAY), "t", close)
    assert pairs(counts, "session_id", "n_events") == [(1, 2), (1, 2), (2, 1)]


def test_order_status_joins_the_table(spark, tmp_path):
    schema = "session_id long, order_id long, status string, action string, total_amount double"
    stream = stream_of(spark, tmp_path, [spark.createDataFrame([(1, 10, "pending", "created", 5.0), (9, 11, "ready", "updated", 6.0)], schema)])
    tables = spark.createDataFrame([(1, "T1")], "session_id long, table_id string")
    out = run_to_table(events.order_status(stream, tables), "t")
    assert pairs(out, "order_id", "table_id", "total_amount") == [(10, "T1", 5.0), (11, None, None)]


def test_a_killed_job_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    """The second micro-batch dies after it wrote its rows; the next run repeats it and nothing counts twice."""
    monkeypatch.setattr(run, "WHOLE_EVERY", 2)
    schema = "session_id long, request_id long, expected_version long"
    rows = [(k % 2, k, [None, 1 + k // 3, k // 2, 7][k % 4]) for k in range(30)]
    stream = stream_of(spark, tmp_path, [spark.createDataFrame(rows[k : k + 6], schema) for k in range(0, 30, 6)])
    whole = pairs(carts.version_conflicts(stream), "session_id", "request_id", "current_version")
    assert len(whole) > 5
    real, calls = carts.version_step, []

    def dies(batch, held):
        calls.append(1)
        found, newest = real(batch, held)
        if len(calls) == 2:
            return found, newest.select(F.raise_error(F.lit("lost")).alias("session_id"), "version")
        return found, newest

    folder = str(tmp_path / "job")
    monkeypatch.setattr(carts, "version_step", dies)
    with pytest.raises(Exception, match="lost"):
        carts.version_conflicts(stream, folder)
    assert len(calls) == 2
    assert pairs(carts.version_conflicts(stream, folder), "session_id", "request_id", "current_version") == whole


def test_repeated_and_passed_cart_versions_say_nothing_new(spark, tmp_path):
    schema = "session_id long, version long, cart string"
    batches = [spark.createDataFrame([(1, 1, cart(x=1)), (1, 1, cart(x=1)), (1, 2, cart(x=2))], schema), spark.createDataFrame([(1, 2, cart(x=2)), (1, 1, cart(x=1)), (1, 3, cart(x=2, y=1))], schema)]
    out = carts.cart_changes(stream_of(spark, tmp_path, batches))
    assert pairs(out, "version", "uuid", "qty", "action") == [(1, "x", 1, "added"), (2, "x", 1, "increased"), (3, "y", 1, "added")]


def test_cart_step_over_many_ranges(spark):
    """A busy session over many ranges, with repeated and passed versions, against a plain replay."""
    schema = "session_id long, version long, cart string"
    rows = [(1, 7 + k * 37 % 60, cart(x=1 + k * 5 % 7, **{f"y{k % 3}": 1 + k % 4})) for k in range(60)] + [(s, v, cart(x=v * s)) for s in (2, 3, 4) for v in (2, 1, 3)]
    rows += [(1, 30, cart(z=9)), (1, 30, cart(a=1)), *rows[5:15], (None, 1, cart(n=1)), (None, 2, cart(n=4))]
    held = {1: (20, cart(x=2, y0=2)), 3: (2, cart(x=1)), 4: (9, cart(x=1))}
    told, last = [], {}
    newest = {(s, v): max(t for s2, v2, t in rows if (s2, v2) == (s, v)) for s, v, _ in rows}
    for s in (1, 2, 3, 4, None):
        passed, old = held.get(s, (None, cart()))
        for v in sorted(v for s2, v in newest if s2 == s and (passed is None or v > passed)):
            before = {i["uuid"]: i["qty"] for i in json.loads(old)["items"]}
            old = newest[s, v]
            told += [(s, v, i["uuid"], i["qty"] - before.get(i["uuid"], 0)) for i in json.loads(old)["items"] if i["qty"] > before.get(i["uuid"], 0)]
            last[s] = (s, v, old)
    batch = spark.createDataFrame(rows, schema)
    state = spark.createDataFrame([(s, *x) for s, x in held.items()], schema)
    for parts in (1, 23):
        found, new = carts.cart_step(batch, state, parts)
        assert pairs(found, "session_id", "version", "uuid", "qty") == sorted(told, key=repr)
        assert pairs(new, "session_id", "version", "cart") == sorted(last.values(), key=repr)


@pytest.mark.parametrize("of", ["stream", "batch"])
def test_each_cart_text_is_read_once(spark, monkeypatch, of):
    times = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        times.add(1)
        return text

    real = carts.read_cart
    read = lambda df: real(df.withColumn("cart", counted("cart")))
    monkeypatch.setattr(carts, "read_cart", read)
    batch = spark.createDataFrame([(k % 9, k, cart(x=1 + k % 5)) for k in range(400)], carts.CARTS)
    if of == "stream":
        rows, newest = carts.cart_step(batch, spark.createDataFrame([], carts.CARTS))
        assert newest.count() == 9
    else:
        rows = consecutive_changes(read(batch), "session_id", "version")
    assert rows.count() > 50 and times.value < 450


def test_window_state_lies_in_rocksdb(spark, tmp_path):
    import os

    schema = "session_id long, change_id long, ts timestamp"
    stream = stream_of(spark, tmp_path, [spark.createDataFrame([(1, 1, at(0)), (1, 2, at(5))], schema)])
    before = spark.conf.get(run.PROVIDER)
    run_to_table(events.session_counts(stream, "1 hour"), "rocks").count()
    root = spark.conf.get("spark.checkpoint.dir")
    kept = [f for d, _, names in os.walk(root) if "/state/" in d and "/rocks-" in d for f in names]
    assert any(f.endswith((".zip", ".sst", ".changelog")) for f in kept) and spark.conf.get(run.PROVIDER) == before


def test_a_source_without_files_gives_an_empty_table(spark, tmp_path):
    path = tmp_path / "none"
    path.mkdir()
    schema = spark.createDataFrame([], "session_id long, request_id long, expected_version long").schema
    out = carts.version_conflicts(read_stream(spark, str(path), schema))
    assert out.columns == ["session_id", "request_id", "expected_version", "current_version"] and out.count() == 0
