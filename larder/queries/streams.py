"""Streaming queries: the stored tables replayed as streams, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import materialize, table
from larder.operators.grouping import running_sum
from larder.queries import bindings as b
from larder.queries import ordering
from larder.queries.registry import query
from larder.streaming import carts, events
from larder.streaming.run import as_batches, end_marker, run_to_table

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


#: The files of a replay come in this order, a micro-batch each.
ORDER = [2, 0, 3, 1]


def _shuffled(df: DataFrame, name: str, unique: str) -> tuple[DataFrame, str]:
    """The rows in four micro-batches that mix all times and sessions."""
    return as_batches(df, name, F.col(unique) % 4, ORDER)


def _in_turn(df: DataFrame, name: str, place: str) -> DataFrame:
    """The rows in four micro-batches by ascending ``place``, for logs whose order means something."""
    df = materialize(df, name)
    top = df.agg(F.coalesce(F.max(place), F.lit(0)).alias("m")).scalar()
    return as_batches(df, name, F.floor(F.col(place) * 4 / (top + 1)).cast("long"), [0, 1, 2, 3])[0]


@query(
    b.with_(
        ["req", "change"],
        """SELECT c.session_id, v.version, uuid, name, qty, size, action FROM change c JOIN (
  SELECT request_id, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS version FROM req) v USING (request_id)""",
    )
)
def stream_cart_changes(spark: SparkSession, folder: str) -> DataFrame:
    requests = ordering.cart_events(spark, folder).select("session_id", "request_id", "k", "value")
    numbered = ordering.cart_documents(running_sum(requests, ["session_id"], "request_id", {"version": F.lit(1)}))
    log = _in_turn(numbered.select("session_id", "version", "cart"), "cart-log", "version")
    return carts.cart_changes(log)


@query(
    """WITH e AS (SELECT user_id AS session_id, event_id // 8 AS version, CASE event_id % 4 WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS batch,
  event_id * 2 AS arrival FROM events)
SELECT session_id, version, arrival FROM e
QUALIFY version IS DISTINCT FROM lag(version) OVER (PARTITION BY session_id ORDER BY batch, arrival)"""
)
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives twice and neighbours share a version: an event passes if its version is not the one just held."""
    raw = table(spark, folder, "events").selectExpr("user_id AS session_id", "event_id div 8 AS version", "event_id")
    twice = raw.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).selectExpr("*", "event_id * 2 + copy AS arrival")
    stream, _ = _shuffled(twice, "dedup-log", "event_id")
    return run_to_table(events.new_versions(stream), "dedup")


@query(
    """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS session_id, count(*) AS n_events
FROM events GROUP BY ALL"""
)
def stream_session_counts(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    stream, path = _shuffled(raw, "count-log", "event_id")
    counted = events.session_counts(stream, "6 hours", delay=events.REPLAY)
    counts = run_to_table(counted, "session-counts", end_marker(path, raw.schema, "ts"))
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    """SELECT user_id AS session_id, strftime(ts + INTERVAL 200 MILLISECOND, '%Y-%m-%d %H:%M:%S.%f') AS sent_for, event_id * 10 + 2 AS change_id,
  3 AS n_changes FROM events
UNION ALL SELECT user_id, strftime(ts + INTERVAL 600 MILLISECOND, '%Y-%m-%d %H:%M:%S.%f'), event_id * 10 + 3, 1 FROM events"""
)
def stream_debounce(spark: SparkSession, folder: str) -> DataFrame:
    """Each event is a burst of changes after 0, 100 and 200 ms and a late one after 600 ms; a burst's changes come apart."""
    raw = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("t"))
    bursts = raw.select("session_id", "event_id", "t", F.posexplode(F.array(*[F.lit(m) for m in (0, 100, 200, 600)])).alias("i", "ms"))
    changes = bursts.select(
        "session_id",
        (F.col("event_id") * 10 + F.col("i")).alias("change_id"),
        F.expr("t + make_dt_interval(0, 0, 0, ms / 1000)").alias("ts"),
    )
    stream, path = _shuffled(changes, "change-log", "change_id")
    sent = run_to_table(events.debounced(stream, "change_id", delay=events.REPLAY), "debounce", end_marker(path, changes.schema, "ts"))
    return sent.withColumn("sent_for", F.date_format("sent_for", MICROS))


@query(
    b.with_(
        ["req"],
        """SELECT session_id, request_id, applied AS expected_version, 1 + applied AS current_version FROM (
  SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY session_id ORDER BY request_id) AS applied FROM req)
WHERE event_type = 'error'""",
    )
)
def stream_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that expect the version before the current one ('error' events) must be reported, and only they."""
    asked = table(spark, folder, "events").selectExpr("user_id AS session_id", "event_id AS request_id", "event_type")
    good = F.when(F.col("event_type") == "error", 0).otherwise(1)
    counted = running_sum(asked, ["session_id"], "request_id", {"applied": good})
    # The current version before a request is 1 + earlier good ones; 'applied' counts a good request itself too.
    log = _in_turn(counted.selectExpr("session_id", "request_id", "applied AS expected_version"), "version-log", "request_id")
    return carts.version_conflicts(log)


@query(
    """SELECT o_custkey AS session_id, 'T' || c_nationkey AS table_id, o_orderkey AS order_id,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'preparing' ELSE 'completed' END AS status,
  CASE o_orderstatus WHEN 'O' THEN 'created' ELSE 'updated' END AS action,
  CASE o_orderstatus WHEN 'O' THEN o_totalprice END AS total_amount
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def stream_order_status(spark: SparkSession, folder: str) -> DataFrame:
    stream, _ = _shuffled(table(spark, folder, "orders"), "order-log", "o_orderkey")
    changes = stream.selectExpr(
        "o_custkey AS session_id", "o_orderkey AS order_id",
        "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'preparing' ELSE 'completed' END AS status",
        "IF(o_orderstatus = 'O', 'created', 'updated') AS action", "o_totalprice AS total_amount",
    )
    tables = table(spark, folder, "customer").selectExpr("c_custkey AS session_id", "concat('T', c_nationkey) AS table_id")
    return run_to_table(events.order_status(changes, tables), "order-status")
