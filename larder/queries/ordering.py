"""Order and cart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import materialize, table
from larder.operators import carts, mutate, replay
from larder.operators import orders as ops
from larder.operators.grouping import dense_ids
from larder.queries import bindings as b
from larder.queries.registry import query

# --- order bindings --------------------------------------------------------------------------------------------------

RAW_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"

b.CTE["oitem"] = (
    [],
    f"""SELECT l_orderkey AS order_id, l_orderkey * 8 + l_linenumber AS order_item_id, l_linenumber AS line_no,
  min(l_partkey) AS dish_id, CAST(sum(l_quantity) AS BIGINT) AS quantity, max({RAW_PRICE}) AS unit_price
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
b.CTE["totals"] = (
    ["oitem"],
    "SELECT order_id, sum(round(round(unit_price, 2) * quantity, 2)) AS total_amount, sum(quantity) AS item_count, "
    "count(*) AS n_lines FROM oitem GROUP BY order_id",
)


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with one row per order and line number."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.expr(RAW_PRICE).alias("p"))
    return lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("dish_id"), F.sum("l_quantity").cast("long").alias("quantity"), F.max("p").alias("unit_price")
    ).select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_linenumber").alias("line_no"),
        "dish_id",
        F.concat(F.lit("dish "), "dish_id").alias("name"),
        "quantity",
        "unit_price",
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("session_id"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'preparing' ELSE 'completed' END").alias("status"),
        F.col("o_orderpriority").alias("note"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
        F.col("o_orderdate").alias("created_at"),
    )


b.CTE["ord"] = (
    [],
    """SELECT o_orderkey AS order_id, o_custkey AS session_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'preparing'
  ELSE 'completed' END AS status, o_orderpriority AS note, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
  o_orderdate AS created_at FROM orders""",
)


@query(
    f"""SELECT l_orderkey AS order_id, CAST(sum(round(round({RAW_PRICE}, 2) * CAST(l_quantity AS BIGINT), 2)) AS DOUBLE) AS total_amount,
  CAST(sum(l_quantity) AS BIGINT) AS item_count, count(*) AS n_lines FROM lineitem GROUP BY 1"""
)
def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.expr(RAW_PRICE).alias("unit_price"), F.col("l_quantity").cast("long").alias("quantity")
    )
    return ops.order_totals(lines)


@query(
    b.with_(
        ["ord"],
        """SELECT order_id, session_id, status, note, CAST(total_amount AS DOUBLE) AS total_amount,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  CAST(coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = order_id), 0) AS BIGINT) AS item_count
FROM (SELECT * FROM ord ORDER BY created_at DESC, order_id DESC LIMIT 100)""",
    )
)
def recent_orders(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("quantity")
    )
    return ops.recent_orders(orders(spark, folder), lines)


@query(
    b.with_(
        ["ord", "oitem"],
        """SELECT order_id, session_id, status, note, CAST(total_amount AS DOUBLE) AS total_amount,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, order_item_id, 'dish ' || dish_id AS name, quantity,
  CAST(round(unit_price, 2) AS DOUBLE) AS unit_price, CAST(round(round(unit_price, 2) * quantity, 2) AS DOUBLE) AS line_total
FROM ord LEFT JOIN oitem USING (order_id)""",
    )
)
def session_history(spark: SparkSession, folder: str) -> DataFrame:
    return ops.session_history(orders(spark, folder), order_items(spark, folder))


@query(
    b.with_(
        ["ord", "totals"],
        """SELECT r.event_id AS request_id, r.event_id * 2 AS order_id, session_id, status, CAST(t.total_amount AS DOUBLE) AS total_amount,
  CAST(t.item_count AS BIGINT) AS item_count, CASE WHEN ord.order_id IS NULL THEN 'order_not_found' END AS error
FROM events r LEFT JOIN ord ON ord.order_id = r.event_id * 2 LEFT JOIN totals t ON t.order_id = ord.order_id""",
    )
)
def order_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Order details for a table of requested ids, many of them unknown."""
    asked = table(spark, folder, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") * 2).alias("order_id"))
    totals = ops.order_totals(order_items(spark, folder)).drop("n_lines")
    details = orders(spark, folder).select("order_id", "session_id", "status").join(totals, "order_id", "left")
    return ops.lookup(asked, details, "order_id", "order_not_found")


PATCH_SQL = """SELECT order_id, order_item_id + CASE WHEN order_id % 23 = 0 THEN 1000000007 ELSE 0 END AS order_item_id, {null_id} AS dish_id,
  CASE WHEN line_no = 2 THEN 'renamed' END AS name,
  CASE WHEN line_no = 1 THEN 0 WHEN line_no = 2 THEN quantity + 1 END AS quantity,
  CASE WHEN line_no = 3 THEN CAST(12.345 AS DECIMAL(18,4)) END AS unit_price FROM oitem WHERE line_no <= 3 AND order_id % 4 <> 1
UNION ALL SELECT order_id, NULL, NULL, CASE WHEN order_id % 29 = 0 THEN NULL ELSE 'extra' END, 3, CAST(50.005 AS DECIMAL(18,4))
FROM ord WHERE order_id % 6 = 0"""
b.CTE["patch"] = (["oitem", "ord"], PATCH_SQL.format(null_id="CAST(NULL AS BIGINT)"))
b.CTE["edit"] = (
    ["ord"],
    """SELECT order_id + CASE WHEN order_id % 31 = 0 THEN 2000000011 ELSE 0 END AS order_id,
  CASE WHEN order_id % 37 = 0 THEN 'eaten' WHEN order_id % 2 = 0 THEN 'ready' END AS status,
  CASE WHEN order_id % 3 = 0 THEN 'edited' END AS note FROM ord WHERE order_id % 5 = 0""",
)


@query(
    b.with_(
        ["patch", "edit", "ord", "oitem"],
        """SELECT o.order_id, CASE WHEN e.order_id IS NULL THEN coalesce(d.status, o.status) ELSE o.status END AS status,
  CASE WHEN e.order_id IS NULL THEN coalesce(d.note, o.note) ELSE o.note END AS note,
  CAST(CASE WHEN e.order_id IS NULL AND p.order_id IS NOT NULL THEN coalesce(n.total, 0) ELSE o.total_amount END AS DOUBLE) AS total_amount,
  e.error
FROM ord o LEFT JOIN errs e USING (order_id) LEFT JOIN edit d USING (order_id)
LEFT JOIN (SELECT DISTINCT order_id FROM patch) p USING (order_id)
LEFT JOIN (SELECT order_id, sum(round(price * qty, 2)) AS total FROM newitem GROUP BY 1) n USING (order_id)""",
        errs="""SELECT order_id, min_by(error, no) AS error FROM (
  SELECT order_id, 1 AS no, 'order_not_found' AS error FROM edit WHERE order_id NOT IN (SELECT order_id FROM ord)
  UNION ALL SELECT order_id, 2, 'invalid_status: eaten' FROM edit WHERE status = 'eaten'
  UNION ALL SELECT order_id, 3, 'order_item_not_found' FROM patch WHERE order_item_id IS NOT NULL
    AND order_item_id NOT IN (SELECT order_item_id FROM oitem)
  UNION ALL SELECT order_id, 4, 'order_item_missing_fields' FROM patch WHERE order_item_id IS NULL AND name IS NULL)
GROUP BY order_id""",
        good="SELECT * FROM patch ANTI JOIN errs USING (order_id)",
        newitem="""SELECT o.order_id, round(coalesce(g.unit_price, o.unit_price), 2) AS price, coalesce(g.quantity, o.quantity) AS qty
FROM oitem o LEFT JOIN good g ON g.order_item_id = o.order_item_id WHERE coalesce(g.quantity, 1) > 0
UNION ALL SELECT order_id, round(unit_price, 2), quantity FROM good WHERE order_item_id IS NULL""",
    )
)
def order_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Edits and item patches over all orders; some name unknown orders, items or states."""
    return _edited(spark, folder)[0]


@query(
    b.with_(
        ["patch", "edit", "ord", "oitem"],
        """SELECT o.order_id, o.order_item_id, o.dish_id, coalesce(g.name, 'dish ' || o.dish_id) AS name,
  CASE WHEN g.order_item_id IS NOT NULL AND line_no = 2 THEN 'XL' WHEN line_no % 2 = 0 THEN 'L' END AS size_label,
  CASE WHEN g.order_item_id IS NOT NULL AND line_no = 3 THEN 'hot' WHEN line_no = 3 THEN 'cold' END AS note,
  CASE WHEN g.order_item_id IS NOT NULL AND line_no = 2 THEN '{"spice":1}' END AS extra_data,
  coalesce(g.quantity, o.quantity) AS quantity, CAST(round(coalesce(g.unit_price, o.unit_price), 2) AS DOUBLE) AS unit_price
FROM oitem o LEFT JOIN good g ON g.order_item_id = o.order_item_id WHERE coalesce(g.quantity, 1) > 0
UNION ALL SELECT order_id, NULL, NULL, name, 'S', NULL, NULL, quantity, CAST(round(unit_price, 2) AS DOUBLE) FROM good WHERE order_item_id IS NULL""",
        errs="""SELECT DISTINCT order_id FROM (
  SELECT order_id FROM edit WHERE order_id NOT IN (SELECT order_id FROM ord) OR status = 'eaten'
  UNION ALL SELECT order_id FROM patch WHERE order_item_id IS NOT NULL AND order_item_id NOT IN (SELECT order_item_id FROM oitem)
  UNION ALL SELECT order_id FROM patch WHERE order_item_id IS NULL AND name IS NULL)""",
        good="SELECT * FROM patch ANTI JOIN errs USING (order_id)",
    )
)
def order_edit_items(spark: SparkSession, folder: str) -> DataFrame:
    """The item rows after the same edits, with size, note and further data."""
    return _edited(spark, folder)[1]


def _edited(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    head, items = orders(spark, folder), materialize(order_items(spark, folder), "order-items")
    items = items.withColumns(
        {
            "size_label": F.expr("IF(line_no % 2 = 0, 'L', NULL)"),
            "note": F.expr("IF(line_no = 3, 'cold', NULL)"),
            "extra_data": F.lit(None).cast("string"),
        }
    )
    changed = items.filter("line_no <= 3 and order_id % 4 <> 1").selectExpr(
        "order_id",
        "order_item_id + IF(order_id % 23 = 0, 1000000007, 0) AS order_item_id",
        "CAST(NULL AS BIGINT) AS dish_id",
        "IF(line_no = 2, 'renamed', NULL) AS name",
        "IF(line_no = 2, 'XL', NULL) AS size_label",
        "IF(line_no = 3, 'hot', NULL) AS note",
        "IF(line_no = 2, '{\"spice\":1}', NULL) AS extra_data",
        "CASE WHEN line_no = 1 THEN 0 WHEN line_no = 2 THEN quantity + 1 END AS quantity",
        "IF(line_no = 3, CAST(12.345 AS DECIMAL(18,4)), NULL) AS unit_price",
    )
    added = head.filter("order_id % 6 = 0").selectExpr(
        "order_id",
        "CAST(NULL AS BIGINT) AS order_item_id",
        "CAST(NULL AS BIGINT) AS dish_id",
        "IF(order_id % 29 = 0, NULL, 'extra') AS name",
        "'S' AS size_label",
        "CAST(NULL AS STRING) AS note",
        "CAST(NULL AS STRING) AS extra_data",
        "3L AS quantity",
        "CAST(50.005 AS DECIMAL(18,4)) AS unit_price",
    )
    edits = head.filter("order_id % 5 = 0").selectExpr(
        "order_id + IF(order_id % 31 = 0, 2000000011, 0) AS order_id",
        "CASE WHEN order_id % 37 = 0 THEN 'eaten' WHEN order_id % 2 = 0 THEN 'ready' END AS status",
        "IF(order_id % 3 = 0, 'edited', NULL) AS note",
    )
    return ops.edit_orders(head, items.drop("line_no"), edits, changed.unionByName(added))


# --- cart bindings ---------------------------------------------------------------------------------------------------


def cart_events(spark: SparkSession, folder: str) -> DataFrame:
    """What the cart documents are made of."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("request_id"),
        "ts",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def cart_documents(events: DataFrame) -> DataFrame:
    """One cart document per event: two valid items and a broken one; every tenth cart only holds the broken one."""
    first = F.expr(
        """format_string('{"id":%d,"name":"dish %d","qty":%d,"price":%s,"size":%s,"note":null,"uuid":"a%d"},'
           '{"id":%d,"name":"side","qty":%d,"price":"10.005","size":null,"note":"hot","uuid":"b%d"},',
           k % 5, k % 5, 1 + request_id % 3, CAST(CAST(value AS DECIMAL(12,2)) AS STRING), IF(k % 2 = 0, 'null', '"L"'), k % 5,
           10000000000 + (k div 5) % 4, 1 + k % 4, (k div 5) % 4)"""
    )
    broken = F.expr(
        """CASE request_id % 4 WHEN 0 THEN '{"id":"x","qty":1,"price":1}' WHEN 1 THEN '{"id":7,"qty":0,"price":1}'
           WHEN 2 THEN '{"id":7,"qty":1,"price":-1}' ELSE '{"id":7,"qty":"two","price":1}' END"""
    )
    items = F.when(F.col("request_id") % 10 == 0, broken).otherwise(F.concat(first, broken))
    cart = F.concat(F.lit('{"items":['), items, F.lit('],"note":"n'), F.col("k"), F.lit('"}'))
    return events.withColumn("cart", cart)


def cart_requests(spark: SparkSession, folder: str) -> DataFrame:
    return carts.read_cart(cart_documents(cart_events(spark, folder)))


b.CTE["req"] = (
    [],
    """SELECT user_id AS session_id, event_id AS request_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""",
)
b.CTE["citem"] = (
    ["req"],
    """SELECT session_id, request_id, k % 5 AS id, 'dish ' || (k % 5) AS name, 1 + request_id % 3 AS qty, CAST(value AS DECIMAL(18,2)) AS price,
  CASE WHEN k % 2 = 0 THEN NULL ELSE 'L' END AS size, NULL AS note, 'a' || (k % 5) AS uuid FROM req WHERE request_id % 10 <> 0
UNION ALL SELECT session_id, request_id, 10000000000 + (k // 5) % 4, 'side', 1 + k % 4, CAST(10.01 AS DECIMAL(18,2)), NULL, 'hot',
  'b' || ((k // 5) % 4) FROM req WHERE request_id % 10 <> 0""",
)


@query(b.with_(["citem"], "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM citem"))
def cart_items_clean(spark: SparkSession, folder: str) -> DataFrame:
    return carts.cart_items(cart_requests(spark, folder), ["session_id", "request_id"]).drop("image_url")


@query(
    b.with_(
        ["req", "citem"],
        """SELECT session_id, request_id, 'n' || k AS cart_note,
  CASE WHEN request_id % 10 = 0 THEN 0 ELSE 2 + request_id % 3 + k % 4 END
    + CASE request_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS cart_size
FROM req QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY request_id DESC) = 1""",
    )
)
def cart_size(spark: SparkSession, folder: str) -> DataFrame:
    """Stored quantity and note of each session's latest cart."""
    latest = carts.latest_carts(cart_requests(spark, folder), "session_id", "request_id")
    return latest.select("session_id", "request_id", "cart_note", carts.cart_size(F.col("raw_items")).alias("cart_size"))


@query(
    b.with_(
        ["req", "citem"],
        """SELECT r.request_id, CAST(coalesce(sum(price * qty), 0) AS DOUBLE) AS total_price, CAST(coalesce(sum(qty), 0) AS BIGINT) AS item_count
FROM req r LEFT JOIN citem c ON c.request_id = r.request_id GROUP BY 1""",
    )
)
def cart_totals(spark: SparkSession, folder: str) -> DataFrame:
    held = cart_requests(spark, folder).select("request_id", carts.clean_items(F.col("raw_items")).alias("items"))
    return held.select(
        "request_id", carts.cart_total(F.col("items")).alias("total_price"), carts.cart_quantity(F.col("items")).alias("item_count")
    )


b.CTE["change"] = (
    ["req", "citem"],
    """SELECT n.session_id, n.request_id, n.uuid, n.name, n.qty - coalesce(o.qty, 0) AS qty, n.size,
  CASE WHEN o.qty IS NULL THEN 'added' ELSE 'increased' END AS action
FROM citem n JOIN (SELECT request_id, lag(request_id) OVER (PARTITION BY session_id ORDER BY request_id) AS before FROM req) p
  ON p.request_id = n.request_id
LEFT JOIN citem o ON o.request_id = p.before AND o.uuid = n.uuid
WHERE o.qty IS NULL OR n.qty > o.qty""",
)


@query(b.with_(["change"], "SELECT * FROM change"))
def cart_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Items added or increased from each cart to the next of its session."""
    return carts.consecutive_changes(cart_requests(spark, folder), "session_id", "request_id")


@query(
    b.with_(
        ["oitem"],
        """SELECT l.order_id, id, size, CAST(NULL AS VARCHAR) AS note, CAST(1 AS DOUBLE) AS price, uuid,
  CAST(list_reduce(list_prepend([CAST(first_qty AS BIGINT), -1], coalesce(steps, [])), lambda a, s: [greatest(a[1] + s[1], s[2]), -1])[1] AS BIGINT) AS qty
FROM slots l LEFT JOIN (
  SELECT order_id, slot, list([add_qty, floor_qty] ORDER BY pos) AS steps FROM placed GROUP BY ALL) p USING (order_id, slot)""",
        server="""SELECT order_id, line_no AS pos, 'u' || line_no AS uuid, dish_id % 2 AS id,
  CASE WHEN line_no % 2 = 0 THEN 'L' END AS size, quantity AS qty FROM oitem WHERE line_no <= 4""",
        pending="""SELECT order_id, line_no AS pos, 'u' || line_no AS uuid, dish_id % 3 AS id,
  CASE WHEN line_no % 2 = 0 THEN 'L' END AS size, quantity + dish_id % 3 - 1 AS qty FROM oitem WHERE line_no >= 3""",
        targeted="""SELECT p.*, coalesce(s.pos, f.first_pos) AS server_pos, s.pos IS NOT NULL AS by_uuid
FROM pending p LEFT JOIN server s ON s.order_id = p.order_id AND s.uuid = p.uuid
LEFT JOIN (SELECT order_id, id, size, min(pos) AS first_pos FROM server GROUP BY ALL) f
  ON f.order_id = p.order_id AND f.id = p.id AND f.size IS NOT DISTINCT FROM p.size""",
        fresh="""SELECT *, min(pos) OVER (PARTITION BY order_id, id, size) AS opener FROM targeted WHERE server_pos IS NULL""",
        slots="""SELECT order_id, pos AS slot, id, size, uuid, qty AS first_qty FROM server
UNION ALL SELECT order_id, 100 + pos, id, size, uuid, qty FROM fresh WHERE pos = opener""",
        placed="""SELECT order_id, server_pos AS slot, pos, CASE WHEN by_uuid THEN 0 ELSE qty END AS add_qty,
  CASE WHEN by_uuid THEN qty ELSE -1000000 END AS floor_qty FROM targeted WHERE server_pos IS NOT NULL
UNION ALL SELECT order_id, 100 + opener, pos, qty, -1000000 FROM fresh WHERE pos > opener""",
    )
)
def cart_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Merge a pending cart into the server cart of every order."""
    items = materialize(order_items(spark, folder), "order-items")
    shape = "IF(line_no % 2 = 0, 'L', NULL) AS size", "CAST(NULL AS STRING) AS note", "1.0D AS price"
    server = items.filter("line_no <= 4").selectExpr(
        "order_id", "CAST(line_no AS BIGINT) AS pos", "concat('u', line_no) AS uuid", "dish_id % 2 AS id", *shape, "quantity AS qty"
    )
    pending = items.filter("line_no >= 3").selectExpr(
        "order_id", "CAST(line_no AS BIGINT) AS pos", "concat('u', line_no) AS uuid", "dish_id % 3 AS id", *shape,
        "quantity + dish_id % 3 - 1 AS qty",
    )
    return carts.merge_carts(server, pending, "order_id")


OP_SQL = """CASE WHEN event_type = 'view' THEN 'add' WHEN event_type = 'click' THEN 'delta' WHEN event_type = 'error' THEN 'remove'
  WHEN event_type = 'signup' THEN 'note' WHEN k % 40 = 0 THEN 'clear' ELSE 'add' END"""
b.CTE["op"] = (
    ["req"],
    f"""SELECT session_id, request_id, {OP_SQL} AS op, k % 6 AS id, CASE WHEN k % 2 = 0 THEN 'L' END AS size,
  CAST(10 + k % 6 AS DOUBLE) AS price, CASE WHEN event_type = 'click' THEN k % 7 - 4 ELSE 1 + k % 3 END AS qty, 'n' || k AS text FROM req""",
)


@query(
    b.with_(
        ["op"],
        """SELECT session_id, id, size, CAST(NULL AS VARCHAR) AS note, price, qty, coalesce(n.cart_note, '') AS cart_note FROM (
  SELECT session_id, id, size, price, CAST(list_reduce(list([qty, lowest] ORDER BY request_id),
    lambda a, s: [greatest(a[1] + s[1], s[2]), -1000000])[1] AS BIGINT) AS qty
  FROM (SELECT *, CASE op WHEN 'delta' THEN 1 ELSE -1000000 END AS lowest,
          min(request_id) FILTER (WHERE op = 'add') OVER (PARTITION BY session_id, id, size) AS opener FROM live)
  WHERE request_id >= opener GROUP BY session_id, id, size, price)
LEFT JOIN (SELECT session_id, max_by(CASE op WHEN 'note' THEN text ELSE '' END, request_id) AS cart_note
           FROM op WHERE op IN ('note', 'clear') GROUP BY 1) n USING (session_id)""",
        cleared="SELECT session_id, max(request_id) AS at FROM op WHERE op = 'clear' GROUP BY 1",
        removed="SELECT session_id, id, size, max(request_id) AS at FROM op WHERE op = 'remove' GROUP BY ALL",
        live="""SELECT o.* FROM op o LEFT JOIN cleared c USING (session_id)
LEFT JOIN removed r ON r.session_id = o.session_id AND r.id = o.id AND r.size IS NOT DISTINCT FROM o.size
WHERE op IN ('add', 'delta') AND request_id > coalesce(c.at, -1) AND request_id > coalesce(r.at, -1)""",
    )
)
def cart_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Every session's cart after folding all its operations."""
    requests = cart_requests(spark, folder)
    done = requests.selectExpr(
        "session_id", "request_id", f"{OP_SQL} AS op", "k % 6 AS id", "IF(k % 2 = 0, 'L', NULL) AS size",
        "CAST(NULL AS STRING) AS note", "CAST(10 + k % 6 AS DOUBLE) AS price",
        "IF(event_type = 'click', k % 7 - 4, 1 + k % 3) AS qty", "concat('n', k) AS text",
    )
    lines = carts.fold_operations(done, "session_id", "request_id")
    notes = carts.fold_notes(done, "session_id", "request_id")
    return lines.join(notes, "session_id", "left").withColumn("cart_note", F.coalesce("cart_note", F.lit("")))


@query(
    b.with_(["req"], "SELECT 1").rsplit("SELECT 1", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1)
    + """, asked AS (
  SELECT session_id, request_id, CASE WHEN k % 10 = 0 THEN NULL ELSE k % 5 END AS expected,
    row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS n FROM req),
replay AS (
  SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS expected, false AS applied,
    CAST(1 + session_id % 3 AS BIGINT) AS version FROM asked WHERE n = 1
  UNION ALL
  SELECT a.session_id, a.n, a.request_id, a.expected, a.expected IS NULL OR a.expected = r.version,
    r.version + CASE WHEN a.expected IS NULL OR a.expected = r.version THEN 1 ELSE 0 END
  FROM replay r JOIN asked a ON a.session_id = r.session_id AND a.n = r.n + 1)
SELECT session_id, request_id, expected AS expected_version, applied, version AS current_version FROM replay WHERE n > 0"""
)
def versioned_replace(spark: SparkSession, folder: str) -> DataFrame:
    """All cart requests of a session race for its current version."""
    asked = cart_requests(spark, folder).selectExpr(
        "session_id", "request_id", "IF(k % 10 = 0, NULL, k % 5) AS expected_version"
    )
    state = asked.groupBy("session_id").agg(F.lit(1).alias("one")).selectExpr("session_id", "1 + session_id % 3 AS version")
    return replay.versioned_replace(state, asked, "session_id")


@query(
    b.with_(
        ["req", "citem"],
        """SELECT r.request_id, r.session_id, 'T' || c_nationkey AS table_id, CASE WHEN n > 0 THEN 'pending' END AS status,
  CAST(t.total AS DOUBLE) AS total_amount, coalesce(n, 0) AS n_lines, coalesce(n_unknown, 0) AS n_unknown_dishes,
  CASE WHEN n > 0 THEN 'n' || k END AS note,
  CASE WHEN n > 0 THEN NULL WHEN r.session_id IN (SELECT o_custkey FROM orders)
         OR r.request_id > (SELECT min(request_id) FROM citem c WHERE c.session_id = r.session_id) THEN 'cannot_submit_empty_cart_after_order'
       ELSE 'cart_empty' END AS error
FROM req r LEFT JOIN customer ON c_custkey = r.session_id
LEFT JOIN (SELECT request_id, sum(round(price * qty, 2)) AS total, count(*) AS n,
             count(*) FILTER (WHERE id NOT IN (SELECT p_partkey FROM part)) AS n_unknown FROM citem GROUP BY 1) t USING (request_id)""",
    )
)
def cart_checkout(spark: SparkSession, folder: str) -> DataFrame:
    """Every cart document sent to checkout."""
    tables = table(spark, folder, "customer").selectExpr("c_custkey AS session_id", "concat('T', c_nationkey) AS table_id")
    requests = cart_requests(spark, folder).join(tables, "session_id", "left")
    dishes = table(spark, folder, "part").select(F.col("p_partkey").alias("dish_id"))
    return carts.checkout(requests, "session_id", "request_id", dishes, orders(spark, folder))


@query(
    b.with_(
        ["req", "citem"],
        """SELECT request_id, CASE WHEN id IN (SELECT p_partkey FROM part) THEN id END AS dish_id, name, size AS size_label, note, qty AS quantity,
  CAST(round(price, 2) AS DOUBLE) AS unit_price, CAST(round(price * qty, 2) AS DOUBLE) AS line_total FROM citem""",
    )
)
def checkout_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines that these checkouts write."""
    dishes = table(spark, folder, "part").select(F.col("p_partkey").alias("dish_id"))
    return carts.order_lines(cart_requests(spark, folder), ["request_id"], dishes)


@query(
    b.with_(
        ["req", "citem"],
        """SELECT r.request_id, r.session_id, 'T' || c_nationkey AS table_id, CASE WHEN n > 0 THEN 'pending' END AS status,
  CAST(t.total AS DOUBLE) AS total_amount, coalesce(n, 0) AS n_lines, CASE WHEN n > 0 THEN 'n' || k END AS note, lines,
  CASE WHEN n > 0 THEN NULL WHEN r.session_id IN (SELECT o_custkey FROM orders)
         OR r.request_id > (SELECT min(request_id) FROM citem c WHERE c.session_id = r.session_id) THEN 'cannot_submit_empty_cart_after_order'
       ELSE 'cart_empty' END AS error,
  CASE WHEN n > 0 THEN '' ELSE 'n' || k END AS cart_note, CASE WHEN n > 0 THEN 0 ELSE 1 END AS n_cart_items, 7 + CASE WHEN n > 0 THEN 1 ELSE 0 END AS version
FROM req r LEFT JOIN customer ON c_custkey = r.session_id
LEFT JOIN (SELECT request_id, sum(round(price * qty, 2)) AS total, count(*) AS n, string_agg(
    coalesce(CAST(CASE WHEN id IN (SELECT p_partkey FROM part) THEN id END AS VARCHAR), '-') || '|' || name || '|' || coalesce(size, '-') || '|' || coalesce(note, '-')
    || '|' || qty || '|' || printf('%.2f', CAST(price AS DOUBLE)) || '|' || printf('%.2f', CAST(round(price * qty, 2) AS DOUBLE)) || '|{"uuid":"' || uuid || '"}',
    ';' ORDER BY uuid) AS lines FROM citem GROUP BY 1) t USING (request_id)""",
    )
)
def checkout_result(spark: SparkSession, folder: str) -> DataFrame:
    """Every cart document sent to checkout: order, lines, and the cart and version it leaves."""
    tables = table(spark, folder, "customer").selectExpr("c_custkey AS session_id", "concat('T', c_nationkey) AS table_id")
    requests = cart_requests(spark, folder).join(tables, "session_id", "left").withColumn("version", F.lit(7))
    dishes = table(spark, folder, "part").select(F.col("p_partkey").alias("dish_id"))
    placed = carts.place_orders(requests, "session_id", "request_id", "version", dishes, orders(spark, folder))
    money = lambda c: F.format_string("%.2f", c.cast("double"))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    told = F.transform(
        "lines",
        lambda x: F.concat_ws(
            "|", dash(x["dish_id"]), x["name"], dash(x["size_label"]), dash(x["note"]), x["quantity"].cast("string"), money(x["unit_price"]),
            money(x["line_total"]), x["extra_data"],
        ),
    )
    left = carts.read_cart(placed.withColumn("lines", F.array_join(told, ";")))
    columns = ["request_id", "session_id", "table_id", "status", "total_amount", "n_lines", "note", "lines", "error", "version", "cart_note"]
    return left.select(*columns, F.size("raw_items").alias("n_cart_items"))


@query(
    b.with_(
        ["req", "citem"],
        """SELECT session_id, request_id, '{"items":[' || coalesce(items, '') || '],"note":"n' || k || '"}' AS snapshot FROM req LEFT JOIN (
  SELECT request_id, string_agg('{"id":' || id || ',"name":"' || name || '","qty":' || qty || ',"price":' || CAST(CAST(price AS DOUBLE) AS VARCHAR) || ',"note":'
    || coalesce('"' || note || '"', 'null') || ',"size":' || coalesce('"' || size || '"', 'null') || '}', ',' ORDER BY uuid) AS items
  FROM citem GROUP BY 1) USING (request_id)
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY request_id DESC) = 1""",
    )
)
def cart_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The document that an order of each session's latest cart would store."""
    latest = carts.latest_carts(cart_requests(spark, folder), "session_id", "request_id")
    text = carts.snapshot(carts.clean_items(F.col("raw_items")), F.col("cart_note"))
    return latest.select("session_id", "request_id", text.alias("snapshot"))


@query(
    b.with_(
        ["req", "citem"],
        """SELECT session_id, request_id + CASE WHEN session_id % 3 = 1 THEN 1 ELSE 0 END AS version,
  CASE WHEN session_id % 3 = 1 OR request_id % 10 = 0 THEN 0 ELSE 2 END AS n_items, CASE WHEN session_id % 3 = 1 THEN '' ELSE 'n' || k END AS cart_note
FROM req WHERE session_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY request_id DESC) = 1""",
    )
)
def delete_and_clear(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions after deleting a third of them and clearing the carts of another third."""
    latest = carts.latest_carts(cart_requests(spark, folder), "session_id", "request_id")
    sessions = latest.selectExpr("session_id", "request_id AS version", "cart")
    kept = mutate.delete_keys(sessions, sessions.filter("session_id % 3 = 0"), ["session_id"])
    cleared = carts.clear_carts(kept, kept.filter("session_id % 3 = 1"), "session_id")
    read = carts.read_cart(cleared)
    return read.select("session_id", "version", F.size(carts.clean_items(F.col("raw_items"))).alias("n_items"), "cart_note")


@query(
    """SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS session_id, o_totalprice AS total
FROM orders"""
)
def fk_null_out(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of unknown sessions keep their row and lose the reference."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey AS order_id", "o_custkey AS session_id", "o_totalprice AS total")
    known = table(spark, folder, "customer").filter("c_custkey % 5 <> 0")
    return mutate.null_out(rows, known, "session_id", "c_custkey")


@query(
    """SELECT 'orders' AS table_name, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM orders WHERE o_custkey % 4 <> 0
UNION ALL SELECT 'items', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 4 <> 0
UNION ALL SELECT 'items without order', count(*), CAST(0 AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Delete the orders of a quarter of the customers together with their items."""
    head = table(spark, folder, "orders").selectExpr("o_orderkey AS order_id", "o_custkey")
    items = table(spark, folder, "lineitem").selectExpr("l_orderkey AS order_id")
    left = mutate.cascade_delete(head, head.filter("o_custkey % 4 = 0"), "order_id", items=items)
    orphans = items.join(head, "order_id", "left_anti")

    def line(df: DataFrame, name: str, total) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("long").alias("id_sum")).select(F.lit(name).alias("table_name"), "*")

    return (
        line(left["parents"], "orders", F.sum("order_id"))
        .unionByName(line(left["items"], "items", F.sum("order_id")))
        .unionByName(line(orphans, "items without order", F.coalesce(F.sum(F.lit(0)), F.lit(0))))
    )


@query(
    """SELECT row_number() OVER (ORDER BY md5(o_custkey || chr(1) || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), o_custkey, o_orderdate) + 1000000
  AS visit_id, o_custkey AS session_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS visit_date, n_orders
FROM (SELECT o_custkey, o_orderdate, count(*) AS n_orders FROM orders GROUP BY ALL)"""
)
def numbered_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Surrogate ids for customer visits, dense and the same in every run."""
    visits = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("session_id"), F.col("o_orderdate").cast("date").alias("visit_date")
    ).agg(F.count(F.lit(1)).alias("n_orders"))
    return dense_ids(visits, ["session_id", "visit_date"], "visit_id", 1_000_001)


@query(
    """SELECT c_custkey AS session_id, c_name AS name, c_mktsegment AS note, o_orderkey AS order_id, o_orderstatus AS status
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
AND contains(lower(c_name || ' ' || c_mktsegment || ' ' || o_orderkey), 'build')"""
)
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in one state whose customer, segment or number contains a word."""
    from larder.functions.text import keyword_match

    people = table(spark, folder, "customer").selectExpr("c_custkey AS session_id", "c_name AS name", "c_mktsegment AS note")
    head = table(spark, folder, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "o_custkey AS session_id", "o_orderkey AS order_id", "o_orderstatus AS status"
    )
    match = keyword_match([F.col("name"), F.col("note"), F.col("order_id").cast("string")], " BUILD ")
    return people.join(head, "session_id").filter(match).select("session_id", "name", "note", "order_id", "status")
