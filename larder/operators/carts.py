"""Shared carts: JSON documents, differences between versions, merging, and folding of cart operations.

A cart is one JSON document, so everything about a single cart is done with array functions inside its row. Only work
that crosses carts shuffles, and then by request or by cart line, never by a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.functions.money import cents, line_total
from larder.operators.grouping import first_per_key, fold_add_floor, previous_row, running_sum

# Numbers are read as text, so that a bad one spoils its item and not the document.
CART_JSON = (
    "items array<struct<id string, name string, qty string, price string, size string, note string, uuid string, "
    "image_url string>>, note string"
)
LINE = ["id", "size", "note", "price"]
EMPTY_CART = '{"items":[],"note":""}'


def read_cart(df: DataFrame, column: str = "cart") -> DataFrame:
    """Add ``raw_items`` and ``cart_note``; anything that is not a cart document is an empty cart."""
    doc = F.from_json(F.col(column), CART_JSON)
    return df.withColumns(
        {
            "raw_items": F.coalesce(doc["items"], F.from_json(F.lit('{"items":[]}'), CART_JSON)["items"]),
            "cart_note": F.coalesce(doc["note"], F.lit("")),
        }
    )


def clean_items(raw: Column) -> Column:
    """Valid items with proper types: whole id, whole quantity above 0 ("1.5" is none), price of at least 0 in cents; the rest is
    dropped. A missing price is 0, a missing uuid stays NULL."""

    def whole(c: Column) -> Column:
        return F.when(c.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), c.try_cast("double").try_cast("long"))

    typed = F.transform(
        raw,
        lambda i: F.struct(
            whole(i["id"]).alias("id"),
            F.coalesce(i["name"], F.lit("")).alias("name"),
            whole(i["qty"]).alias("qty"),
            F.round(F.coalesce(i["price"], F.lit("0")).try_cast("decimal(24,8)"), 2).cast("decimal(18,2)").alias("price"),
            i["size"].alias("size"),
            i["note"].alias("note"),
            i["uuid"].alias("uuid"),
            i["image_url"].alias("image_url"),
        ),
    )
    return F.filter(typed, lambda i: i["id"].isNotNull() & (i["qty"] > 0) & (i["price"] >= 0))


def cart_items(carts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per valid item."""
    return carts.select(*keep, F.inline(clean_items(F.col("raw_items"))))


def cart_size(raw: Column) -> Column:
    """Sum of the stored quantities, unreadable ones counting as none."""
    quantities = F.transform(raw, lambda i: F.coalesce(i["qty"].try_cast("double").try_cast("long"), F.lit(0)))
    return F.aggregate(quantities, F.lit(0).cast("long"), lambda a, q: a + q)


def cart_total(items: Column) -> Column:
    """Sum of price x quantity of clean items."""
    start = F.lit(0).cast("decimal(38,2)")
    return F.aggregate(
        items, start, lambda a, i: (a + i["price"] * i["qty"].cast("decimal(12,0)")).cast("decimal(38,2)")
    )


def cart_quantity(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, i: a + i["qty"])


def changes(new: Column, old: Column) -> Column:
    """What a new cart adds to an old one, by item uuid: unseen items, and the part by which quantities grew.

    In each cart the last item of a uuid counts; items without one share the missing uuid.
    """
    before = F.coalesce(old, F.filter(new, lambda i: F.lit(False)))
    new = F.filter(new, lambda i, at: ~F.exists(F.slice(new, at + 2, F.size(new)), lambda o: o["uuid"].eqNullSafe(i["uuid"])))

    def old_quantity(i: Column) -> Column:
        same = F.filter(before, lambda o: o["uuid"].eqNullSafe(i["uuid"]))
        return F.when(F.size(same) > 0, F.element_at(same, -1)["qty"])

    marked = F.transform(new, lambda i: F.struct(i.alias("item"), old_quantity(i).alias("old_qty")))
    grown = F.filter(marked, lambda m: m["old_qty"].isNull() | (m["item"]["qty"] > m["old_qty"]))
    return F.transform(
        grown,
        lambda m: F.struct(
            m["item"]["uuid"].alias("uuid"),
            m["item"]["name"].alias("name"),
            (m["item"]["qty"] - F.coalesce(m["old_qty"], F.lit(0))).alias("qty"),
            m["item"]["size"].alias("size"),
            F.when(m["old_qty"].isNull(), "added").otherwise("increased").alias("action"),
        ),
    )


def consecutive_changes(carts: DataFrame, session: str, version: str) -> DataFrame:
    """Changes between each cart and the one before in its session."""
    # Stored, because putting rows in order looks at them twice and each cart is to be read once.
    held = materialize(carts.select(session, version, clean_items(F.col("raw_items")).alias("_items")), "cart-items")
    paired = previous_row(held, [session], version, {"_old": "_items"})
    return paired.select(session, version, F.inline(changes(F.col("_items"), F.col("_old"))))


def line_key(columns: list[str] = LINE) -> Column:
    """The identity of a cart line as text; NULLs are equal to each other."""
    return F.to_json(F.struct(*columns))


def merge_carts(server: DataFrame, pending: DataFrame, cart: str) -> DataFrame:
    """Merge pending lines into server lines (cart, pos, uuid, id, size, note, price, qty; pos unique per cart).

    A pending line with the uuid of a server line raises that line to its quantity if it is larger. Otherwise it adds to
    the first line with the same id, size, note and price, or becomes a new line that later ones may add to.
    """
    kept = server.withColumn("_line", line_key())
    asked = pending.withColumn("_line", line_key())
    by_uuid = kept.filter("uuid is not null").select(cart, "uuid", F.col("pos").alias("_target"))
    first_line = kept.groupBy(cart, "_line").agg(F.min("pos").alias("_first"))

    matched = asked.join(by_uuid, [cart, "uuid"], "left").join(first_line, [cart, "_line"], "left")
    # Lines that find no server line meet under their own key; the earliest of them is the new line.
    target = F.when(F.col("_target").isNotNull(), F.concat(F.lit("s"), F.col("_target")))
    target = target.when(F.col("_first").isNotNull(), F.concat(F.lit("s"), F.col("_first"))).otherwise(F.col("_line"))
    raises = F.col("_target").isNotNull()
    steps = matched.select(
        cart,
        target.alias("_slot"),
        (F.col("pos") * 2 + 1).alias("_step"),
        F.when(raises, 0).otherwise(F.col("qty")).alias("_add"),
        F.when(raises, F.col("qty")).alias("_floor"),
        *LINE,
        "uuid",
    )
    starts = kept.select(
        cart,
        F.concat(F.lit("s"), F.col("pos")).alias("_slot"),
        (F.col("pos") * 2 - 2**40).alias("_step"),
        F.col("qty").alias("_add"),
        F.lit(None).cast("long").alias("_floor"),
        *LINE,
        "uuid",
    )
    ops = starts.unionByName(steps)
    first = {"_d": F.min_by(F.struct(*LINE, "uuid"), "_step")}
    folded = fold_add_floor(ops, [cart, "_slot"], "_step", "_add", "_floor", "qty", extra=first)
    return folded.select(cart, "_d.*", "qty")


def fold_operations(ops: DataFrame, session: str, op_id: str) -> DataFrame:
    """The cart lines after all operations (op, id, size, note, price, qty) of each session, in op_id order.

    ``add`` adds to the equal line or starts it, ``delta`` changes an existing line but not below 1, ``remove`` drops
    the line, ``clear`` drops all lines. Only what follows a line's last reset counts, so resets are grouped maxima. What
    is left folds like ``fold_add_floor``: with running totals S the result is the end total plus what is missing to 1 at
    the lowest point. Changes before a line's first add (E in sum) meet no line and are taken out of every total.
    """
    cleared = ops.filter("op = 'clear'").groupBy(session).agg(F.max(op_id).alias("_cleared"))
    lines = ops.filter("op in ('add', 'delta', 'remove')").withColumn("_line", line_key())
    removed = lines.filter("op = 'remove'").groupBy(session, "_line").agg(F.max(op_id).alias("_removed"))
    reset = F.greatest(F.coalesce("_cleared", F.lit(-1)), F.coalesce("_removed", F.lit(-1)))
    kept = (
        lines.filter("op <> 'remove'")
        .join(cleared, session, "left")
        .join(removed, [session, "_line"], "left")
        .filter(F.col(op_id) > reset)
        .select(session, "_line", op_id, "op", "qty", *LINE)
    )
    is_add = F.when(F.col("op") == "add", 1).otherwise(0)
    summed = running_sum(kept, [session, "_line"], op_id, {"_s": F.col("qty"), "_adds": is_add})
    early = F.coalesce(F.sum(F.when(F.col("_adds") == 0, F.col("qty"))), F.lit(0))
    lowest = F.min(F.when((F.col("op") == "delta") & (F.col("_adds") > 0), F.col("_s")))
    return (
        summed.groupBy(session, "_line")
        .agg(
            F.min_by(F.struct(*LINE), op_id).alias("_d"),
            F.max("_adds").alias("_n"),
            (F.sum("qty") - early + F.greatest(F.lit(0), F.coalesce(1 + early - lowest, F.lit(0)))).alias("qty"),
        )
        .filter("_n > 0")
        .select(session, "_d.*", "qty")
    )


def fold_notes(ops: DataFrame, session: str, op_id: str) -> DataFrame:
    """The cart note per session: the last one set, empty after a clear."""
    last = ops.filter("op in ('clear', 'note')").groupBy(session).agg(F.max_by(F.struct("op", "text"), op_id).alias("_l"))
    return last.select(
        session, F.when(F.col("_l.op") == "note", F.coalesce("_l.text", F.lit(""))).otherwise("").alias("cart_note")
    )


def latest_carts(carts: DataFrame, session: str, version: str) -> DataFrame:
    return first_per_key(carts, [session], [F.col(version).desc()])


def clear_carts(sessions: DataFrame, cleared: DataFrame, session: str) -> DataFrame:
    """Empty the cart document of the listed sessions and raise their version."""
    listed = cleared.select(session, F.lit(True).alias("_clear"))
    empty = F.lit(EMPTY_CART)
    joined = sessions.join(listed, session, "left").withColumns(
        {
            "cart": F.when(F.col("_clear"), empty).otherwise(F.col("cart")),
            "version": F.col("version") + F.when(F.col("_clear"), 1).otherwise(0),
        }
    )
    return joined.drop("_clear")


def checkout(requests: DataFrame, session: str, request: str, known_dishes: DataFrame, earlier: DataFrame) -> DataFrame:
    """Cart documents to orders: one row per request with total, counts and status, or an error code.

    ``requests`` carries session, request id, table id and cart; ``known_dishes`` (dish_id); ``earlier`` (session) lists
    the sessions that ordered before. Requests of one session count in request order, so one with lines is an order to those
    after it. An empty cart is refused, with a different code after a first order. Lines of unknown dishes keep their name and
    price but lose the dish id.
    """
    lines = order_lines(requests, [request], known_dishes)
    totals = lines.groupBy(request).agg(
        F.sum("line_total").alias("total_amount"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("dish_id").isNull()).alias("n_unknown_dishes"),
    )
    before = earlier.select(session).distinct().withColumn("_before", F.lit(True))
    judged = requests.join(totals, request, "left").join(before, session, "left")
    placed = requests.join(totals.select(request), request).groupBy(session).agg(F.min(request).alias("_first"))
    judged = judged.join(placed, session, "left")
    empty = F.col("n_lines").isNull()
    ordered = F.coalesce(F.col("_before"), F.lit(False)) | F.coalesce(F.col(request) > F.col("_first"), F.lit(False))
    return judged.select(
        request,
        session,
        "table_id",
        F.when(~empty, "pending").alias("status"),
        F.col("total_amount"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_unknown_dishes", F.lit(0)).alias("n_unknown_dishes"),
        F.when(~empty, F.col("cart_note")).alias("note"),
        F.when(empty & ordered, "cannot_submit_empty_cart_after_order").when(empty, "cart_empty").alias("error"),
    )


def place_orders(requests: DataFrame, session: str, request: str, version: str, known_dishes: DataFrame, earlier: DataFrame) -> DataFrame:
    """A checkout as one result: a row per request with the order, its lines in cart order, and the cart and version left behind.

    ``requests`` is as for ``checkout`` and carries the cart document and the session's ``version``. An accepted checkout empties the
    cart and raises the version; a refused one has an error code and leaves both. Lines are an array, as long as one cart.
    """
    numbered = requests.select(request, F.posexplode(clean_items(F.col("raw_items"))).alias("_at", "_item")).select(request, "_at", "_item.*")
    known = known_dishes.select(F.col("dish_id").alias("_known"))
    line = F.struct(
        "_at", F.col("_known").alias("dish_id"), "name", F.col("size").alias("size_label"), "note", F.col("qty").alias("quantity"),
        cents(F.col("price")).alias("unit_price"), line_total(F.col("price"), F.col("qty")).alias("line_total"),
        F.when(F.col("uuid").isNotNull() | F.col("image_url").isNotNull(), F.to_json(F.struct("image_url", "uuid"))).alias("extra_data"),
    )
    lines = numbered.join(known, F.col("id") == F.col("_known"), "left").groupBy(request).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    placed = checkout(requests, session, request, known_dishes, earlier).join(lines, request, "left")
    done = placed.join(requests.select(request, "cart", version), request)
    accepted = F.col("status").isNotNull()
    return done.select(
        *placed.drop("_lines").columns,
        F.transform("_lines", lambda x: x.dropFields("_at")).alias("lines"),
        F.when(accepted, F.lit(EMPTY_CART)).otherwise(F.col("cart")).alias("cart"),
        (F.col(version) + accepted.cast("int")).alias(version),
    )


def order_lines(requests: DataFrame, keep: list[str], known_dishes: DataFrame) -> DataFrame:
    """The order lines a checkout writes."""
    known = known_dishes.select(F.col("dish_id").alias("_known"))
    items = cart_items(requests, keep).join(known, F.col("id") == F.col("_known"), "left")
    return items.select(
        *keep,
        F.col("_known").alias("dish_id"),
        "name",
        F.col("size").alias("size_label"),
        "note",
        F.col("qty").alias("quantity"),
        cents(F.col("price")).alias("unit_price"),
        line_total(F.col("price"), F.col("qty")).alias("line_total"),
    )


def snapshot(items: Column, note: Column) -> Column:
    """The cart document stored with an order, as JSON."""
    shown = F.transform(
        items,
        lambda i: F.struct(
            i["id"].alias("id"), i["name"].alias("name"), i["qty"].alias("qty"), i["price"].cast("double").alias("price"),
            i["note"].alias("note"), i["size"].alias("size"),
        ),
    )
    return F.to_json(F.struct(shown.alias("items"), note.alias("note")), {"ignoreNullFields": "false"})
