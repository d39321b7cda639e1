"""Per-key work that stays whole when one key holds a third of all rows.

* ``first_per_key`` / ``top_per_key`` use ``row_number`` under a constant limit. Spark applies that limit inside every
  map task before the shuffle, so a hot key ships at most k rows per task.
* ``left_join_many`` keeps a hot key of the right side splittable.
* ``running_sum`` and ``previous_row`` need a key's whole history. ``segments`` cuts all rows, ordered by key and id, into ranges of
  about equal row count, whatever the ids look like. A range is scanned on its own; only the last key of a range can go on in the
  next one, so what is carried forward is at most one row per range. The id must be unique in its key.
* ``dense_ids`` numbers rows 1..n by the same ranges, without sorting them in one task.
* ``fold_add_floor`` folds a sequence of "add" and "raise to at least" steps without visiting them one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.context import materialize


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every key; ``order`` must end in a unique column."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def left_join_many(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join whose right side may hold very many rows of one key.

    Spark can only split a hot key of the left side in a left join, but either side in an inner join. So the matches
    come from an inner join and the rows without a match are added from an anti join on the distinct keys.
    """
    alone = left.join(right.select(*on).distinct(), on, "left_anti")
    return left.join(right, on).unionByName(alone, allowMissingColumns=True)


def segments(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df``, stored, with ``_seg``: the number of the range of ``order`` that a row lies in.

    The ranges come from a sample and hold about equally many rows; ``parts`` ranges, or as many as Spark shuffles into. They
    are written down because sampling them again could cut elsewhere.
    """
    placed = df.repartitionByRange(*([parts] if parts else []), *order)
    return materialize(placed.withColumn("_seg", F.spark_partition_id()), "segments")


def carried(cut: DataFrame, keys: list[str], summary: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """``_seg``, keys and ``before`` (window expressions over the key's earlier ranges) for the keys that go on over a range's end.

    ``summary`` are aggregates of a key's rows in one range. The result has at most one row per range.
    """
    ends = cut.groupBy("_seg").agg(F.max(F.struct(*keys)).alias("_end")).select("_end").distinct()
    going_on = cut.join(F.broadcast(ends), F.struct(*[cut[k] for k in keys]).eqNullSafe(F.col("_end")), "left_semi")  # a row per range
    parts = going_on.groupBy("_seg", *keys).agg(*[v.alias(n) for n, v in summary.items()])
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_seg"))
    return parts.select("_seg", *keys, place.alias("_place"), *[v.alias(n) for n, v in before.items()]).filter("_place > 1").drop("_place")


def with_carry(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``local`` and, on the rows of a range's first key, what was carried into it."""
    there = carry.select(*[F.col(c).alias(f"_k_{c}") if c in ("_seg", *keys) else F.col(c) for c in carry.columns])
    same = F.lit(True)
    for k in ("_seg", *keys):
        same = same & local[k].eqNullSafe(F.col(f"_k_{k}"))
    return local.join(F.broadcast(there), same, "left")  # at most one row per range


def running_sum(df: DataFrame, keys: list[str], id_col: str, values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Add inclusive running totals ``{name: value}`` per key in id order."""
    cut = segments(df.withColumns({f"_v_{n}": v for n, v in values.items()}), [*keys, id_col], parts)
    earlier = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carry = carried(cut, keys, {f"_t_{n}": F.sum(f"_v_{n}") for n in values}, {f"_c_{n}": F.sum(f"_t_{n}").over(earlier) for n in values})
    inside = W.partitionBy("_seg", *keys).orderBy(id_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    joined = with_carry(local, carry, keys)
    return joined.select(*[local[c] for c in df.columns], *[(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in values])


def previous_row(df: DataFrame, keys: list[str], id_col: str, columns: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add ``{new name: column}`` taken from the row before in the same key, NULL on a key's first row."""
    cut = segments(df.withColumn("_row", F.struct(*columns.values())), [*keys, id_col], parts)
    earlier = W.partitionBy(*keys).orderBy("_seg")
    carry = carried(cut, keys, {"_last": F.max_by("_row", id_col)}, {"_carry": F.lag("_last").over(earlier)})
    local = cut.withColumn("_before", F.lag("_row").over(W.partitionBy("_seg", *keys).orderBy(id_col)))
    joined = with_carry(local, carry, keys).withColumn("_prev", F.coalesce("_before", "_carry"))
    return joined.select(*[local[c] for c in df.columns], *[F.col(f"_prev.{src}").alias(new) for new, src in columns.items()])


def dense_ids(df: DataFrame, natural_key: list[str], name: str, start: Column | int = 1, parts: int | None = None) -> DataFrame:
    """Number distinct natural keys densely from ``start``, in order of the key's md5.

    Digests are spread evenly, so ranges of them are; each range is numbered on its own and shifted by the rows before it. The
    same keys always get the same ids.
    """
    digest = F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in natural_key]))
    cut = segments(df.withColumn("_digest", digest), ["_digest", *natural_key], parts)
    sizes = cut.groupBy("_seg").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(W.partitionBy("_seg").orderBy("_digest", *natural_key))
    first = F.lit(start) if isinstance(start, int) else start
    numbered = cut.withColumn("_place", place).join(F.broadcast(shift), "_seg")  # one row per range
    return numbered.select((first + F.col("_shift") + F.col("_place") - 1).cast("long").alias(name), *df.columns)


def fold_add_floor(
    ops: DataFrame, keys: list[str], id_col: str, add: str, floor: str, name: str, parts: int | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Final value per key of the steps ``x = max(x + add, floor)`` in id order, starting from 0 (NULL floor: no bound).

    ``extra`` are further aggregates of the same groups. Such steps compose: with running totals S the result is
    S_end + max(0, max(floor_i - S_i)). So one running sum and one grouped maximum replace the loop.
    """
    summed = running_sum(ops, keys, id_col, {"_s": F.col(add)}, parts)
    lift = F.greatest(F.lit(0), F.coalesce(F.max(F.col(floor) - F.col("_s")), F.lit(0)))
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return summed.groupBy(*keys).agg((F.sum(add) + lift).alias(name), *more)
