"""Shards along a Hilbert curve.

Several metadata dimensions are quantised to ``BITS`` bits each, and a row's cell gets its index on the Hilbert curve through
that grid. Rows are sorted by (curve index, text digest, size, id), numbered, and cut into runs of equal row count. Neighbours on
the curve are neighbours in every dimension, so a run covers a small box: a filter on any of the dimensions reads only the
files whose minimum and maximum allow it. Equal texts of equal metadata stand next to each other.

Quantisation is by exact quantile: a value's cell is the share of rows with a smaller value, times the number of cells. The
counts per value come from one grouped sum. Sources, languages and lengths have far fewer values than rows; still their
running totals are made with a range-partitioned sort, like the row numbers, not in one task.

The global row number needs no single task: rows are range-partitioned and sorted by the whole key (which ends in the id, so
a hot cell is split), written once with (partition, place), and the partitions' sizes, one row for each partition, give the
offsets.

Law ``rows``: shard = floor(number * shards / rows), so counts differ by one at most.

Defined cases: NULL text has size 16 and the digest of the empty text; NULL dimensions come first; rows that are equal in the
whole key are numbered in any order, which cannot be told apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.context import materialize

BITS = 4
SHARDS = 40
OVERHEAD_BYTES = 16
DIMENSIONS = ("lang", "source", "size")


def hilbert_index(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of integer grid points (rows x dimensions), each coordinate below 2**bits."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest level down
        low = q - 1
        for i in range(n):
            swap = (x[0] ^ x[i]) & low
            up = (x[i] & q) != 0
            x[0] ^= np.where(up, low, swap)
            x[i] ^= np.where(up, 0, swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def hilbert_column(cells: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf(T.LongType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in columns]), bits))

    return run(*cells)


def numbered(df: DataFrame, order: list[Column], name: str, purpose: str, totals: str | None = None) -> DataFrame:
    """Add the row number from 0 in ``order`` (or the sum of the column ``totals`` over the rows before) without one task.

    ``order`` should end in a column that tells rows apart, so that no value is too heavy for a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, purpose).withColumn("_part", F.shiftright("_at", 33))
    amount = F.col(totals) if totals else F.lit(1)
    sizes = placed.groupBy("_part").agg(F.sum(amount).cast("long").alias("_rows"))  # one row per partition
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    if totals:
        inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        placed = placed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    else:
        placed = placed.withColumn("_inside", F.col("_at").bitwiseAND((1 << 33) - 1))
    out = placed.join(F.broadcast(offsets), "_part")  # as many rows as there are shuffle partitions
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_at", "_part", "_before", "_inside")


def quantised(rows: DataFrame, dimension: str, total: int, bits: int = BITS) -> DataFrame:
    """(value, cell): the cell of every distinct value of a column by exact quantile."""
    counts = rows.groupBy(F.col(dimension).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    below = numbered(counts, [F.col("value").asc_nulls_first()], "below", f"quantiles-{dimension}", totals="n")
    return below.select("value", F.floor(F.col("below") * (1 << bits) / F.lit(total)).cast("int").alias("cell"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``doc_id, size, text_crc32, curve, number, shard, slot`` with the quantised cells of every row."""
    raw = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        *[F.col(d) for d in dimensions if d != "size"],
        (F.octet_length(raw) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.md5(raw.cast("binary")).alias("digest"),
    )
    rows = materialize(rows, "shard-rows")  # no texts from here on
    total = rows.count()
    for d in dimensions:
        cells = quantised(rows, d, max(total, 1), bits).select(F.col("value").alias("_v"), F.col("cell").alias(f"{d}_cell"))
        rows = rows.join(cells, F.col(d).eqNullSafe(F.col("_v"))).drop("_v")
    rows = rows.withColumn("curve", hilbert_column([F.col(f"{d}_cell") for d in dimensions], bits))
    order = [F.col(c).asc_nulls_first() for c in ("curve", "digest", "size", "doc_id")]
    out = numbered(rows, order, "number", "shard-order")
    out = out.withColumn("shard", F.expr(f"cast(number * {shards} div {max(total, 1)} as int)"))
    start = F.expr(f"(cast(shard as long) * {max(total, 1)} + {shards - 1}) div {shards}")
    return out.withColumn("slot", F.col("number") - start)
