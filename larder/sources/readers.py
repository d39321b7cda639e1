"""Readers for raw files and stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.text import blank_to_null, strip

BOM = "﻿"


def read_landing(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """A CSV with header as all-text columns; header names lose blanks and a byte-order mark.

    Allow line breaks inside fields only where they occur: such files cannot be split between tasks.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks, escape='"')
    return raw.toDF(*[c.lstrip(BOM).strip() for c in raw.columns])


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_table_over_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table or view. Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` so that
    the executors read slices instead of one task reading everything."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, category) from a CSV with or without header; blank names dropped, first row of a name wins.

    A first line with a field ``dish`` or ``name`` (any case) is the header, and its names give the columns (``category`` or
    ``cat``). Without one, position 0 is the name and 1 the category. "First" is the order of file name and place in it.
    """
    raw = spark.read.csv(path, header=False, inferSchema=False)
    head = raw.first()
    clean = [(v or "").lstrip(BOM).strip().lower() for v in head] if head else []
    at = {n: i for i, n in reversed(list(enumerate(clean)))}
    name_at = at.get("dish", at.get("name"))
    has_header = name_at is not None
    category_at = at.get("category", at.get("cat")) if has_header else 1
    name_at = name_at if has_header else 0
    column = lambda i: F.lit(None).cast("string") if i is None or i >= len(raw.columns) else F.col(f"_c{i}")
    same = F.lit(has_header)  # a header stands in every file of a folder
    for c in raw.columns:
        same = same & F.col(c).eqNullSafe(F.lit(head[c] if head else None))
    rows = raw.filter(~same).select(
        strip(F.regexp_replace(column(name_at), BOM, "")).alias("name"),
        blank_to_null(column(category_at)).alias("category"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_line"),
    )
    rows = rows.filter(F.col("name") != "")
    return rows.groupBy("name").agg(F.min_by("category", "_line").alias("category"))


DETAIL = T.StructType(
    [
        T.StructField("dish_name", T.StringType()),
        T.StructField("dish_describer", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
SNIPPET = T.StructType(
    [T.StructField(n, T.StringType()) for n in ["url", "title", "snippet", "content"]]
)
# The two spellings under which documents carry the detail block.
DETAIL_KEYS = ["disg_detil", "dish_detail"]
DISH_DOCUMENTS = T.StructType(
    [
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [T.StructField(k, DETAIL) for k in DETAIL_KEYS] + [T.StructField("snippets", T.ArrayType(SNIPPET))]
                )
            ),
        )
    ]
)


def read_dish_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Crawl documents: one per file, over several lines, or (``multi_line`` off) one per line, which large files can be split by."""
    return spark.read.schema(DISH_DOCUMENTS).json(path, multiLine=multi_line)


def dish_items(documents: DataFrame) -> DataFrame:
    """(name, description, tags) per item of the documents; items without a name are dropped."""
    item = documents.select(F.explode("items").alias("item"))
    block: Column = F.coalesce(*[F.col(f"item.{k}") for k in DETAIL_KEYS])
    rows = item.select(block.alias("d")).select(
        F.coalesce(strip(F.col("d.dish_name")), F.lit("")).alias("name"),
        F.coalesce(blank_to_null(F.col("d.dish_describer")), blank_to_null(F.col("d.description")), F.lit("")).alias(
            "description"
        ),
        F.coalesce("d.tags", F.array().cast("array<string>")).alias("tags"),
    )
    return rows.filter("name <> ''")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: the work items whose key is not in the earlier output."""
    return work.join(done.select(key), key, "left_anti")
