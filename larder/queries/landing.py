"""Files as they land: tables written out in the shapes that readers meet, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.context import scratch_folder, table
from larder.functions.parsing import landed_timestamp
from larder.operators import documents as docs
from larder.queries.registry import query
from larder.sources import readers, sinks


def _csv(df: DataFrame, name: str) -> str:
    path = scratch_folder(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def landing_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All-text columns of a CSV whose header carries a byte-order mark and blanks."""
    shown = table(spark, folder, "orders").selectExpr("o_orderkey AS a", "o_orderstatus AS b", "o_custkey AS c")
    return readers.read_landing(spark, _csv(shown.toDF("\ufeff order_id", " status ", "customer "), "landing"))


@query("SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders")
def typed_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _csv(table(spark, folder, "orders").selectExpr("o_orderkey AS order_id", "o_totalprice AS total"), "typed")
    return readers.read_typed(spark, path, T.StructType([T.StructField("order_id", T.LongType()), T.StructField("total", T.DoubleType())]))


@query("SELECT p_name AS name, any_value(length(p_name) || ' letters') AS category FROM part GROUP BY p_name UNION ALL SELECT 'name', 'a dish'")
def name_list(spark: SparkSession, folder: str) -> DataFrame:
    """Names of dishes under a header that names the category first; one dish is called "name"."""
    rows = table(spark, folder, "part").select(F.concat(F.length("p_name"), F.lit(" letters")).alias("Cat"), F.col("p_name").alias("Dish"))
    odd = spark.createDataFrame([("a dish", "name"), ("lost", " ")], "Cat string, Dish string")
    return readers.read_name_list(spark, _csv(rows.unionByName(odd), "names"))


@query(
    """SELECT 'dish ' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE '' END AS description,
  2 AS n_tags FROM documents WHERE doc_id % 5 <> 0"""
)
def dish_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl documents with either spelling of the detail block, blank descriptions and nameless items."""
    detail = """named_struct('dish_name', IF(doc_id % 5 = 0, ' ', concat(' dish ', doc_id)), 'dish_describer', IF(doc_id % 3 = 0, lang, ' '),
      'description', IF(doc_id % 3 = 1, source, NULL), 'tags', array(lang, source))"""
    items = table(spark, folder, "documents").selectExpr(
        f"array(named_struct('disg_detil', IF(doc_id % 2 = 0, {detail}, NULL), 'dish_detail', IF(doc_id % 2 = 1, {detail}, NULL))) AS items"
    )
    path = scratch_folder(spark, "crawl")
    items.write.json(path)
    found = readers.dish_items(readers.read_dish_documents(spark, path, multi_line=False))
    return found.select("name", "description", F.size("tags").cast("long").alias("n_tags"))


@query("SELECT o_orderkey AS order_id, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS landed FROM orders")
def landed_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Dates as text with slashes or dashes."""
    written = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("t"),
    )
    return written.select("order_id", F.date_format(landed_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("landed"))


@query("SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders UNION ALL SELECT o_orderkey, 'again' FROM orders WHERE o_orderstatus = 'F'")
def staged_appends(spark: SparkSession, folder: str) -> DataFrame:
    """A staging table that is refreshed twice and then appended to."""
    rows, path = table(spark, folder, "orders").selectExpr("o_orderkey AS order_id", "o_orderstatus AS status"), scratch_folder(spark, "staging")
    sinks.write_staging(rows.limit(5), path)
    sinks.write_staging(rows, path)
    sinks.write_staging(rows.filter("status = 'F'").withColumn("status", F.lit("again")), path, truncate=False)
    return spark.read.parquet(path)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 7 <> 0) AS success, count(*) FILTER (WHERE doc_id % 7 = 0) AS errors FROM documents")
def json_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata beside a written JSON table."""
    items = table(spark, folder, "documents").selectExpr("doc_id", "IF(doc_id % 7 = 0, 'failed', NULL) AS error")
    path = scratch_folder(spark, "json")
    sinks.write_json_with_metadata(items, path)
    return spark.read.schema("total long, success long, errors long").json(f"{path}/metadata")


@query("SELECT p_name AS name, min(p_partkey) AS dish_id FROM part GROUP BY 1")
def first_id_per_name(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").selectExpr("p_name AS name", "p_partkey AS dish_id", "p_partkey AS line")
    return docs.first_id_per_name(names)


@query("SELECT p_name AS name, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY 1")
def first_line_per_name(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "part").selectExpr("p_name AS name", "p_brand AS brand", "p_partkey AS line")
    return docs.first_line_per_name(items).select("name", "brand")
