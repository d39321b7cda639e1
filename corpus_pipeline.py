"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import materialize, table
from larder.llm import bpe, decontaminate, jaccard, language, quality
from larder.llm.queries import TOKENIZER
from larder.llm.tokenizers import TokenizerFile

#: A prediction that contradicts the document's declared language counts from this score on.
SURE = 0.75


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking, learned from the labels of what is here, scores at the threshold or above."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language that does not clearly contradict the declared one."""
    found = language.predict(F.col("text"), language.learn(docs))
    clash = (found["lang_pred"] != F.col("lang")) & (found["score"] >= SURE)
    return docs.filter((found["lang_pred"] != language.UNDETERMINED) & ~F.coalesce(clash, F.lit(False)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that the Jaccard join connects, the one with the smallest id (NULL last, of equal ids the first row).

    Rows are told apart by their place in ``docs``, which must be read alike each time, as a stored table is.
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    found = jaccard.linked_components(placed.select(F.col("_row").alias("doc_id"), "text"))
    found = materialize(found.filter("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    grouped = found.join(found.groupBy("_group").count().filter("count > 1").select("_group"), "_group")
    ranked = grouped.join(placed.select("_row", F.struct(F.isnull("doc_id"), "doc_id", "_row").alias("_rank")), "_row")
    first = ranked.groupBy("_group").agg(F.min("_rank")["_row"].alias("_row"))
    others = grouped.select("_row").join(first.select("_row"), "_row", "left_anti")
    return placed.join(others, "_row", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.keep_clean(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document that is left."""
    return bpe.encode_documents(docs, TokenizerFile.read(TOKENIZER), digest_only=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_language),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe encoding and decoding", encode),
]
#: The learned stages and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
