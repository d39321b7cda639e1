"""Registered queries of the training-data operators, each over its whole table, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import scratch_folder, table
from larder.llm import (
    align, bpe, checks, decontaminate, jaccard, language, lm_score, pigeonhole, quality, rtree, sharding, token_counts, warc, weighted_sampling,
)
from larder.llm.tokenizers import TokenizerFile
from larder.llm.vector_rows import finite

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_template_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that leak a benchmark item, as it is or with exchanged names, numbers and units."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_bradley_terry(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by pairwise ranking."""
    docs = table(spark, folder, "documents")
    return quality.assess(docs, quality.learn(docs, table(spark, folder, "labels")))


def op3_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """A metadata and a conversion record for every page, taken as a response record."""
    return warc.derive(warc.responses(table(spark, folder, "pages")))


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 runs of the Hilbert curve through language, source and size."""
    out = sharding.assign_shards(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op5_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by the string kernel."""
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents under the exact Jaccard join of 4-word shingles."""
    return jaccard.linked_components(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document through a digest cache that starts empty."""
    cache = scratch_folder(spark, "token-cache")
    token_counts.create_cache(spark, cache)
    counts = token_counts.count_tokens(table(spark, folder, "documents"), TokenizerFile.read(TOKENIZER), cache)
    return token_counts.over_limit(counts)


def op8_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return lm_score.train_and_score(table(spark, folder, "documents"))


def op9_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode_documents(table(spark, folder, "documents"), TokenizerFile.read(TOKENIZER), digest_only=True)


def op10_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return weighted_sampling.fingerprints(table(spark, folder, "documents"))


def op11_whitespace_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of every document's byte-level tokens with its sentence pieces."""
    files = TokenizerFile.read(BYTE_TOKENIZER), TokenizerFile.read(PIECE_TOKENIZER)
    return align.align(table(spark, folder, "documents"), *files, digest_only=True).documents


def op12_str_rtree(spark: SparkSession, folder: str) -> DataFrame:
    """Three hard negatives for each of the five best positives of every fiftieth vector."""
    rows = table(spark, folder, "embeddings").filter(F.col("label").isNotNull() & finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return rtree.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0)


def op13_subspace_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of equal label with a cosine of 0.98 or more."""
    return pigeonhole.near_duplicates(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_windows, op2_bradley_terry, op3_warc_derivatives, op4_hilbert_shards, op5_string_kernel, op6_jaccard_join,
        op7_token_counts, op8_pseudo_likelihood, op9_tree_bpe, op10_weighted_sampling, op11_whitespace_anchors, op12_str_rtree,
        op13_subspace_pigeonhole,
    )
}
SQL: dict[str, str] = {
    "op1_template_windows": checks.LEAKS,
    "op3_warc_derivatives": checks.WARC,
    "op6_jaccard_join": checks.COMPONENTS,
    "op10_weighted_sampling": checks.FINGERPRINTS,
    "op12_str_rtree": checks.NEGATIVES,
    "op13_subspace_pigeonhole": checks.NEAR_VECTORS,
}
