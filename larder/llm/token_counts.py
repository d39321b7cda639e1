"""Token counts from a digest cache.

A count depends on two things only: the content, after the foldings that the tokenizer itself makes, and the tokenizer's
version. Both have a digest, and a stored table maps (content digest, tokenizer digest) to the count. A run joins its
documents to that table, encodes each distinct content that is missing once, and appends the new counts.

* Texts are shuffled once, and only those whose digest is missing. Copies are dropped inside every map task before, so a
  text that a third of the rows repeat arrives at most once per task.
* The join of documents to counts moves digests, not texts; its hot side can be split by adaptive execution because the
  other side has one row per digest.
* The cache is a folder of Parquet files below the shared folder. Appending twice after a lost job does no harm: reading
  takes one row per digest.

Defined cases: NULL text counts as the empty text; NULL or repeated ``doc_id`` are separate rows with the counts of their
texts; a very long text is encoded whole; an empty table gives no rows and appends nothing; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.tokenizers import TokenizerFile, word_memory

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_bytes long, n_tokens long"
#: The context length above which a document is marked.
TOKEN_LIMIT = 2048


def normal_content(text: Column, file: TokenizerFile) -> Column:
    """The content in a normal form under which equal forms have equal tokens for this tokenizer.

    Texts that hold a special token's string in any case stay as they are: these strings are matched before folding.
    """
    lower, space = file.folds()
    raw = F.coalesce(text, F.lit(""))
    form = F.regexp_replace(raw, r"[ \t\n\r]+", " ") if space else raw
    form = F.translate(form, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else form
    if not (lower or space):
        return raw
    special = F.lit(False)
    for token in file.special_tokens():
        special = special | F.contains(F.lower(raw), F.lit(token.lower()))
    return F.when(special, raw).otherwise(form)


def read_cache(spark, path: str, file: TokenizerFile) -> DataFrame:
    """(content_digest, n_tokens) stored for this tokenizer version, one row per digest."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return stored.filter(F.col("tokenizer_digest") == file.digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def create_cache(spark, path: str) -> None:
    """An empty cache table."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)


def _local_distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[str] = set()
    for frame in frames:
        fresh = ~(frame["content_digest"].duplicated() | frame["content_digest"].isin(seen))
        frame = frame[fresh]
        seen.update(frame["content_digest"])
        yield frame


def encode_misses(misses: DataFrame, file: TokenizerFile) -> DataFrame:
    """Cache rows for (content_digest, content), each distinct digest encoded once."""
    shared = misses.sparkSession.sparkContext.broadcast(file)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        if own.splits_words():
            memory = word_memory(own, "count", len)
            tokens = lambda texts: [sum(memory(t)) for t in texts]
        else:
            encode = own.load()
            tokens = lambda texts: [len(x) for t in texts for x in encode([t])]
        for frame in _local_distinct(frames):  # rows of one digest are in one partition
            yield pd.DataFrame(
                {
                    "content_digest": frame["content_digest"],
                    "tokenizer_digest": own.digest,
                    "n_bytes": [len(t.encode("utf-8")) for t in frame["content"]],
                    "n_tokens": tokens(frame["content"]),
                }
            )

    return misses.repartition("content_digest").mapInPandas(count, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, file: TokenizerFile, cache: str, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``; the cache folder gains what it did not hold."""
    spark = docs.sparkSession
    content = normal_content(F.col(text), file)
    keyed = docs.select(content.alias("content")).withColumn("content_digest", F.sha2("content", 256))
    local = keyed.select("content_digest", "content").mapInPandas(_local_distinct, "content_digest string, content string")
    misses = local.join(read_cache(spark, cache, file), "content_digest", "left_anti")
    encode_misses(misses, file).write.mode("append").parquet(cache)

    rows = docs.select(
        "doc_id", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("content_digest")
    )
    return rows.join(read_cache(spark, cache, file), "content_digest").select("doc_id", "n_bytes", "n_tokens")


def over_limit(counts: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Mark the documents that do not fit into a context of ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
