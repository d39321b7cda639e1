"""The registered training-data queries, against their SQL where it exists, and the pipeline's stages."""

import hashlib
import importlib.util
import os
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from larder.llm import decontaminate, jaccard, language, quality
from larder.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("LARDER_TEST_DATA", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
spec = importlib.util.spec_from_file_location("check_queries", os.path.join(ROOT, "tools", "check_queries.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    state, _, _ = check.compare(spark, check.connect(FOLDER), name, QUERIES[name], SQL[name], FOLDER)
    assert state.startswith("ok"), state


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, texts, tokenizer):
    got = {r["doc_id"]: r for r in QUERIES["op7_token_counts"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        n = len(tokenizer.encode(texts[d], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[d].encode()), n, n > 2048)


def test_encoding_equals_the_library(spark, texts, tokenizer):
    got = {r["doc_id"]: r for r in QUERIES["op9_tree_bpe"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        ids = tokenizer.encode(texts[d], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_shards_of_the_table(spark, texts):
    got = QUERIES["op4_hilbert_shards"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    by = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


# --- the pipeline ------------------------------------------------------------------------------------------------------


def test_stages():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "keep_quality", "keep_language", "keep_one_of_each_group", "drop_benchmark_leaks", "encode",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def documents_table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, documents, no_documents, k):
    _, stage = corpus_pipeline.STAGES[k]
    text = "the and of that with is for to in a was on by it as are this or be at from have not which"
    docs = documents([None, "", text, text, "12 !?", "zz " * 30_000], ids=[1, None, 3, 3, 5, 2**60 + 1], langs=["en", None, "en", "en", "en", None])
    out = stage(spark, docs, FOLDER)
    kept = out.collect()
    if k < 4:
        assert out.columns == docs.columns
        assert all(any(r == d for d in docs.collect()) for r in kept)
    assert stage(spark, no_documents, FOLDER).count() == 0


def test_language_stage_rejects_what_has_no_language_or_another(spark, documents_table):
    from pyspark.sql import functions as F

    odd = documents_table.limit(2).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("123 !!").alias("text"), "lang", "source", "n_chars").limit(1)
    flipped = documents_table.filter("lang = 'de' AND n_chars > 800").withColumns({"doc_id": F.col("doc_id") - 100_000, "lang": F.lit("fr")})
    flipped = flipped.filter(quality.held_out(F.col("doc_id")))  # what is learned from counts as true
    wrong = {r["doc_id"] for r in flipped.collect()}
    assert len(wrong) >= 3
    kept = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, documents_table.unionByName(odd).unionByName(flipped), FOLDER).collect()}
    assert -1 not in kept and len(kept & wrong) <= len(wrong) // 3  # some are mixed or short
    assert len(kept) >= 0.97 * documents_table.count()


def test_near_duplicate_stage_keeps_the_smallest_id_of_each_group(spark, documents_table):
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(documents_table).collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, documents_table, FOLDER).collect()]
    assert sorted(kept) == sorted(set(groups.values()))


def test_near_duplicate_stage_keeps_one_row_whatever_the_ids(spark, documents):
    one, two = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta"))
    near = one.replace("alpha39", "gamma")
    docs = documents([one, one, near, one, two, two, None, None, "", near], ids=[1, 1, 2, None, 1, None, 7, 7, None, 0])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(False, 0, near), (False, 1, two), (False, 7, ""), (False, 7, ""), (True, 0, "")]
    )


def test_decontamination_stage_drops_the_leaks_only(spark, documents_table):
    found = decontaminate.leaks(documents_table, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    leaking = {r["doc_id"] for r in found.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_benchmark_leaks(spark, documents_table, FOLDER).collect()}
    assert kept == {r["doc_id"] for r in documents_table.select("doc_id").collect()} - leaking


def test_run_applies_the_stages_in_turn(spark, documents_table):
    docs = documents_table
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))
    assert language.UNDETERMINED == "und"
