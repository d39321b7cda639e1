"""Tree concatenation and the digest cache against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from larder.llm import bpe, token_counts
from larder.llm.tokenizers import TokenizerFile, WordMemory

FILE = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))
POOLS = [
    ["a", "b", "th", "the", "ing", "tion", " ", "\n", "'s", "'", "!", "́", "é", "😀", "中", "1", "23", "<|endoftext|>", "<|startoftext|>",
     "\x1c", "\xa0", "A", "ß", "İ", "ﬁ", "\t", "한", "ẹ́", "''", "'re", "ll", "'ll", "<|", "|>"],
    list("bthein"), ["!", "'", "s", "re", "-", "_", "ll"], ["e", "́", "̣", "̧", "a"], ["😀", "中", "é"],
]


@pytest.fixture(scope="module")
def own():
    return bpe.joiner(FILE)


def library(own, text):
    return own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("pool", range(len(POOLS)))
def test_tree_equals_library_on_hard_texts(own, pool):
    rng = random.Random(pool)
    for _ in range(250):
        text = "".join(rng.choice(POOLS[pool]) for _ in range(rng.randint(0, 150)))
        for leaf in (3, 7, 20, 50):
            assert own.encode(text, leaf).tolist() == library(own, text), (leaf, text)


def test_one_word_without_any_split(own):
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    assert own.encode(text, 512).tolist() == library(own, text)


def test_word_memory_forgets_and_stays_right():
    memory = WordMemory(FILE, len, limit=20)
    texts = [" ".join(random.Random(i).choices(["on.", "The", "thst", "ed,", "x", "Ünd.", "<|ENDOFTEXT|>"], k=30)) + f" w{i}" for i in range(20)]
    plain = FILE.load()
    assert [sum(memory(t)) for t in texts * 2] == [len(x) for x in plain(texts * 2)]


def test_halves_keep_special_tokens_whole():
    parts = bpe.halves("ab<|endoftext|>cd" * 5, 6, ("<|endoftext|>",))
    assert "".join(parts) == "ab<|endoftext|>cd" * 5
    assert not any("<|" in p and "<|endoftext|>" not in p for p in parts)


def test_documents_with_nulls_copies_and_long_texts(spark, documents, own):
    long = "The quick brown fox isn't here. " * 40 + "x" * 700
    big = 2**62 + 1
    docs = documents(["Hello World", None, "", long, long, " \n", "a<|endoftext|>b"], ids=[1, big, None, 4, 5, 6, 1])
    full = {(r["doc_id"], bytes(r["ids"])): r for r in bpe.encode_documents(docs, FILE, leaf=64).collect()}
    assert len(full) == 7 and (big, b"") in full
    for r in full.values():
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert r["n_tokens"] == len(ids) and r["decoded"] == own.tokenizer.decode(ids, skip_special_tokens=False)
    texts = [(1, "Hello World"), (big, ""), (None, ""), (4, long), (5, long), (6, " \n"), (1, "a<|endoftext|>b")]
    assert set(full) == {(i, full_ids(own, t)) for i, t in texts}
    want = hashlib.sha256(full_ids(own, long)).hexdigest()
    short = {r["doc_id"]: r for r in bpe.encode_documents(docs, FILE, leaf=64, digest_only=True).collect()}
    assert short[4]["ids_sha256"] == want == short[5]["ids_sha256"]
    assert short[4]["decoded_sha256"] == hashlib.sha256(full[(4, full_ids(own, long))]["decoded"].encode()).hexdigest()


def full_ids(own, text):
    return np.array(library(own, text), dtype="<u4").tobytes()


def test_no_documents(no_documents):
    assert bpe.encode_documents(no_documents, FILE).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_counts_come_from_the_cache(spark, documents, tmp_path, name):
    file = TokenizerFile.read(public_tokenizers.path(name))
    texts = ["Hello  World", "hello world", "HELLO\nworld", None, "", "a<|endoftext|>b", "a<|ENDOFTEXT|>b", "naïve café", "hello world"]
    plain = file.load()
    want = sorted(len(plain([t or ""])[0]) for t in texts)
    cache = str(tmp_path / "cache")
    token_counts.create_cache(spark, cache)
    docs = documents(texts)
    first = token_counts.count_tokens(docs, file, cache).collect()
    assert sorted(r["n_tokens"] for r in first) == want
    by_id = {r["doc_id"]: r for r in first}
    assert all(by_id[i]["n_tokens"] == len(plain([t or ""])[0]) and by_id[i]["n_bytes"] == len((t or "").encode()) for i, t in enumerate(texts))
    held = spark.read.parquet(cache)
    assert held.count() == held.select("content_digest").distinct().count() <= 7
    before = held.count()
    token_counts.count_tokens(docs, file, cache).collect()
    assert spark.read.parquet(cache).count() == before  # nothing was encoded again


def test_cache_keeps_versions_apart(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.create_cache(spark, cache)
    docs = documents(["tokenizers differ, obviously"])
    got = {}
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        file = TokenizerFile.read(public_tokenizers.path(name))
        got[name] = token_counts.over_limit(token_counts.count_tokens(docs, file, cache), 4).first()
        assert got[name]["n_tokens"] == len(file.load()(["tokenizers differ, obviously"])[0])
        assert got[name]["over_limit"] == (got[name]["n_tokens"] > 4)
    assert spark.read.parquet(cache).count() == 2


def test_cache_on_no_documents(spark, no_documents, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.create_cache(spark, cache)
    assert token_counts.count_tokens(no_documents, FILE, cache).count() == 0


def test_letters_that_change_in_number_before_a_stop(spark, documents, tmp_path):
    """Letters that end in a mark after normalising; very long texts; words too long to be remembered."""
    texts = ["İ.", "İ,", "aİ. İİ,", "K. Å, ﬁ.", "क़.", "Σ. ΑΣ, Ος.", "x" * 90 + ". " + "y" * 70, "İ. " * 20_000, "no blank" * 9_000]
    plain = FILE.load()
    cache = str(tmp_path / "cache")
    token_counts.create_cache(spark, cache)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(documents(texts), FILE, cache).collect()}
    assert [got[i] for i in range(len(texts))] == [len(plain([t])[0]) for t in texts]
    memory = WordMemory(FILE, list, 50)
    assert [sum(memory(t), []) for t in texts] == [plain([t])[0] for t in texts]
    assert max(map(len, memory.young)) <= 64
