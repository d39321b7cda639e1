"""Cross-tokenizer alignment against byte-by-byte loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from larder.llm import align
from larder.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES
from larder.llm.tokenizers import TokenizerFile

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    return TokenizerFile.read(BYTE_TOKENIZER), TokenizerFile.read(PIECE_TOKENIZER)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    import base64

    ranks = {int(n): base64.b64decode(x) for x, n in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return lambda t: ((x := a.encode(" " + t, add_special_tokens=False).ids), [ranks[i] for i in x], (y := b.encode(t)), [piece(i) for i in y])


def plainly(texts, libraries):
    """Every token pair of every document by comparing byte ranges one by one."""
    found = []
    for t in texts:
        a, bytes_a, b, bytes_b = libraries(t) if t else ([], [], [], [])
        if not t or not b"".join(bytes_a) == (" " + t).encode() == b"".join(bytes_b):
            found.append(([], [], 0, [], ""))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(x) for x in parts])
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if s < v and u < e]
        stops = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for stop in stops:
            own = [",".join(str(x) for x, (s, e) in zip(ids, span) if before <= s and e <= stop) for ids, span in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(own))
            before = stop
        found.append((a, b, len(groups), links, ";".join(groups)))
    counts = Counter(x for f in found for x in f[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for a, b, n, links, text in found:
        rows.append((len(a), len(b), n, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), text))
    return rows, counts, best


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = [
    "The cat sat on the mat.", "The cat sat on the mat.", None, "", " ", "   two   blanks ", "line\nfeeds\n\n and\ttabs", "naïve café – 10 €", "日本語の文章です。空白なし",
    "emoji 👩‍👩‍👧 and 😀😀", "<|endoftext|> is text, <s> too </s> <unk>", "a▁b has the mark", "x" * 700, "supercalifragilistic " * 40, "\u0000 nul", "İstanbul ﬁne ½", "1234567890 3.14159",
]


@pytest.mark.parametrize("common", [align.COMMON, 7, 0])
def test_equals_plain_loops_whatever_fits_the_broadcast(spark, documents, files, libraries, common):
    docs = documents(ODD)
    got = align.align(docs, *files, common=common)
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.documents.collect()}
    wanted, counts, best = plainly(ODD, libraries)
    assert [rows[i] for i in range(len(ODD))] == wanted
    pairs = {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in got.pairs.collect()}
    assert pairs == {k: (n, n == best[k[1]]) for k, n in counts.items()}


def test_texts_that_a_side_does_not_spell_have_no_tokens(spark, documents, files):
    rows = align.align(documents(["a▁b", None, ""]), *files, digest_only=True).documents.collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows) and len(rows) == 3


def test_repeated_and_missing_ids_and_empty_tables(spark, documents, no_documents, files):
    rows = align.align(documents(["one two", "three", "three"], ids=[1, None, 1]), *files).documents.collect()
    assert sorted((r["doc_id"] or 0, r["n_groups"]) for r in rows) == [(0, 1), (1, 1), (1, 2)]
    got = align.align(no_documents, *files)
    assert got.documents.count() == 0 and got.pairs.count() == 0


def test_a_very_long_text_and_a_small_memory(files, libraries):
    text = "Many different words, one0 two1 three2. " * 4000
    whole = align.Aligner(*files)([text])
    tight = align.Aligner(*files, memory_bytes=1000)
    for t in ["other words", text[:5000], "again other words"]:
        tight([t])
    assert tight([text]) == whole
    a, _, b, _ = libraries(text)
    assert (whole["n_a"], whole["n_b"]) == ([len(a)], [len(b)])


def test_registered_query_equals_plain_loops(spark, libraries):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    short = {d: t for d, t in texts.items() if len(t or "") < 3000}
    got = {r["doc_id"]: r for r in QUERIES["op11_whitespace_anchors"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for (d, _), want in zip(short.items(), plainly(list(short.values()), libraries)[0]):
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == want[:4]
        assert r["groups_sha256"] == (hashlib.sha256(want[6].encode()).hexdigest() if want[0] else "")


def test_words_and_windows_equal_the_libraries_on_random_texts(files, libraries):
    """Cuts at blanks, contractions, white space of all kinds, marks and special strings."""
    import random

    draw = random.Random(11)
    pool = [*"abcXYZ019 .,'!-   \n\t\r\x0b\x1c\x85\xa0\u1680\u180e\u2003\u2028\u3000\u200b\ufeffİßﬁ日本\u0301क़한é😀", "'s", " 'll", "<|endoftext|>", "</s>", "▁", "don't "]
    texts = ["".join(draw.choices(pool, k=draw.randint(1, 25))) for _ in range(1500)]
    own = align.Aligner(*files)
    got = own(texts)
    wanted, _, _ = plainly(texts, libraries)
    for k, t in enumerate(texts):
        assert (got["n_a"][k], got["n_b"][k], got["n_groups"][k], got["n_links"][k], got["groups"][k]) == (*wanted[k][:4], wanted[k][6]), repr(t)
