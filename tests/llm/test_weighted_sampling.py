"""Fingerprints against a plain Python twin, and against the similarity they estimate."""

import hashlib
import math
import random
from collections import Counter

import pytest

from larder.llm import weighted_sampling as ws

M = ws.MASK


def mix(x):
    x = ((x ^ (x >> 16)) * ws.FIRST) & M
    x = ((x ^ (x >> 13)) * ws.SECOND) & M
    return x ^ (x >> 16)


def signature(text, samples):
    weights = Counter(w for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w)
    if not weights:
        return None
    out = []
    for k in range(samples):
        best = None
        for term, w in weights.items():
            d = hashlib.md5(term.encode()).hexdigest()
            h = [int(d[i : i + 15], 16) for i in (0, 16)]
            p = [h[0] & (2**30 - 1), h[0] >> 30, h[1] & (2**30 - 1), h[1] >> 30]
            pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)]
            u = [(mix((p[a] + (5 * k + j + 1) * p[b]) & M) + 0.5) / (M + 1) for j, (a, b) in enumerate(pairs)]
            r, c, beta = -math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3])), u[4]
            t = math.floor(math.log(w) / r + beta)
            item = (math.floor((c - r * (t - beta) - r + ws.SHIFT) * (1 << ws.PLACES)), (p[0] + (t & 0xFFFFF) * ws.SPREAD) & M)
            best = item if best is None or item < best else best
        out.append(best[1])
    return out


def near(a, b):
    if a is None or b is None:
        return float(a is b)
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def generalised_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values())


def as_text(s):
    return ws.EMPTY if s is None else "".join(f"{x:08x}" for x in s)


@pytest.mark.parametrize("samples", [24, 10])
def test_fingerprints_equal_plain_python(documents, samples):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["The", "the", "of", "ünï", "😀", "x.", "y"], k=rng.randint(1, 30))) for _ in range(12)]
    texts += [None, "", " \n ", "one", texts[0], "a\tb\nc"]
    ids = [*range(10, 10 + len(texts) - 1), None]
    got = {r["doc_id"]: r for r in ws.fingerprints(documents(texts, ids), samples=samples).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(got) == len(texts)
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        take = len(text) // 2
        edited = text[: len(text) - take] + after[:take]
        own, changed, follow = (signature(t, samples) for t in (text, edited, after))
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(own), as_text(changed))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near(own, changed)), pytest.approx(near(own, follow)))


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    for share in (0.2, 0.6, 0.9):
        a = rng.choices(words, k=150)
        b = [w if rng.random() < share else rng.choice(words) for w in a]
        a, b = " ".join(a), " ".join(b)
        want = generalised_jaccard(a, b)
        assert near(signature(a, 800), signature(b, 800)) == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 800) + 0.01)


def test_repeated_rows_single_rows_and_none(documents, no_documents):
    docs = documents(["a b c d", "a b c d", "a b c d", "x y"], ids=[1, 1, 2, 1])
    rows = ws.fingerprints(docs).collect()
    assert len(rows) == 4 and sum(r["doc_id"] == 1 for r in rows) == 3
    same = {r["fingerprint"] for r in rows if r["n_chars"] == 7}
    assert len(same) == 1
    only = ws.fingerprints(documents(["abcd efgh"], ids=[5])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0 and only[0]["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest()
    assert ws.fingerprints(no_documents).count() == 0


def test_no_python_in_the_plan(documents):
    df = ws.fingerprints(documents(["a b", "c d"]))
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_a_very_long_text(documents):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    got = {r["doc_id"]: r for r in ws.fingerprints(documents([long, "w1 w2"])).collect()}
    assert got[0]["n_chars"] == len(long) and got[0]["fingerprint"] == as_text(signature(long, ws.SAMPLES))
