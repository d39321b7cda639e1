"""Hilbert order and the law of equal counts."""

import random
import zlib

import numpy as np
import pytest

from larder.llm import sharding


@pytest.mark.parametrize("dimensions, bits", [(2, 1), (2, 4), (3, 3), (3, 4), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(dimensions, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dimensions)).reshape(dimensions, -1).T
    index = sharding.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, shards, bits):
    """rows: (doc_id, text, lang, source)."""
    import hashlib

    n = len(rows)
    full = [(d, g, s, len((t or "").encode()) + 16, hashlib.md5((t or "").encode()).hexdigest()) for d, t, g, s in rows]
    low = lambda v: (v is not None, v)

    def cell(k, r):
        return sum(low(x[k]) < low(r[k]) for x in full) * (1 << bits) // n

    marked = [(int(sharding.hilbert_index(np.array([[cell(k, r) for k in (1, 2, 3)]]), bits)[0]), r[4], r[3], low(r[0]), r[0]) for r in full]
    out = {}
    start = {}
    for i, m in enumerate(sorted(marked)):
        shard = i * shards // n
        start.setdefault(shard, i)
        out[m[4]] = (shard, i - start[shard], m[0])
    return out


def test_shards_equal_brute_force(documents):
    rng = random.Random(1)
    texts = [rng.choice([None, "", "a" * rng.randint(0, 400), "same", "ünï"]) for _ in range(130)]
    langs = [rng.choice(["de", "en", "en", "en", None]) for _ in texts]
    docs = documents(texts, langs=langs)
    got = sharding.assign_shards(docs, shards=40, bits=3).collect()
    want = brute([(i, t, g, f"s{i % 3}") for i, (t, g) in enumerate(zip(texts, langs, strict=True))], 40, 3)
    assert {r["doc_id"]: (r["shard"], r["slot"], r["curve"]) for r in got} == want
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)


@pytest.mark.parametrize("n", [1, 39, 40, 41, 101])
def test_counts_differ_by_one_and_slots_have_no_gap(documents, n):
    got = sharding.assign_shards(documents(["hot"] * n, ids=[7] * n)).collect()  # equal in everything
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
    sizes = [len(by.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_no_documents(no_documents):
    assert sharding.assign_shards(no_documents).count() == 0


def test_runs_are_small_boxes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.assign_shards(docs).toPandas()
    values = lambda by, c: got.groupby(by)[c].nunique().mean()
    got["hashed"] = got["text_crc32"] % 40
    assert sum(values("shard", f"{d}_cell") for d in sharding.DIMENSIONS) < 0.6 * sum(values("hashed", f"{d}_cell") for d in sharding.DIMENSIONS)
