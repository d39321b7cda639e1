"""The T-occurrence join against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from larder.llm import jaccard
from larder.llm.components import components

WORDS = [f"w{i}" for i in range(4000)]


def as_set(text):
    return jaccard.shingles(text)


def linked(a, b):
    both = len(np.intersect1d(a, b))
    return len(a) and len(b) and 100 * both >= 85 * (len(a) + len(b) - both)


def test_words_and_shingles():
    assert len(as_set("A b\tC\x0bd")) == 1 and as_set("A b C d").tolist() == as_set("a B c D").tolist()
    assert as_set("É x y z").tolist() != as_set("é x y z").tolist()  # A-Z only
    assert len(as_set("a\x1cb c\xa0d e f g")) == 2  # neither 0x1C nor 0xA0 ends a word
    assert len(as_set("a b")) == 1 and as_set("a b").tolist() != as_set("b a").tolist()
    assert len(as_set("")) == len(as_set(None)) == len(as_set(" \n")) == 0
    assert len(as_set("a a a a a a a")) == 1


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = "alpha beta  gamma\n" * 40 + "x" * 500 + " omega " + "y" * 90
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    assert jaccard.word_hashes(text).tolist() == whole.tolist()
    assert len(whole) == 123 and len(set(whole.tolist())) == 6


@pytest.mark.parametrize("size", [8, 60, 300])
def test_sketches_never_part_linked_sets(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: jaccard.required(size, size)], rng.integers(0, 2**63, int(rng.integers(0, size // 8 + 1))).astype(np.uint64)]))
        if linked(a, b):
            (x, x_next), (y, y_next) = jaccard.sketches(a), jaccard.sketches(b)
            u, v = int(np.searchsorted(jaccard.EDGES, len(a))), int(np.searchsorted(jaccard.EDGES, len(b)))
            x, y = (x, y) if u == v else (x_next, y) if u < v else (x, y_next)
            differ = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
            assert differ <= 15 * (len(a) + len(b)) // 185


def test_divide_skip_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n_lists, n = int(rng.integers(1, 30)), int(rng.integers(1, 60))
        lists = [np.flatnonzero(rng.random(n) < rng.choice([0.05, 0.5, 0.95])) for _ in range(n_lists)]
        need = int(rng.integers(1, n_lists + 1))
        counts = np.bincount(np.concatenate(lists), minlength=n)
        assert jaccard.divide_skip(lists, need) == {int(i): int(counts[i]) for i in np.flatnonzero(counts >= need)}


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 11, 12, 17, 18, 30, 39, 40, 59, 60, 88, 200, 700])
def test_linked_sets_share_a_bucket(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        kept = int(rng.integers(jaccard.required(len(a), len(a)) - 1, len(a) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[:kept], rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 2))).astype(np.uint64)]))
        if linked(a, b):
            assert np.intersect1d(jaccard.bucket_keys(a), jaccard.bucket_keys(b)).size


def test_search_finds_exactly_the_links():
    rng = random.Random(1)
    base = rng.choices(WORDS, k=120)
    texts = [" ".join(base)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        texts.append(" ".join(t[: rng.randint(90, 120)]))
    sets = [as_set(t) for t in texts]
    assert sorted(jaccard.search(sets[0], sets)) == [i for i, s in enumerate(sets) if linked(sets[0], s)]


def brute(texts, ids):
    sets = [as_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if len(sets[i]) else d) for i, d in enumerate(ids)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=55))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three", "a " * 5000]
    for _ in range(3):  # groups of near copies, chained so that their ends are apart
        t = rng.choices(WORDS, k=rng.randint(40, 90))
        for _ in range(12):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(WORDS)
    t = rng.choices(WORDS, k=60)
    for _ in range(40):  # a hot group
        u = list(t)
        for _ in range(rng.randint(0, 2)):
            u[rng.randrange(len(u))] = rng.choice(WORDS)
        texts.append(" ".join(u))
    for _ in range(25):  # a passage that many share
        texts.append(" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) + " " + passage)
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(20)]
    texts += rng.choices(texts, k=15)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[8] = None
    return texts, ids


@pytest.mark.parametrize("block_sets, chunk_sets", [(512, 1024), (4, 5)])
def test_components_equal_brute_force(monkeypatch, documents, block_sets, chunk_sets):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block_sets)  # small bounds cut blocks and open buckets everywhere
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk_sets)
    texts, ids = corpus(block_sets)
    got = jaccard.linked_components(documents(texts, ids).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(texts, ids)


def test_hot_buckets_are_cut_and_lose_no_member(monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
    keys = np.array([7] * 30 + [8] * 3 + [9], dtype=np.int64)
    ids = np.concatenate([np.arange(30), [1, 2, 2], [5]]).astype(np.int64)
    bucket, root, member = jaccard._split_hot(keys, ids)
    assert set(member[root == 7]) == set(range(30)) and set(member[root == 8]) == {1, 2} and set(member[root == 9]) == {5}
    counts = {b: (bucket == b).sum() for b in set(bucket)}
    assert max(counts.values()) <= 8  # sub-buckets of four, and eight leaders in the bucket itself
    leaders = set(member[bucket == 7])
    for b in set(bucket[root == 7]) - {7}:
        assert leaders & set(member[bucket == b])


def test_forest_joins_what_all_edges_join():
    a, b = np.array([1, 2, 1, 5, 3, 3]), np.array([2, 3, 3, 6, 1, 2])
    assert jaccard._forest(a, b, np.arange(6)) == [0, 1, 3]
    assert jaccard._forest(a, b, np.arange(6)[::-1]) == [5, 4, 3]


def test_uncut_buckets_need_no_root(monkeypatch):
    """A bucket row tells its root by one bit pattern that is 0 unless the bucket is cut."""
    texts = [" ".join(WORDS[:30] + WORDS[100 + i : 101 + i]) for i in range(12)]
    frame = pd.DataFrame({"doc_id": [str(i) for i in range(12)], "text": texts, "mark": range(12)})

    def bucket_rows():
        rows = pd.concat(jaccard._scan(iter([frame])))
        return rows[~rows["is_set"].astype(bool)][["bucket", "up", "id"]].astype("int64")

    def met(rows):
        found = pd.concat(jaccard._meet(iter([rows])))
        return {root: frozenset(g) for root, g in found.groupby("root")["id"]}

    whole = bucket_rows()
    assert len(whole) and (whole["up"] == 0).all()
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
    cut = bucket_rows()
    assert (cut["up"] != 0).any() and met(cut) == met(whole)


def test_sets_are_dealt_by_id_once(spark, monkeypatch, documents):
    """No join that follows shuffles the sets again, also where nothing is small enough to be broadcast."""
    plans = []

    def noted(df, purpose, write=jaccard.materialize):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, purpose)

    monkeypatch.setattr(jaccard, "materialize", noted)
    texts, ids = corpus(11)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = spark.catalog.listTables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.linked_components(documents(texts, ids).repartition(3)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(texts, ids)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert spark.catalog.listTables() == tables
    reads = 0
    for purpose, plan in plans:
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "FileScan parquet spark_catalog.default.larder_" in line:
                reads += 1
                above = [x.lstrip(" :+-*(0123456789)") for x in lines[:k]][::-1]
                first = next(x for x in above if not x.startswith(("Project", "Filter", "ColumnarToRow")))
                assert first.startswith("Sort "), (purpose, plan)  # of a merge join; an exchange would stand here
    assert reads >= 4


def test_no_documents(no_documents):
    assert jaccard.linked_components(no_documents).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in list(root)}


@pytest.fixture
def written(monkeypatch):
    """The exchanges in the plan of each table that the join and the components write."""
    from larder.llm import components as module

    seen = []

    def counted(df, purpose, write=module.materialize):
        seen.append((purpose, df._jdf.queryExecution().executedPlan().toString().count("Exchange ")))
        return write(df, purpose)

    monkeypatch.setattr(module, "materialize", counted)
    monkeypatch.setattr(jaccard, "materialize", counted)
    return seen


def test_plans_end_at_each_step(documents, written):
    texts, ids = corpus(7)
    got = jaccard.linked_components(documents(texts, ids).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(texts, ids)
    assert max(n for _, n in written) <= 16, written  # the driver holds each plan many times over while it runs


def test_stars_take_no_round(spark, written):
    stars = [(5, 1), (1, 6), (6, 1), (9, 2), (3, 3), (None, 4)]
    got = components(spark.createDataFrame(stars, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert len(written) == 1


def test_chains_and_hubs_become_stars(spark):
    chain = [(i, i + 1) for i in range(20, 45)]
    hub = [(100, k) for k in range(60, 90)] + [(k, 101) for k in range(60, 90)]
    cross = [(200, 210), (210, 201), (211, 201), (211, 202)]
    got = components(spark.createDataFrame(chain + hub + cross, "a long, b long").repartition(4)).collect()
    want = {i: 20 for i in range(20, 46)} | {k: 60 for k in [*range(60, 90), 100, 101]} | {k: 200 for k in (200, 201, 202, 210, 211)}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_no_pairs_need_no_search(spark):
    none = spark.createDataFrame([], "query long, id long")
    assert jaccard.verified(none, None).collect() == []
