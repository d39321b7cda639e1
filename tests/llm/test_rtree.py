"""Hard negatives from the packed tree against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import rtree

SCHEMA = "vec_id long, label int, vector array<long>, row long, tile long, query long"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, g, None if v is None else [None if x is None else int(x) for x in v], 0, 0, 0) for i, g, v in rows], SCHEMA)


def plainly(rows, every, positives=5, negatives=3, low=50, high=95):
    good = [(i, g, v) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and abs(x) < rtree.LIMIT for x in v)]
    out = []
    for n, (i, g, v) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), j, h) for m, (j, h, w) in enumerate(good) if m != n and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == g][:positives]:
            fit = [x for x in scored if x[2] != g and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width,size,small", [(64, 60, False), (8, 20, True), (2, 3, True), (8, 1 << 23, True)])
def test_equals_all_scores(vectors, monkeypatch, width, size, small):
    if small:  # many tiles, leaves and query groups
        for name, n in (("SLAB_ROWS", 120), ("TILE_ROWS", 40), ("QUERY_ROWS", 16), ("TILES_PER_CELL", 2)):
            monkeypatch.setattr(rtree, name, n)
    draw = np.random.default_rng(width + size)
    v = draw.integers(-size, size, (400, width)) + (size // 3) * draw.integers(0, 2, (400, 1))
    v[10:40] = v[10]
    rows = [(int(i), int(g), w) for i, g, w in zip(draw.permutation(400), draw.choice([0, 1, 1, 1, 2, 7], 400), v.tolist())]
    got = rtree.hard_negatives(vectors(rows), F.col("vec_id") % 10 == 0)
    wanted = plainly(rows, 10)
    assert len(wanted) > 60 and result(got) == wanted


def test_odd_rows_have_defined_results(vectors):
    rows = [
        (0, 1, [4, 4]), (0, 1, [4, 4]), (1, 1, [3, 3]), (2, 2, [2, 3]), (3, 2, [2, 3]), (None, 2, [2, 3]), (4, None, [2, 3]), (5, 2, None), (6, 2, [None, 3]), (7, 2, [2, 3, 1]),
        (8, 2, [1 << 30, 1]), (10, 5, []), (20, 5, []), (11, 6, []), (30, 9, [-5, -5]), (31, 9, [5, 5]), (40, 3, [0, 0]), (41, 3, [0, 0]),
    ]
    got = rtree.hard_negatives(vectors(rows), F.col("vec_id") % 10 == 0)
    assert result(got) == plainly(rows, 10)


def test_empty_tables_and_no_anchors(vectors):
    assert rtree.hard_negatives(vectors([]), F.col("vec_id") % 10 == 0).count() == 0
    assert rtree.hard_negatives(vectors([(1, 1, [1]), (2, 2, [1])]), F.col("vec_id") % 10 == 0).count() == 0


def test_packing_keeps_every_row_once_and_boxes_hold_their_rows():
    draw = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000, 4096):
        v = draw.integers(-99, 99, (n, 5))
        order, leaf = rtree.packed(v)
        assert sorted(order) == list(range(n)) and np.bincount(leaf).max() <= rtree.LEAF_ROWS and (np.diff(leaf) >= 0).all()
        tree = rtree.Tree(v[order], leaf)
        assert len(tree.levels[-1][0]) == 1
        q = draw.integers(-9, 9, (7, 5))
        scores = q @ v[order].T
        for level in range(len(tree.levels)):
            least, most = tree.interval(level, slice(None), np.maximum(q, 0), np.minimum(q, 0))
            box = leaf // rtree.FAN**level
            assert all((least[:, b] <= scores[:, box == b].min(axis=1)).all() and (scores[:, box == b].max(axis=1) <= most[:, b]).all() for b in range(len(most.T)))


def test_boxes_outside_the_windows_stay_closed():
    draw = np.random.default_rng(4)
    v = np.concatenate([draw.integers(0, 20, (2000, 3)), draw.integers(900, 1000, (2000, 3))])
    order, leaf = rtree.packed(v)
    block = rtree.Block(np.array([[1, 1, 1]]), np.array([-1]), np.array([2800]), np.array([3000]), 3)
    block.search(np.array([0]), v[order], leaf, order, order)
    assert 0 < block.opened < 0.2 * (leaf.max() + 1)
    assert block.best.score[0].tolist() == sorted(v.sum(axis=1).tolist())[-3:][::-1]
