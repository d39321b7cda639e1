"""The subspace pigeonhole join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import pigeonhole

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies long, cell long"


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, g, 0, 0, 0) for i, v, g in rows], SCHEMA)

    return make


def plainly(rows, threshold):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) if g is not None and usable(v) else None for _, v, g in rows]
    unit = [None if v is None else v / np.sqrt((v / np.abs(v).max()) @ (v / np.abs(v).max())) / np.abs(v).max() for v in unit]
    root, links = list(range(n)), [0] * n

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, links[k], least.get(top(k)), i == least.get(top(k))) for k, (i, _, _) in enumerate(rows) if i is not None)


def result(df):
    return sorted(tuple(r) for r in df.collect() if r["vec_id"] is not None)


@pytest.mark.parametrize("width,threshold,cell_rows,tile", [(64, 0.98, 512, 1024), (64, 0.98, 4, 16), (24, 0.95, 8, 1024), (5, 0.99, 512, 16), (1, 0.98, 512, 1024)])
def test_equals_all_pairs(vectors, width, threshold, cell_rows, tile):
    draw = np.random.default_rng(width)
    base = draw.normal(size=(30, width))
    noise = draw.normal(size=(260, width)) * draw.uniform(0, 0.35, (260, 1))
    cloud = base[draw.integers(0, 30, 260)] + noise
    cloud[200:] = base[0] + 0.12 * draw.normal(size=(60, width))  # one large group of near copies
    cloud[50:60] = cloud[0]  # copies
    rows = [(int(i), [float(x) for x in np.float32(v)], int(draw.integers(0, 2))) for i, v in zip(draw.permutation(1000), cloud)]
    got = pigeonhole.near_duplicates(vectors(rows), threshold, cell_rows=cell_rows, tile=tile)
    assert result(got) == plainly(rows, threshold)


def test_odd_vectors_have_defined_results(vectors):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [3.0, 6.0], 0), (3, [3.0, 6.0], 0), (4, [1.0, 2.0], None), (5, [1.0, 2.0], None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0], 0),
        (9, [0.0, 0.0], 0), (10, [nan, 1.0], 0), (11, [inf, 1.0], 0), (12, [None, 1.0], 0), (13, [1.0, 2.0, 0.0], 0), (14, [1e38, 2e38], 0), (15, [1e-38, 2e-38], 0), (16, [-1.0, -2.0], 0), (17, [-0.0, 1.0], 1), (18, [0.0, 1.0], 1),
    ]
    got = pigeonhole.near_duplicates(vectors(rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert result(got) == plainly(rows, 0.98)


def test_rows_without_an_id_take_part(vectors):
    got = pigeonhole.near_duplicates(vectors([(None, [1.0, 0.0], 0), (7, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, True), (0, 1, 7, False), (7, 1, 7, True)]


def test_an_empty_table(vectors):
    assert pigeonhole.near_duplicates(vectors([])).count() == 0


def test_tasks_return_no_pairs(vectors):
    """A group of n near copies gives about n rows per cell, not n squared."""
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.ones(64) + 0.01 * draw.normal(size=(300, 64)))]
    seen = pigeonhole.links(pigeonhole.nodes(vectors(rows).select("vec_id", "label", "embedding")))
    assert seen.agg(F.sum("links")).first()[0] == 300 * 299
    assert seen.count() <= 300 * 8


def test_rotation_rounds_alike_in_any_company():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 48)).astype(np.float32)
    whole = pigeonhole.turned(x)[1]
    assert (np.concatenate([pigeonhole.turned(x[k : k + 7])[1] for k in range(0, 500, 7)]) == whole).all()
    assert np.allclose(whole @ whole.T, pigeonhole.turned(x)[0] @ pigeonhole.turned(x)[0].T)
