"""The two classifiers: fits on made-up rows, held-out accuracy on the tables, and odd inputs."""

import os
import random
import zlib

import numpy as np
import pytest

from larder.llm import language, quality

FOLDER = os.environ.get("LARDER_TEST_DATA", "/root/testdata/sf0.001")
FOLDER_LARGER = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_pairs_use_every_row_and_never_repeat():
    for good, bad, wanted in ((3, 5, 15), (4, 6, 24), (4, 6, 10), (7, 1, 100), (6, 4, 24)):
        a, b = quality.pairs(good, bad, wanted)
        assert len({*zip(a.tolist(), b.tolist(), strict=True)}) == len(a) == min(wanted, good * bad)
        if wanted >= max(good, bad):
            assert set(a) == set(range(good)) and set(b) == set(range(bad))


def test_ranking_recovers_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    true = np.array([2.0, -1.0, 0.0, 0.5, 0.0])
    wins = x @ true + rng.logistic(size=400) * 0.1 > 0.3
    model = quality.fit(x[wins], x[~wins])
    assert np.corrcoef(x @ model.weights, x @ true)[0, 1] > 0.97
    s = model.scores(x)
    assert ((s >= 0) & (s <= 1)).all() and ((s >= quality.THRESHOLD) == wins).mean() > 0.95
    assert (s >= quality.THRESHOLD).sum() == wins.sum()  # the cut is a quantile


def test_gradient_vanishes_at_the_fit():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (60, 4)), rng.normal(0, 1, (50, 4))
    model = quality.fit(good, bad)
    scale = np.vstack([good, bad]).std(axis=0)
    a, b = quality.pairs(60, 50)
    d, w = (good[a] - bad[b]) / scale, model.weights * scale
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(d.T @ p / len(d) - quality.RIDGE * w).max() < 1e-6


def test_features_of_odd_texts():
    assert not quality.features(None).any() and not quality.features("").any()
    for text in ("a", "\n", " ", "\ud800", "x" * 300_000, "é" * 10):
        assert np.isfinite(quality.features(text)).all() and len(quality.features(text)) == quality.N_FEATURES


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{FOLDER_LARGER}/{n}.parquet")
    return read("documents"), read("labels")


def test_quality_on_the_tables(tables):
    docs, labels = tables
    model = quality.learn(docs, labels)
    got = {r["doc_id"]: r for r in quality.assess(docs, model).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == held_out(d) for d, r in got.items())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [d for d in truth if held_out(d)]
    assert len(tested) > 50 and np.mean([got[d]["predicted"] == truth[d] for d in tested]) >= 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_cut_is_the_quantile_of_all_labelled_rows(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    docs = docs.withColumn("text", F.substring("text", 1, 2000))
    labels = labels.withColumn("quality", F.when(F.col("doc_id") % 10 == 3, 0).otherwise(F.col("quality")))  # labels that overlap
    model = quality.learn(docs, labels, rows=20)  # far fewer than there are labels of either kind
    usable = labels.filter(F.col("quality").isin(0, 1) & ~quality.held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    rows = quality.assess(docs, model).join(usable, "doc_id").collect()
    assert sum(r["quality"] == 0 for r in rows) > 20 and sum(r["quality"] == 1 for r in rows) > 20
    assert sum(r["predicted"] == 0 for r in rows) == sum(r["quality"] == 0 for r in rows)


def test_ranks_keep_the_order_of_scores(spark):
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.normal(size=60), rng.normal(size=20) * 1e-200, [0.0, -0.0, 5.0, 5.0, 5.0]])
    ranks = quality.as_ranks(s)
    assert np.array_equal(s[np.argsort(ranks, kind="stable")], np.sort(s)) and [quality.as_score(int(k)) for k in ranks] == s.tolist()
    table = spark.createDataFrame([(int(k),) for k in ranks], "rank long")
    places = [0, 1, 40, 41, len(s) - 2, len(s) - 1]
    assert [quality.as_score(k) for k in quality.ranks_at(table, places)] == np.sort(s)[places].tolist()


def test_labels_of_the_held_out_fold_are_not_read(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_quality_on_odd_rows(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents([None, "", "fine words here", "!!! ###", "fine words here"], ids=[5, None, 1, 2, 1])
    rows = quality.assess(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1][0] == by[1][1] > by[2][0] and by[5] == by[None]
    nothing = quality.learn(docs, labels.limit(0))
    assert {r["predicted"] for r in quality.assess(docs, nothing).collect()} == {1}
    assert quality.assess(no_documents, nothing).count() == 0
    assert quality.learn(no_documents, labels).cut == 0


# --- language ---------------------------------------------------------------------------------------------------------


def test_kernel_is_the_presence_kernel():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 40))) for _ in range(12)]
    model = language.landmark_model(["x"], texts)
    got = model.kernel(texts)

    def grams(t):
        return {t[i : i + n] for n in range(1, language.MAX_N + 1) for i in range(len(t) - n + 1)}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert got[i, j] == pytest.approx(want, abs=0.03)  # hashing may merge a few n-grams


def test_ridge_solution():
    rng = random.Random(2)
    lang = np.array(["a", "b"] * 40)
    texts = ["".join(rng.choices("abcd " if x == "a" else "cdef ", k=60)) for x in lang]
    model = language.landmark_model(["a", "b"], texts[:20])
    k = model.kernel(texts)
    fitted = language.fit(model, k, lang)
    assert (np.array(fitted.languages)[(k @ fitted.weights).argmax(axis=1)] == lang).mean() > 0.98


def test_language_on_the_tables(tables):
    docs, _ = tables
    got = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    tested = [d for d in truth if held_out(d)]
    assert len(got) == len(truth) and np.mean([got[d]["lang_pred"] == truth[d] for d in tested]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_on_odd_rows(documents, no_documents):
    texts = ["der die das und nicht ist", "the and of that with is", "und der die", "of the and", None, "", "12 !?", "🙂", "the" * 50_000, "the and of"]
    langs = ["de", "en", "de", "en", "de", None, "en", None, None, None]
    docs = documents(texts, ids=[0, 1, 3, 4, 5, 6, None, 8, 9, 9], langs=langs)
    rows = language.identify(docs, language.learn(docs)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by[5] == by[6] == by[None] == by[8] == [("und", 0.0)]
    assert by[0][0][0] == "de" and by[1][0][0] == "en" and {p for p, _ in by[9]} == {"en"}
    bare = documents(texts, ids=range(10))
    assert {r["lang_pred"] for r in language.identify(bare, language.learn(bare)).collect()} == {"und"}
    assert language.identify(no_documents, language.learn(docs)).count() == 0
    assert language.learn(no_documents) is None


def plain_features(text):
    """The features one character and one word at a time."""
    import math
    import statistics

    out = np.zeros(quality.N_FEATURES)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    n_kinds = len(quality._CLASSES) + 2

    def kind(byte):
        for k, own in enumerate(quality._CLASSES):
            if byte in own:
                return k
        return n_kinds - 2 if byte < 128 else n_kinds - 1

    kinds = [kind(b) for b in raw]
    for k in range(n_kinds):
        out[k] = math.sqrt(kinds.count(k) / len(kinds))
        for m in range(n_kinds):
            both = sum(a == k and b == m for a, b in zip(kinds, kinds[1:]))
            out[n_kinds + k * n_kinds + m] = math.sqrt(both / (len(kinds) - 1)) if len(kinds) > 1 else 0
    at, words, lines = n_kinds + n_kinds**2, raw.split(), [x for x in raw.split(b"\n") if x]
    if words:
        sizes = [len(w) for w in words]
        distinct = len(set(words)) / len(words)
        out[at : at + 7] = [
            math.log(1 + len(words)), distinct, distinct * math.log(1 + len(words)), statistics.mean(sizes) / 10, statistics.pstdev(sizes) / 10,
            sum(s == 1 for s in sizes) / len(sizes), sum(s > 20 for s in sizes) / len(sizes),
        ]
    if lines:
        out[at + 7 : at + 10] = 1 - len(set(lines)) / len(lines), math.log(1 + len(lines)), math.log(1 + len(raw) / len(lines))
    out[at + 10 :] = math.log(1 + len(raw)), 1
    return out


def test_features_equal_plain_loops():
    texts = [None, "", "a", "\n", " \n\n x", "Hello, World! 12%\nHello, World! 12%\n<b>é日</b>\x00\x7f", "z" * 50 + " one one ONE", "don't {a|b} #1 @you a/b+c~d"]
    for text in texts:
        assert quality.features(text) == pytest.approx(plain_features(text)), text


def test_smallest_hashes_of_a_busy_language(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, "en").otherwise(F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))).alias("lang"), F.xxhash64("id").alias("h"))
    got = language._smallest_hashes(rows, 600)
    by = {}
    for r in rows.collect():
        by.setdefault(r["lang"], []).append(r["h"])
    assert got == {k: sorted(v)[:600][-1] for k, v in by.items()}
    assert language._smallest_hashes(rows.limit(3), 600) and language._smallest_hashes(rows.limit(0), 600) == {}
