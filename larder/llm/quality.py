"""Quality score from pairwise preferences (Bradley-Terry).

Labelled documents give preference pairs: one marked 1 is preferred to one marked 0. The model is
``P(a over b) = sigmoid(s(a) - s(b))`` with a linear score ``s = w . x`` of text features, so ``w`` minimises the logistic
loss on feature differences plus a ridge term (Newton's method). The score has no natural zero: the cut is a quantile of the
scores of all labelled documents outside the held-out fold, at the share of label 0 among them, in the middle between its two
neighbours. Reported scores are ``sigmoid(s - cut + logit(THRESHOLD))``, so that a score reaches the threshold exactly if ``s``
reaches the cut.

Features are computed from the whole text in numpy: the share of every byte value class, of pairs of neighbouring classes,
word and line statistics. Nothing but the text enters. The weights come from at most ``FIT_ROWS`` labelled rows of each label, those
with the smallest hash of ``doc_id``; the tasks compute their features, and only these few fixed-size rows reach the driver.
For the cut every document is scored once, only ids and scores are joined with the labels, and the two neighbours of the
quantile are found exactly by counting prefixes of the scores. Scoring is one pass over the documents without a shuffle.

Defined cases: NULL and empty texts have all-zero features and get the score of that point; without a label of either kind
every score is 0.5 plus nothing to learn from (weights 0, cut 0, so sigmoid(logit(THRESHOLD))); repeated rows are scored row
by row; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.context import materialize
from larder.llm.batches import as_text

#: Bound of the labelled rows that the weights are fitted on, for each label.
FIT_ROWS = 3_000
#: Preference pairs of a fit: each side's rows are dealt out evenly.
FIT_PAIRS = 12_000
RIDGE = 0.02
THRESHOLD = 0.7

_CLASSES = [b"\n", b" ", b".,;:", b"!", b"?", b"'\"`", b"()[]{}<>", b"|", b"*", b"#", b"%", b"$", b"&", b"@", b"-_", b"/\\", b"+=~^",
            b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"]
_N = len(_CLASSES) + 2  # other ASCII, other bytes
_TABLE = np.full(256, _N - 1, dtype=np.uint8)
_TABLE[:128] = _N - 2
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c)] = _i
N_FEATURES = _N + _N * _N + 12


def features(text: str | None) -> np.ndarray:
    """A fixed-length vector for one text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    kind = _TABLE[np.frombuffer(raw, dtype=np.uint8)]
    n = len(kind)
    single = np.bincount(kind, minlength=_N)
    out[:_N] = np.sqrt(single / n)
    if n > 1:
        pair = np.bincount(kind[:-1].astype(np.int16) * _N + kind[1:], minlength=_N * _N)
        out[_N : _N + _N * _N] = np.sqrt(pair / (n - 1))
    words = raw.split()
    lines = raw.split(b"\n")
    k = _N + _N * _N
    if words:
        length = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        distinct = len(set(words)) / len(words)
        out[k : k + 7] = (math.log1p(len(words)), distinct, distinct * math.log1p(len(words)), length.mean() / 10, length.std() / 10,
                          (length == 1).mean(), (length > 20).mean())
    filled = [x for x in lines if x]
    if filled:
        out[k + 7 : k + 10] = (1 - len(set(filled)) / len(filled), math.log1p(len(filled)), math.log1p(n / len(filled)))
    out[k + 10] = math.log1p(n)
    out[k + 11] = 1.0
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights on raw features, and the score at the cut."""

    weights: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        z = np.clip(x @ self.weights - self.cut, -60, 60)
        s = 1 / (1 + np.exp(-(z + shift)))
        return np.where(z >= 0, np.maximum(s, THRESHOLD), np.minimum(s, np.nextafter(THRESHOLD, 0)))


def pairs(n_good: int, n_bad: int, wanted: int = FIT_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (preferred, other) that use every row of both sides about equally often, without repeats."""
    count = min(wanted, n_good * n_bad)
    i = np.arange(count)
    turn = i // math.lcm(n_good, n_bad) if n_good and n_bad else i
    return i % max(n_good, 1), (i + turn) % max(n_bad, 1)


def fit(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> Ranking:
    """Fit on the feature rows of documents marked 1 and 0."""
    width = N_FEATURES if not len(good) + len(bad) else (good if len(good) else bad).shape[1]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), 0.0)
    both = np.vstack([good, bad])
    scale = both.std(axis=0)
    scale[scale < 1e-6] = np.inf  # a constant says nothing
    a, b = pairs(len(good), len(bad))
    d = (good[a] - bad[b]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # probability of the wrong order
        gradient = d.T @ p / len(d) - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    s = np.sort(both @ w)
    at = len(bad)  # the quantile at the share of label 0
    return Ranking(w, float((s[at - 1] + s[at]) / 2))


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"label": frame["label"].array, "x": [features(t).tobytes() for t in frame["text"]]})


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Ranking:
    """Fit from the labelled documents outside the held-out fold."""
    usable = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    place = F.xxhash64("doc_id")
    cuts = {}
    for value in (0, 1):  # two bounded lists of hashes
        head = usable.filter(F.col("label") == value).select(place.alias("h")).orderBy("h").limit(rows)
        cuts[value] = head.agg(F.max("h")).first()[0]
    chosen = F.lit(False)
    for value, cut in cuts.items():
        if cut is not None:
            chosen = chosen | ((F.col("label") == value) & (place <= cut))
    some = usable.filter(chosen).distinct()  # at most 2 * FIT_ROWS ids
    x = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text").mapInPandas(_vectors, "label int, x binary")
    got = sorted((r["label"], bytes(r["x"])) for r in x.collect())  # 2 * FIT_ROWS rows of fixed width, but for repeated ids
    side = lambda v: np.frombuffer(b"".join(b for k, b in got if k == v)).reshape(-1, N_FEATURES)
    model = fit(side(1), side(0))
    return replace(model, cut=cut_of_all(docs, usable.distinct(), model)) if model.weights.any() else model


def _ranks(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 512):
                part = frame.iloc[i : i + 512]
                s = np.array([features(t) for t in part["text"]]) @ shared.value
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "rank": as_ranks(s)})

    return run


def as_ranks(scores: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores."""
    bits = (np.asarray(scores, dtype=float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def as_score(rank: int) -> float:
    bits = np.array([rank], dtype=np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(float)[0])


def ranks_at(ranks: DataFrame, places: list[int]) -> list[int]:
    """The values of the long column ``rank`` at these places of its order, 16 bits at a time: at most 2^16 counts reach the driver."""
    state = [(None, p) for p in places]
    for shift in (48, 32, 16, 0):
        head = F.shiftright("rank", shift)
        known = sorted({k for k, _ in state if k is not None})
        part = ranks.filter(F.shiftright("rank", shift + 16).isin(known)) if known else ranks
        counts = sorted((r["head"], r["n"]) for r in part.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).collect())
        found = []
        for above, place in state:
            for value, n in counts:
                if above is not None and value >> 16 != above:
                    continue
                if place < n:
                    break
                place -= n
            found.append((value, place))
        state = found
    return [value for value, _ in state]


def cut_of_all(docs: DataFrame, usable: DataFrame, model: Ranking) -> float:
    """The quantile of the scores of all rows with a usable label, at the share of label 0 among them."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    kind = docs.schema["doc_id"].dataType
    scored = docs.select(as_text("doc_id"), "text").mapInPandas(_ranks(shared), "doc_id string, rank long")
    scored = scored.withColumn("doc_id", F.col("doc_id").cast(kind))
    ranks = materialize(scored.join(usable, "doc_id").select("label", "rank"), "quality-scores")
    bad = ranks.filter("label = 0").count()
    low, high = ranks_at(ranks, [bad - 1, bad])
    return (as_score(low) + as_score(high)) / 2


def score(text: Column, model: Ranking) -> Column:
    """The quality score of a text column."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for i in range(0, len(texts), 512):
            part = texts.iloc[i : i + 512]
            out[i : i + len(part)] = model.scores(np.array([features(t) for t in part]))
        return pd.Series(out)

    return run(text)


def assess(docs: DataFrame, model: Ranking) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
