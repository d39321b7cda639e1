"""Language identification with a string kernel.

Two texts are compared by the character n-grams (n = 1 to 4) that both contain: the blended-spectrum presence kernel
``k(a, b) = |A and B| / sqrt(|A| |B|)`` on the sets of hashed n-grams of the whole, lower-cased texts. The Nystroem method
makes the kernel linear: with landmark texts L, a text becomes ``phi = k(text, L) K(L, L)^(-1/2)``. On these vectors
one-versus-rest kernel ridge regression is a linear solve with targets +1 and -1. The language with the largest output wins;
its score is that output taken from [-1, 1] to [0, 1].

Scoring is one pass without a shuffle: each batch becomes a presence matrix over the n-grams that occur in a landmark, and
two matrix products give all outputs of the batch. The model (landmark n-grams, one small matrix) has a fixed size.

Learning uses only rows with a language outside the held-out fold, and of these, for each language, the ``FIT_ROWS`` rows
with the smallest hash of ``doc_id``; the first ``LANDMARKS`` of them are that language's landmarks. Whole texts are read.
Of fit rows, tasks return kernel rows of fixed width, so the driver holds a bounded number of short vectors.

Defined cases: a text that is NULL or holds no letter is ``und`` with score 0; without any labelled row every text is ``und``
with score 0; ties between languages go to the first in alphabetical order; repeated rows are predicted row by row; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.context import materialize
from larder.llm.quality import held_out

MAX_N = 4
BUCKETS = 1 << 16
#: Bounds for each language: landmark texts, and rows that the regression is fitted on.
LANDMARKS = 24
FIT_ROWS = 600
RIDGE = 1e-3
UNDETERMINED = "und"
_ODD = np.uint32(2654435761)


def gram_flags(text: str) -> np.ndarray:
    """Which hashed n-grams the text contains."""
    flags = np.zeros(BUCKETS, dtype=bool)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.zeros(len(points) + 1, dtype=np.uint32)[: len(points)]
    for n in range(1, MAX_N + 1):
        if len(points) < n:
            break
        m = len(points) - n + 1
        code = code[:m] * np.uint32(1_000_003) + points[n - 1 :] + np.uint32(n)
        flags[((code * _ODD) ^ (code >> np.uint32(15))) >> np.uint32(16)] = True
    return flags


@dataclass(frozen=True)
class KernelModel:
    """``columns`` are the buckets of all landmarks, ``landmarks`` their scaled presence, ``weights`` landmark to language."""

    languages: tuple[str, ...]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, texts) -> np.ndarray:
        """Kernel values (texts x landmarks) of a batch, as one matrix product."""
        x = np.zeros((len(texts), len(self.columns)), dtype=np.float32)
        for i, t in enumerate(texts):
            flags = gram_flags(t)
            x[i] = flags[self.columns]
            x[i] *= 1 / np.sqrt(max(1, np.count_nonzero(flags)))
        return x @ self.landmarks

    def outputs(self, texts) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def landmark_model(languages: list[str], texts: list[str]) -> KernelModel:
    """The kernel against the landmark texts; weights are still empty."""
    flags = np.array([gram_flags(t) for t in texts])
    columns = np.flatnonzero(flags.any(axis=0))
    scaled = (flags / np.sqrt(np.maximum(1, flags.sum(axis=1)))[:, None])[:, columns]
    return KernelModel(tuple(languages), columns, np.ascontiguousarray(scaled.T, dtype=np.float32), np.zeros((len(texts), len(languages)), np.float32))


def fit(model: KernelModel, kernel: np.ndarray, lang: np.ndarray, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression in the Nystroem space, one output for each language."""
    among = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel.astype(np.float64) @ root
    target = np.where(lang[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    return KernelModel(model.languages, model.columns, model.landmarks, (root @ weights).astype(np.float32))


def _smallest_hashes(hashes: DataFrame, k: int) -> dict[str, int]:
    """For each language the k-th smallest of its hashes (lang, h): one number per language reaches the driver.

    Hashes are first counted by their upper 12 bits, so that only those up to the k-th are ranked, however many rows a language has.
    """
    head = F.shiftright("h", 52)
    counts = hashes.groupBy("lang", head.alias("head")).agg(F.count(F.lit(1)).alias("n"))  # at most 4,096 a language
    before = F.sum("n").over(W.partitionBy("lang").orderBy("head").rowsBetween(W.unboundedPreceding, -1))
    reached = counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < k)
    near = F.lit(False)
    for r in reached.groupBy("lang").agg(F.max("head").alias("last")).collect():
        near = near | ((F.col("lang") == r["lang"]) & (head <= r["last"]))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    head = hashes.filter(near).select("lang", "h").withColumn("r", rank).filter(F.col("r") <= k)
    return {r["lang"]: r["cut"] for r in head.groupBy("lang").agg(F.max("h").alias("cut")).collect()}


def _kernel_rows(model: KernelModel):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 256):
                part = frame.iloc[i : i + 256]
                yield pd.DataFrame({"lang": part["lang"].array, "k": [r.tobytes() for r in model.kernel(part["text"])]})

    return run


def learn(docs: DataFrame, landmarks: int = LANDMARKS, rows: int = FIT_ROWS) -> KernelModel | None:
    """Fit from the rows of known language outside the held-out fold; None if there are none."""
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    ).withColumn("h", F.xxhash64("doc_id"))

    hashes = materialize(usable.select("lang", "h"), "language-hashes")

    def below(k: int) -> DataFrame:
        chosen = F.lit(False)
        for lang, cut in _smallest_hashes(hashes, k).items():
            chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= cut))
        return usable.filter(chosen)

    first = sorted((r["lang"], r["text"]) for r in below(landmarks).select("lang", "text").collect())  # LANDMARKS each
    if not first:
        return None
    model = landmark_model(sorted({lang for lang, _ in first}), [t for _, t in first])
    got = sorted((r["lang"], bytes(r["k"])) for r in below(rows).mapInPandas(_kernel_rows(model), "lang string, k binary").collect())
    kernel = np.frombuffer(b"".join(k for _, k in got), dtype=np.float32).reshape(len(got), -1)
    return fit(model, kernel, np.array([lang for lang, _ in got]))


def predict(text: Column, model: KernelModel | None) -> Column:
    """struct(lang_pred, score) of a text column."""
    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score = [], []
        for i in range(0, len(texts), 256):
            out = model.outputs([t or "" for t in texts.iloc[i : i + 256]])
            best = out.argmax(axis=1)
            lang += [model.languages[b] for b in best]
            score += np.clip((out[np.arange(len(out)), best].astype(float) + 1) / 2, 0, 1).tolist()
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), run(text)).otherwise(nothing)


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
