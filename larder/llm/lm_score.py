"""Language-model score by masked pseudo-likelihood.

A window network predicts every word from ``SIDE`` words on both sides: each neighbour's embedding is weighted by a vector of its
offset, the sum passes tanh, and a softmax over groups of numbers and one over the numbers of the group follow. A number is one frequent word or a class of
others; a word's probability is that of its number times its share of the class, ``n(word) / (n(class) + 1)`` by the counts of all
documents, where a word that was never counted has the share ``1 / (n(class) + 1)``. A document's score is the sum of the
logarithms of these conditional probabilities, with every word masked in turn; the mean per word makes lengths comparable.

Words are runs of bytes other than white space and punctuation, in ASCII lower case, and are handled as 64-bit hashes. The
vocabulary comes from counts over all documents: the ``KNOWN`` most frequent words (ties by hash), and ``CLASSES`` hash classes
for all others. Counting is a grouped sum with partial sums in the map tasks. The counts of the most frequent words
(at most ``COMMON``, 16 MB) are broadcast; if there are more words, those left over in a document are joined with their counts.

Training is local gradient descent with averaging. In each round every task starts from the shared parameters, visits each of its
documents with every ``rounds``-th position as a target (another phase each round), and returns its parameters with the number of
targets. So over the rounds every position of every document is a target once. The parameters are averaged in ``GATHER`` groups by a shuffle, and these few vectors on the driver. What is gathered grows with them, and what the driver and the broadcast hold has the size of the network. The model depends
on how documents are dealt to tasks, as local training does; for the same files it is the same.

Defined cases: NULL and blank texts have no words, sum 0 and NULL mean; a document of one word is predicted from padding;
repeated rows are trained and scored as often as they occur; very long texts are scored whole, in bounded pieces; on an empty table nothing is trained and no row is returned; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.llm.batches import as_text
from larder.llm.jaccard import mix, word_hashes

KNOWN, CLASSES = 768, 256
#: Numbers in a group of the output.
MEMBERS = 32
#: Words whose counts are broadcast; the counts of rarer ones are joined.
COMMON = 1_000_000
SIDE, WIDTH = 2, 16
ROUNDS, BATCH, RATE = 2, 2048, 4.0
GATHER = 32
#: Positions that are scored at once.
CHUNK = 8192
_GAP = np.zeros(256, dtype=bool)
_GAP[list(b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}|*#%$&")] = True


def words(text: str | None) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    return mix(word_hashes(text, _GAP))


@dataclass(frozen=True)
class Vocabulary:
    """Numbers of words: ``known`` (rising hashes) come first, then hash classes.

    ``common`` (rising hashes) are words of the classes with the logarithms of their counts, ``class_logs`` the logarithm of each
    class's total and one, ``counts`` the table of all counts if ``common`` does not hold every word.
    """

    known: np.ndarray
    classes: int = CLASSES
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    common_logs: np.ndarray = field(default_factory=lambda: np.empty(0))
    class_logs: np.ndarray | None = None
    counts: DataFrame | None = None

    def __len__(self) -> int:
        return len(self.known) + self.classes

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        other = (len(self.known) + hashes % np.uint64(self.classes)).astype(np.int32)
        if not len(self.known):
            return other
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at.astype(np.int32), other)

    def ids(self, text: str | None) -> np.ndarray:
        return self.numbers(words(text))

    def shares(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each word's share of its class (0 for known words), and the places of words whose counts are not here (taken as 1)."""
        out = np.zeros(len(hashes))
        other = np.flatnonzero(ids >= len(self.known))
        if self.class_logs is None or not len(other):
            return out, other[:0]
        out[other] = -self.class_logs[ids[other] - len(self.known)]
        if not len(self.common):
            return out, other
        h, where = np.unique(hashes[other], return_inverse=True)  # few searches in a large table
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        held = self.common[at] == h
        out[other] += np.where(held, self.common_logs[at], 0.0)[where]
        return out, other[~held[where]]


@dataclass
class Network:
    """A number's probability is that of its group (of ``MEMBERS`` numbers) times its own within the group.

    ``embed`` has one row more than the vocabulary, for padding. ``out`` holds a matrix per group; members beyond the vocabulary have
    a bias that leaves them no probability.
    """

    embed: np.ndarray
    offset: np.ndarray
    bias: np.ndarray
    groups: np.ndarray
    groups_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, size: int, frequency: np.ndarray | None = None, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = -(-size // MEMBERS)
        share = np.zeros(n * MEMBERS)
        share[:size] = 1 / size if frequency is None else frequency
        share = share.reshape(n, MEMBERS)
        with np.errstate(divide="ignore"):
            within = np.maximum(np.log(share / share.sum(axis=1, keepdims=True)), -1e4)
        parts = (
            r.normal(size=(size + 1, WIDTH)) * 0.3, np.full((2 * SIDE, WIDTH), 0.5), np.zeros(WIDTH), r.normal(size=(WIDTH, n)) * 0.1,
            np.log(share.sum(axis=1)), r.normal(size=(n, WIDTH, MEMBERS)) * 0.1, within,
        )
        return cls(*(x.astype(np.float32) for x in parts))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.offset, self.bias, self.groups, self.groups_bias, self.out, self.out_bias]

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def unpack(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32).copy())
            at += x.size
        return Network(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """tanh of the weighted sum of neighbours (positions x 2 SIDE numbers)."""
        total = self.bias + self.embed[context[:, 0]] * self.offset[0]
        for o in range(1, context.shape[1]):
            total += self.embed[context[:, o]] * self.offset[o]
        return np.tanh(total)

    def members(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Logits inside each position's group, for positions in order of their groups, and the runs of equal groups."""
        cuts = np.searchsorted(group, np.arange(len(self.out) + 1)).tolist()
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        logit = np.empty((len(h), MEMBERS), np.float32)
        for k, a, b in spans:
            np.matmul(h[a:b], self.out[k], out=logit[a:b])
            logit[a:b] += self.out_bias[k]
        return logit, spans

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        result = np.empty(len(target))
        for i in range(0, len(target), CHUNK):
            own = target[i : i + CHUNK]
            order = np.argsort(own, kind="stable")
            group, member = np.divmod(own[order], MEMBERS)
            h = self.hidden(context[i : i + CHUNK][order])
            inner, _ = self.members(h, group)
            total = np.zeros(len(own))
            for logit, at in ((h @ self.groups + self.groups_bias, group), (inner, member)):
                logit -= logit.max(axis=1)[:, None]
                total += logit[np.arange(len(at)), at]
                total -= np.log(np.exp(logit, out=logit).sum(axis=1))
            result[i + order] = total
        return result

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One step of gradient descent on a batch, in place."""
        order = np.argsort(target, kind="stable")
        context, (group, member) = context[order], np.divmod(target[order], MEMBERS)
        rows = np.arange(len(target))
        h = self.hidden(context)
        inner, spans = self.members(h, group)
        outer = h @ self.groups + self.groups_bias
        for logit, at in ((outer, group), (inner, member)):
            logit -= logit.max(axis=1)[:, None]
            np.exp(logit, out=logit)
            logit *= (rate / len(target) / logit.sum(axis=1))[:, None]
            logit[rows, at] -= rate / len(target)
        back = outer @ self.groups.T
        for k, a, b in spans:
            part = inner[a:b]
            back[a:b] += part @ self.out[k].T
            self.out[k] -= h[a:b].T @ part
            self.out_bias[k] -= part.sum(axis=0)
        self.groups -= h.T @ outer
        self.groups_bias -= outer.sum(axis=0)
        back *= 1 - h * h
        self.bias -= back.sum(axis=0)
        scale = 8.0  # a word stands in few of a batch's contexts, so its embedding moves faster
        size = self.embed.size
        column = np.arange(WIDTH)
        moved = np.zeros(size)
        for o in range(context.shape[1]):
            at = context[:, o]
            moved += np.bincount((at[:, None] * WIDTH + column).ravel(), (back * self.offset[o]).ravel(), size)
            self.offset[o] -= (back * self.embed[at]).sum(axis=0)
        self.embed -= (scale * moved).reshape(self.embed.shape).astype(np.float32)


def contexts(ids: np.ndarray, pad: int) -> np.ndarray:
    """The neighbours of every position (positions x 2 SIDE), padded at both ends."""
    wide = np.concatenate([np.full(SIDE, pad, np.int32), ids, np.full(SIDE, pad, np.int32)])
    return _around(wide, np.arange(SIDE, SIDE + len(ids)))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, waiting = [], 0

    def counted() -> pd.DataFrame:
        found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return pd.DataFrame({"word": found.view(np.int64), "n": n})

    for frame in frames:
        for text in frame["text"]:
            h = words(text)
            held.append(h)
            waiting += len(h)
            if waiting > 4_000_000:  # bounded memory; the grouped sum adds the pieces up
                yield counted()
                held, waiting = [], 0
    yield counted()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word (hash), n`` over all documents."""
    return docs.select("text").mapInPandas(_count, "word long, n long").groupBy("word").agg(F.sum("n").cast("long").alias("n"))


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        word, n = (frame[c].to_numpy(np.int64) for c in ("word", "n"))
        yield pd.DataFrame({"words": [word.tobytes()], "n": [n.tobytes()]})


def vocabulary(docs: DataFrame, known: int = KNOWN, common: int | None = None) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the relative frequency of each number."""
    common = COMMON if common is None else common
    counts = materialize(word_counts(docs), "word-counts")
    top = sorted(counts.orderBy(F.desc("n"), "word").limit(known).collect(), key=lambda r: r["word"] % 2**64)
    listed = [r["word"] for r in top]
    rest = counts.filter(~F.col("word").isin(listed)) if listed else counts
    kind = F.col("word").bitwiseAND(CLASSES - 1)  # CLASSES is a power of two
    by_class = {int(r["k"]): r["n"] for r in rest.groupBy(kind.alias("k")).agg(F.sum("n").alias("n")).collect()}
    level = F.floor(F.log2("n") * 16)  # at most 1,024 levels of frequency
    levels = sorted(((r["level"], r["count"]) for r in rest.groupBy(level.alias("level")).count().collect()), reverse=True)
    reach = np.cumsum([size for _, size in levels])
    kept = int((reach <= common).sum())
    held = rest if kept == len(levels) else rest.filter(level >= levels[kept - 1][0]) if kept else rest.limit(0)
    frame = held.select("word", "n").mapInPandas(_packed, "words binary, n binary").collect()  # 16 bytes a word
    word = np.concatenate([np.frombuffer(bytes(r["words"]), np.uint64) for r in frame] or [np.empty(0, np.uint64)])
    logs = np.log(np.concatenate([np.frombuffer(bytes(r["n"]), np.int64) for r in frame] or [np.empty(0, np.int64)]))
    order = np.argsort(word)
    names = Vocabulary(
        np.array([w % 2**64 for w in listed], dtype=np.uint64), CLASSES, word[order], logs[order],
        np.log([by_class.get(k, 0) + 1 for k in range(CLASSES)]), None if kept == len(levels) else counts,
    )
    n = np.array([r["n"] for r in top] + [by_class.get(k, 0) for k in range(CLASSES)], dtype=float) + 1
    return names, n / n.sum()


def _encode(shared):
    """Numbers of the words (two bytes each), the shares of their classes, and the words whose counts are not here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, whole = shared.value
        row = TaskContext.get().partitionId() << 40
        for frame in frames:
            for i in range(0, len(frame), 256):
                part = frame.iloc[i : i + 256]
                hashes = [words(t) for t in part["text"]]
                size = np.array([len(h) for h in hashes])
                doc = np.repeat(np.arange(len(part)), size)
                flat = np.concatenate(hashes)
                ids = names.numbers(flat)
                share, unknown = names.shares(flat, ids)
                totals = np.bincount(doc, share, len(part))
                cut = np.searchsorted(doc[unknown], np.arange(1, len(part)))
                rare = [b""] * len(part) if whole else [x.tobytes() for x in np.split(flat[unknown], cut)]
                numbers = [x.tobytes() for x in np.split(ids.astype(NUMBER), np.cumsum(size)[:-1])]
                yield pd.DataFrame({"row": np.arange(row, row + len(part)), "doc_id": part["doc_id"].array, "n_words": size, "ids": numbers, "share": totals, "rare": rare})
                row += len(part)

    return run


#: Numbers on disk.
NUMBER = "<u2"
ENCODED = "row long, doc_id string, n_words long, ids binary, share double, rare binary"


def encoded(docs: DataFrame, names: Vocabulary) -> DataFrame:
    """Every document as numbers, stored: texts are tokenised here and, for the counts, once before."""
    if len(names) > 1 << 16:
        raise ValueError("numbers are kept in two bytes")
    shared = docs.sparkSession.sparkContext.broadcast((replace(names, counts=None), names.counts is None))
    return materialize(docs.select(as_text("doc_id"), "text").mapInPandas(_encode(shared), ENCODED), "word-numbers")


def _joined(frame: pd.DataFrame, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all documents of a batch with padding around each, places of the words in them)."""
    raw = np.frombuffer(b"".join(frame["ids"]), NUMBER).astype(np.int32)
    size = frame["n_words"].to_numpy(np.int64)
    place = np.arange(len(raw)) + SIDE * (2 * np.repeat(np.arange(len(size)), size) + 1)
    wide = np.full(len(raw) + 2 * SIDE * len(size), pad, np.int32)
    wide[place] = raw
    return wide, place


def _around(wide: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.stack([wide[place + o] for o in range(-SIDE, SIDE + 1) if o], axis=1)


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of about 300,000 words, or one document."""
    for frame in frames:
        total = frame["n_words"].cumsum().to_numpy()
        cuts = np.flatnonzero(np.diff(total // 300_000, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            if a < b:
                yield frame.iloc[a:b]


def _train(shared, phase: int, step_width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = shared.value
        net, pad, seen = start.unpack(start.pack()), len(start.embed) - 1, 0
        rest: tuple[np.ndarray, np.ndarray] = (np.empty((0, 2 * SIDE), np.int32), np.empty(0, np.int32))
        for frame in _pieces(frames):
            wide, place = _joined(frame, pad)
            size = frame["n_words"].to_numpy(np.int64)
            inside = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
            place = place[inside % step_width == phase]
            context, target = (np.concatenate(x) for x in zip(rest, (_around(wide, place), wide[place]), strict=True))
            full = len(target) // BATCH * BATCH
            for i in range(0, full, BATCH):
                net.learn(context[i : i + BATCH], target[i : i + BATCH])
            seen += full
            rest = context[full:], target[full:]
        if len(rest[1]):
            net.learn(*rest)
            seen += len(rest[1])
        if seen:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % GATHER], "n": [float(seen)], "net": [(net.pack().astype(np.float64) * seen).tobytes()]})

    return run


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = None, 0.0
    for frame in frames:
        for count, flat in zip(frame["n"], frame["net"], strict=True):
            x = np.frombuffer(flat)
            total, n = (x.copy() if total is None else total + x), n + count
    if total is not None:
        yield pd.DataFrame({"n": [n], "net": [total.tobytes()]})


def _trained(rows: DataFrame, net: Network, rounds: int) -> Network:
    texts = rows.select("n_words", "ids")
    for r in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(net)
        local = texts.mapInPandas(_train(shared, r, rounds), "slot int, n double, net binary")
        got = local.repartition(GATHER, "slot").mapInPandas(_add, "n double, net binary").collect()  # GATHER rows at most
        n = sum(x["n"] for x in got)
        if not n:
            break  # no position of this phase means none of a later one
        net = net.unpack(np.sum([np.frombuffer(bytes(x["net"])) for x in got], axis=0) / n)
    return net


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """A network trained on all documents."""
    names, frequency = vocabulary(docs)
    return names, _trained(encoded(docs, names), Network.start(len(names), frequency), rounds)


def _score(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for frame in _pieces(frames):
            wide, place = _joined(frame, len(net.embed) - 1)
            logs = net.log_probability(_around(wide, place), wide[place])
            doc = np.repeat(np.arange(len(frame)), frame["n_words"].to_numpy(np.int64))
            total = frame["share"].to_numpy() + np.bincount(doc, logs, len(frame))
            yield pd.DataFrame({"row": frame["row"], "doc_id": frame["doc_id"].array, "n_words": frame["n_words"], "log_probability": total})

    return run


def _rare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, word, times) of the words with unknown counts."""
    for frame in frames:
        word = np.frombuffer(b"".join(frame["rare"]), np.int64)
        row = np.repeat(frame["row"].to_numpy(), [len(x) // 8 for x in frame["rare"]])
        order = np.lexsort((word, row))
        word, row = word[order], row[order]
        first = np.flatnonzero((np.diff(word, prepend=0) != 0) | (np.diff(row, prepend=-1) != 0))
        yield pd.DataFrame({"row": row[first], "word": word[first], "times": np.diff(first, append=len(word))})


def _scored(rows: DataFrame, names: Vocabulary, net: Network, kind) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(net)
    out = rows.select("row", "doc_id", "n_words", "ids", "share").mapInPandas(_score(shared), "row long, doc_id string, n_words long, log_probability double")
    if names.counts is not None:
        rare = rows.filter(F.length("rare") > 0).select("row", "rare")
        rare = rare.repartition(F.xxhash64("row")).mapInPandas(_rare, "row long, word long, times long")
        more = rare.join(names.counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
        out = out.join(more, "row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "log_probability", mean.alias("mean_log_probability"))


def pseudo_likelihood(docs: DataFrame, names: Vocabulary, net: Network) -> DataFrame:
    """``doc_id, n_words, log_probability, mean_log_probability`` of every row."""
    return _scored(encoded(docs, names), names, net, docs.schema["doc_id"].dataType)


def train_and_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pseudo_likelihood`` of the documents that the network is trained on, which are tokenised once for both."""
    names, frequency = vocabulary(docs)
    rows = encoded(docs, names)
    return _scored(rows, names, _trained(rows, Network.start(len(names), frequency), rounds), docs.schema["doc_id"].dataType)
