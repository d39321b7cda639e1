"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which tokens of another.

A whole text is encoded by both tokenizers, and the tokens' bytes are checked against the text. Places where a token ends on both
sides and the next token of each side begins with a blank are anchors. They split the text into windows of (ids of A, ids of B),
mostly one word each. What a window holds depends on its ids alone, so every distinct window is aligned once per worker and remembered
under the tuple of its ids; an anchor is an end of both sides, so no group or link crosses it.

Three passes. The first writes one row per document: its numbers, its groups (or their digest) and its distinct linked id pairs with
how often it holds them. The second adds these up to a table of id pairs. The third takes each document's pairs to that table: the
commonest ``COMMON`` pairs travel to the tasks as a broadcast of at most that many entries (13 bytes each, whatever the corpus), all
rarer pairs are exploded and joined. Texts are encoded once and never shuffled.

Defined cases: a NULL or empty text, or one whose tokens on either side do not spell the blank plus the text (a tokenizer that
normalises), has no tokens: zeros and an empty ``groups``. A NULL or repeated ``doc_id`` is kept, each row on its own. Very long
texts are encoded whole; a window of a text without blanks may be the whole text, and the remembered windows are bounded by bytes.
Ties for the highest count of a B id all count as best. An empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.llm.tokenizers import TokenizerFile

#: Characters of text that are aligned at once, or one text if it is longer.
CHUNK_CHARS = 500_000
#: Bytes of remembered words and windows per worker; beyond that what was used once is forgotten.
MEMORY_BYTES = 256 << 20
#: Pairs in the broadcast table.
COMMON = 1 << 21
#: Distinct pairs that a counting task holds before it hands them on.
HELD_PAIRS = 1 << 20
#: Added to the ids of B inside a window's key, so that the two tuples cannot be mistaken for each other.
B_MARK = 1 << 31


@dataclass(frozen=True)
class Vocabulary:
    """The bytes of every token, by id."""

    entries: list[bytes]
    lengths: np.ndarray
    spaced: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Vocabulary:
        lengths = np.array([len(x) for x in entries], np.int64)
        return cls(entries, lengths, np.array([x[:1] == b" " for x in entries]))


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def open_tokenizer(file: TokenizerFile):
    """(encode, vocabulary): ``encode`` gives the ids of blank + text for each text; special strings are plain text.

    ``.json`` must be byte-level, ``.model`` adds the blank by itself.
    """
    if file.kind == "json":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(file.data.decode("utf-8"))
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True
        letters, special = _byte_letters(), set(file.special_tokens())
        entries = [b""] * t.get_vocab_size()
        for token, i in t.get_vocab().items():
            known = token not in special and all(c in letters for c in token)
            entries[i] = bytes(letters[c] for c in token) if known else token.encode("utf-8")
        return lambda texts: [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], Vocabulary.of(entries)
    if file.kind == "model":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=file.data)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        entries = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode("utf-8") for i, x in enumerate(pieces)]
        return lambda texts: p.encode(texts, num_threads=1), Vocabulary.of(entries)
    raise ValueError(f"no alignment for files of kind {file.kind}")


class Side:
    """One tokenizer and whether it encodes words apart: whether byte-level splitting, or a vocabulary without pieces that hold a blank
    behind another letter, keeps what stands on the two sides of a word's start from being joined."""

    def __init__(self, file: TokenizerFile):
        self.library, self.vocabulary = open_tokenizer(file)
        split = file.spec().get("pre_tokenizer") or {}
        if file.kind == "json":
            self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not file.spec().get("normalizer")
        else:
            self.by_word = not any(b" " in x.lstrip(b" ") for x in self.vocabulary.entries)

    def spells(self, ids: list[int], text: str) -> bool:
        entries = [self.vocabulary.entries[i] for i in ids]
        return b"".join(entries) == (" " + text).encode("utf-8") and all(entries)

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``one_by_one`` for words without white space at their ends: encoded as one text, at a fraction of the cost."""
        text = " ".join(words)
        ids = self.library([text])[0]
        flat = np.array(ids, np.uint32)
        stops = np.cumsum(self.vocabulary.lengths[flat])
        size = [len(w) for w in words] if text.isascii() else [len(w.encode("utf-8")) for w in words]
        wanted = np.cumsum(np.array(size) + 1)
        last = np.searchsorted(stops, wanted).clip(max=len(stops) - 1)
        if not (self.spells(ids, text) and np.array_equal(stops[last], wanted)):
            return self.one_by_one(words)
        return flat, np.diff(last, prepend=-1)

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of blank + word, one word after the other, and how many each has); -1 and no ids for a word they do not spell."""
        found = [ids if self.spells(ids, w) else None for ids, w in zip(self.library(words), words, strict=True)]
        flat = np.fromiter(itertools.chain.from_iterable(x for x in found if x is not None), np.uint32)
        return flat, np.array([-1 if x is None else len(x) for x in found], np.int64)


#: White space other than single blanks and line feeds between words; U+180E once was white space.
_UNUSUAL = ["  ", "\n ", " \n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_WORD_START = re.compile(r"(?<=[^\s\u180e]) ")


def _odd(word: str) -> bool:
    """True for a word that is no word: empty, or with white space at an end."""
    return not word or word != word.strip() or "\u180e" in (word[0], word[-1])


def _words(text: str) -> list[str]:
    """The text cut at every blank behind something else; these blanks are left out."""
    unusual = text[:1] in (" ", "\n") or any(x in text for x in _UNUSUAL)
    return _WORD_START.split(text) if unusual else text.split(" ")


def _filled(good: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values at the good places, -1 at the others."""
    out = np.full(len(good), -1, np.int64)
    out[good] = values
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of each range, one range after the other."""
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(counts.sum())


class Aligner:
    """Aligns texts of one worker, remembering the words and windows met so far.

    A text's tokens are those of its words, if both sides encode words apart, and every word begins with an anchor. So a word is
    encoded and cut into windows once, and a text is a list of windows. A text with a word that a side does not spell, and any text of
    a tokenizer that does not encode words apart, is encoded and cut as a whole.
    """

    def __init__(self, file_a: TokenizerFile, file_b: TokenizerFile, memory_bytes: int = MEMORY_BYTES):
        self.sides = Side(file_a), Side(file_b)
        self.a, self.b = (s.vocabulary for s in self.sides)
        self.by_word = all(s.by_word for s in self.sides)
        self.width = len(self.b.entries)
        self.names = [str(i) for i in range(max(len(self.a.entries), self.width))]
        self.memory_bytes = memory_bytes
        self._empty()

    def _empty(self) -> None:
        none = np.empty(0, np.int64)
        self.words: dict[str, int] = {}
        self.word_a, self.word_b, self.word_windows, self.uses = none, none, none, none  # tokens (-1: not spelled), windows, uses of each word
        self.of_words = none  # the windows of all words, one word after the other
        self.windows: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.n_groups, self.n_links, self.codes = none, none, np.empty(0, np.uint64)
        self.held = 0

    def _shrink(self) -> None:
        """Keep the words that are used again and again, at most the more used half, and their windows."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > len(self.uses) // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: len(self.uses) // 2]])
        start = np.cumsum(self.word_windows) - self.word_windows
        of_words = self.of_words[_ranges(start[kept], self.word_windows[kept])]
        stay, self.of_words = np.unique(of_words, return_inverse=True)
        names = list(self.words)  # in the order of their numbers
        self.words = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.word_a, self.word_b, self.word_windows = self.word_a[kept], self.word_b[kept], self.word_windows[kept]
        self.uses = self.uses[kept] // 2
        keys, at = list(self.windows), stay.tolist()
        self.windows = {keys[i]: n for n, i in enumerate(at)}
        self.texts = [self.texts[i] for i in at]
        place = np.cumsum(self.n_links) - self.n_links
        self.codes = self.codes[_ranges(place[stay], self.n_links[stay])]
        self.n_groups, self.n_links = self.n_groups[stay], self.n_links[stay]
        self.held = sum(map(len, self.words)) + 250 * len(self.words) + 400 * len(at) + 30 * len(self.codes)

    def _align(self, new: list[bytes]) -> None:
        """Align new windows, all in one go: the bytes between two neighbouring token ends belong to one token of each side."""
        raw = np.frombuffer(b"".join(new), np.uint32)
        window = np.repeat(np.arange(len(new)), [len(k) // 4 for k in new])
        of_a = raw < B_MARK
        a, b, window_a, window_b = raw[of_a], raw[~of_a] - np.uint32(B_MARK), window[of_a], window[~of_a]
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        shared = end_a[np.searchsorted(end_a, end_b).clip(max=len(end_a) - 1)] == end_b  # B tokens that close a group
        group_end = end_b[shared]
        self.n_links = np.concatenate([self.n_links, np.bincount(window_a[in_a], minlength=len(new))])
        self.n_groups = np.concatenate([self.n_groups, np.bincount(window_b[shared], minlength=len(new))])
        self.codes = np.concatenate([self.codes, a[in_a].astype(np.uint64) * np.uint64(self.width) + b[in_b].astype(np.uint64)])

        group_a, group_b = np.searchsorted(group_end, end_a), np.searchsorted(group_end, end_b)
        ids, groups = np.concatenate([a, b]), np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(groups, kind="stable")
        groups, own = groups[order], np.concatenate([window_a, window_b])[order]
        first = np.diff(groups, prepend=-1) > 0
        mark = np.where(~first, 0, np.where(groups % 2 == 1, 1, np.where(np.diff(own, prepend=-1) > 0, 3, 2)))
        said = [""] * (2 * len(ids))
        said[0::2] = map(",|;\n".__getitem__, mark.tolist())
        said[1::2] = map(self.names.__getitem__, ids[order].tolist())
        self.windows.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += "".join(said)[1:].split("\n")
        self.held += 400 * len(new) + 30 * len(raw)

    def _cut(self, all_a: np.ndarray, all_b: np.ndarray, tokens_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows of texts given as tokens of both sides, one text after the other, and how many each has).

        Both sides cover the same bytes of each text, of whose A tokens ``tokens_a`` tells the number.
        """
        start_a, start_b = (np.cumsum(v.lengths[x]) - v.lengths[x] for v, x in ((self.a, all_a), (self.b, all_b)))
        at_a, at_b = np.flatnonzero(self.a.spaced[all_a]), np.flatnonzero(self.b.spaced[all_b])
        place = np.searchsorted(start_b[at_b], start_a[at_a])
        place[place == len(at_b)] = 0
        shared = start_b[at_b[place]] == start_a[at_a]
        first_a, first_b = at_a[shared], at_b[place[shared]]  # anchors: where each window begins on each side
        n_a, n_b = np.diff(first_a, append=len(all_a)), np.diff(first_b, append=len(all_b))
        both = np.empty(len(all_a) + len(all_b), np.uint32)
        both[np.arange(len(all_a)) + np.repeat(first_b, n_a)] = all_a
        both[np.arange(len(all_b)) + np.repeat(first_a + n_a, n_b)] = all_b + np.uint32(B_MARK)
        raw, cuts = both.tobytes(), (4 * (first_a + first_b + n_a + n_b)).tolist()
        keys = [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
        new = [k for k in set(keys) if k not in self.windows]
        if new:
            self._align(new)
        window = np.fromiter(map(self.windows.__getitem__, keys), np.int64, len(keys))
        begins = np.concatenate([[0], np.cumsum(tokens_a)])
        return window, np.diff(np.searchsorted(first_a, begins))  # a text begins with a blank on both sides, so with a window

    def _spelled(self, words: list[str], encode: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(which words both sides spell, the ids and the numbers of ids of these on each side)."""
        found = [getattr(s, encode)(words) for s in self.sides]
        good = np.logical_and(*(count >= 0 for _, count in found))
        if good.all():
            return good, *map(list, zip(*found, strict=True))
        ids = [flat[np.repeat(good, count.clip(min=0))] for flat, count in found]
        return good, ids, [count[good] for _, count in found]

    def _learn(self, words: list[str], encode: str) -> None:
        learned = []
        for k in range(0, len(words), 2048):
            good, ids, count = self._spelled(words[k : k + 2048], encode)
            of_words, n = self._cut(*ids, count[0]) if good.any() else (np.empty(0, np.int64), count[0])
            learned.append((of_words, *(_filled(good, x) for x in (*count, n))))
        if learned:
            columns = (np.concatenate(x) for x in zip(*learned, strict=True))
            self.of_words, self.word_a, self.word_b, n = (np.concatenate(x) for x in zip((self.of_words, self.word_a, self.word_b, self.word_windows), columns, strict=True))
            self.word_windows = n.clip(min=0)
            self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
            self.held += 250 * len(words) + sum(map(len, words))

    def _numbered(self, words: list[str]) -> np.ndarray:
        if self.held > self.memory_bytes:
            self._shrink()
        found = list(map(self.words.get, words))
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            new = {words[i] for i in missing}
            odd = [w for w in new if _odd(w)]
            self._learn(list(new.difference(odd)), "together")
            self._learn(odd, "one_by_one")
            for i in missing:
                found[i] = self.words[words[i]]
        number = np.fromiter(found, np.int64, len(words))
        used = np.bincount(number, minlength=len(self.words))
        used[: len(self.uses)] += self.uses
        self.uses = used
        return number

    def _as_windows(self, texts: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """(the texts that both sides spell; their tokens of A, of B, their windows in number and one after the other)."""
        there = [k for k, t in enumerate(texts) if t]
        done: list[int] = []
        parts: list[tuple[np.ndarray, ...]] = []
        if self.by_word and there:
            cut = [_words(texts[k]) for k in there]
            size = np.array([len(x) for x in cut])
            word = self._numbered(list(itertools.chain.from_iterable(cut)))
            good = np.minimum.reduceat(self.word_a[word], np.cumsum(size) - size) >= 0
            done = [k for k, g in zip(there, good.tolist(), strict=True) if g]
            if done:
                word, size = word[np.repeat(good, size)], size[good]
                first = np.cumsum(size) - size
                start = (np.cumsum(self.word_windows) - self.word_windows)[word]
                totals = (np.add.reduceat(x[word], first) for x in (self.word_a, self.word_b, self.word_windows))
                parts.append((*totals, self.of_words[_ranges(start, self.word_windows[word])]))
        for k in sorted(set(there).difference(done)):
            good, ids, count = self._spelled([texts[k]], "one_by_one")
            if good.all():
                window, size = self._cut(*ids, count[0])
                done.append(k)
                parts.append((*count, size, window))
        return done, [np.concatenate(x) for x in zip(*parts, strict=True)]

    def __call__(self, texts: list[str]) -> dict[str, list]:
        """Per text: numbers, groups as text, codes of its distinct linked pairs and how often each occurs."""
        out = {k: [0] * len(texts) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [""] * len(texts), "pairs": [b""] * len(texts), "times": [b""] * len(texts)}
        spelled, found = self._as_windows(texts)
        if not spelled:
            return out
        n_a, n_b, n_windows, window = found
        first = np.cumsum(n_windows) - n_windows
        links = self.n_links[window]
        place = np.cumsum(self.n_links) - self.n_links
        pairs = self.codes[_ranges(place[window], links)]
        doc = np.repeat(np.arange(len(spelled)), n_windows)
        size = np.uint64(len(self.a.entries) * self.width)
        held, times = np.unique(np.repeat(doc, links).astype(np.uint64) * size + pairs, return_counts=True)
        cut = np.searchsorted(held, np.arange(len(spelled) + 1, dtype=np.uint64) * size)
        held %= size
        totals = zip(spelled, n_a.tolist(), n_b.tolist(), np.add.reduceat(self.n_groups[window], first).tolist(), np.add.reduceat(links, first).tolist(), strict=True)
        said = list(map(self.texts.__getitem__, window.tolist()))
        ends = np.cumsum(n_windows).tolist()
        for n, (k, *numbers) in enumerate(totals):
            out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k] = numbers
            out["groups"][k] = ";".join(said[first[n] : ends[n]])
            out["pairs"][k] = held[cut[n] : cut[n + 1]].astype("<u8" if size > 1 << 32 else "<u4").tobytes()
            out["times"][k] = times[cut[n] : cut[n + 1]].astype("<u4").tobytes()
        return out


#: One aligner per worker process and pair of files; Spark reuses its workers between tasks.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > CHUNK_CHARS:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _narrow(times: bytes) -> bytes:
    """Counts as one byte each where all fit (the common case)."""
    n = np.frombuffer(times, "<u4")
    return n.astype(np.uint8).tobytes() if len(n) and n.max() < 256 else times


def _pairs_of(pairs: bytes, times: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(pairs, "<u8" if wide else "<u4").astype(np.int64)
    return codes, np.frombuffer(times, np.uint8 if len(times) == len(codes) else "<u4").astype(np.int64)


@dataclass(frozen=True)
class Alignment:
    """``documents``: one row per document; ``pairs``: a_id, b_id, links (how many links hold them), best (the B id's highest)."""

    documents: DataFrame
    pairs: DataFrame


def _first_pass(docs: DataFrame, file_a: TokenizerFile, file_b: TokenizerFile, digest_only: bool) -> DataFrame:
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((file_a, file_b))  # two vocabulary files, whatever the corpus
    name = "groups_sha256" if digest_only else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = files.value
        if (a.digest, b.digest) not in _ALIGNERS:
            _ALIGNERS[a.digest, b.digest] = Aligner(a, b)
        align = _ALIGNERS[a.digest, b.digest]
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _chunks(texts):
                got = align(texts[i:j])
                said = got.pop("groups")
                if digest_only:
                    said = [hashlib.sha256(x.encode()).hexdigest() if n else "" for x, n in zip(said, got["n_a"])]
                got["times"] = [_narrow(x) for x in got["times"]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *[pa.array(got[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(said, pa.string()), *[pa.array(got[k], pa.binary()) for k in ("pairs", "times")]],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", name, "pairs", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, {name} string, pairs binary, times binary"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "alignment")


def _count_pairs(rows: DataFrame, width: int, wide: bool) -> DataFrame:
    def merge(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate(codes), return_inverse=True)
        return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)

    def out(codes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["code", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        loose = 0
        for batch in batches:
            for pairs, times in zip(batch.column(0), batch.column(1)):
                codes, n = _pairs_of(pairs.as_py(), times.as_py(), wide)
                held[0].append(codes)
                held[1].append(n)
                loose += len(codes)
                if loose > HELD_PAIRS:
                    codes, n = merge(*held)
                    if len(codes) > HELD_PAIRS:
                        yield out(codes, n)
                        held = ([], [])
                    else:
                        held = ([codes], [n])
                    loose = 0
        if held[0]:
            yield out(*merge(*held))

    parts = rows.filter("n_links > 0").select("pairs", "times").mapInArrow(run, "code long, links long")
    counted = parts.groupBy("code").agg(F.sum("links").alias("links"))
    counted = materialize(counted.select("code", F.expr(f"code div {width}").cast("int").alias("a_id"), (F.col("code") % width).cast("int").alias("b_id"), "links"), "pairs")
    highest = counted.groupBy("b_id").agg(F.max("links").alias("_most"))  # as many rows as B has ids
    return counted.join(highest, "b_id").select("code", "a_id", "b_id", "links", (F.col("links") == F.col("_most")).alias("best"))


def _least_common(pairs: DataFrame, common: int) -> int:
    """The smallest count from which on the pairs fit the broadcast table; counts are told apart by eighths of a power of two."""
    grade = F.floor(F.log2("links") * 8).cast("int")
    sizes = pairs.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.min("links").alias("least")).collect()  # at most 512 rows
    least, total = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["grade"]):
        total += r["n"]
        if total > common:
            break
        least = r["least"]
    return least


def align(docs: DataFrame, file_a: TokenizerFile, file_b: TokenizerFile, digest_only: bool = False, common: int = COMMON) -> Alignment:
    """Align every document; with ``digest_only`` the groups are returned as their SHA-256 alone.

    ``documents`` has doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's most frequent), count_sum (the
    pairs' counts over all links) and ``groups``, written ``a1,a2|b1;a3|b2,b3``.
    """
    spark = docs.sparkSession
    widths = [len(open_tokenizer(f)[1].entries) for f in (file_a, file_b)]
    width, wide = widths[1], widths[0] * widths[1] > 1 << 32
    rows = _first_pass(docs, file_a, file_b, digest_only)
    pairs = materialize(_count_pairs(rows, width, wide), "pair-counts")

    least = _least_common(pairs, common)
    top = pairs.filter(F.col("links") >= least).select("code", "links", "best").toPandas().sort_values("code")  # at most ``common``
    table = spark.sparkContext.broadcast((top["code"].to_numpy(), top["links"].to_numpy(), top["best"].to_numpy(dtype=bool)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, links, best = table.value
        for batch in batches:
            sums, bests, rest, rest_times = [], [], [], []
            for pair, time in zip(batch.column("pairs"), batch.column("times")):
                own, n = _pairs_of(pair.as_py(), time.as_py(), wide)
                at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                there = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                at, m = at[there], n[there]
                sums.append(int((m * links[at]).sum()))
                bests.append(int(m[best[at]].sum()))
                rest.append(own[~there].tolist())
                rest_times.append(n[~there].tolist())
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(rest_times, pa.list_(pa.int64()))],
                names=[*names, "n_best", "count_sum", "codes", "mult"],
            )

    names = [c for c in rows.columns if c not in ("pairs", "times")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    summed = rows.mapInArrow(known, f"{kinds}, n_best long, count_sum long, codes array<long>, mult array<long>")
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digest_only else "groups"]
    if pairs.filter(F.col("links") < least).isEmpty():
        return Alignment(summed.select(*result), pairs.drop("code"))

    summed = materialize(summed, "alignment-sums")
    rare = summed.select("row", F.explode(F.arrays_zip("codes", "mult")).alias("_p")).select("row", F.col("_p.codes").alias("code"), F.col("_p.mult").alias("_m"))
    more = rare.join(pairs.filter(F.col("links") < least), "code").groupBy("row").agg(
        F.sum(F.col("_m") * F.col("links")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("_m")).otherwise(0)).alias("_best")
    )
    added = summed.join(more, "row", "left").withColumns(
        {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    )
    return Alignment(added.select(*result), pairs.drop("code"))
