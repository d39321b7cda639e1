"""BPE encoding and decoding by tree concatenation.

A text longer than ``leaf`` characters is cut in halves, and these again, down to leaves. Leaves are rows, so the leaves of
one very long text are encoded by many tasks. Then neighbours are concatenated upwards. Only tokens near the cut can be
wrong, so a window around it is encoded anew, and grows until it agrees with both sides: until it has, left of the cut, a
token with the same id at the same characters as in the left half, and likewise right of it. Between these two tokens the
window's tokens are taken. This is exact, because a token sequence is the BPE encoding of its text if every two neighbours
are, and each pair of neighbours in the result stands in one of the three encodings. Tokens that share a character with
another token (bytes of one character) do not count as agreement. If no window agrees, the window is the whole text.

Texts that need no cut never leave their row. Long ones are taken once per distinct text, keyed by digest, so neither a
repeated nor a NULL ``doc_id`` matters, and copies of a long text cost nothing.

Defined cases: NULL text is the empty text, which has no tokens and decodes to the empty text; repeated rows stay repeated
rows; an empty table gives no rows; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.batches import as_text
from larder.llm.tokenizers import TokenizerFile, WordMemory, word_memory

LEAF_CHARS = 16_384
FIRST_WINDOW = 16
#: Remembered words of a worker, in each of two generations; their ids take more room than their counts.
IDS_WORDS = 150_000
#: Characters that the split patterns look at to decide what begins at a place (the longest contraction). Nearer to the
#: end of what an encoding has seen, its split into words may still change, so a token there is no agreement.
AHEAD = 3
RESULT = "ids binary, n_tokens long, decoded string"
BYTES = "<u4"


def halves(text: str, leaf: int, special: tuple[str, ...] = ()) -> list[str]:
    """The leaves of a text: halved until each has at most ``leaf`` characters.

    A cut never falls inside a special token's string; it moves to that string's start. A piece that is such a string, or
    begins with one over its middle, stays whole.
    """
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    for token in special:
        at = text.find(token, max(0, middle - len(token) + 1), middle + len(token) - 1)
        if 0 <= at < middle:
            middle = at
    if middle == 0:
        return [text]
    return halves(text[:middle], leaf, special) + halves(text[middle:], leaf, special)


class Joiner:
    """Encodes leaves and concatenates encodings; ``tokenizer`` is the library's."""

    def __init__(self, tokenizer, memory: WordMemory | None = None, special: tuple[str, ...] = ()):
        self.tokenizer, self.memory, self.special = tokenizer, memory, special

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end character of each token."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(e.ids, dtype=BYTES), at[:, 0], at[:, 1]

    def leaf(self, text: str) -> np.ndarray:
        if self.memory is not None:
            return np.frombuffer(b"".join(self.memory(text)), dtype=BYTES)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=BYTES)

    def edge(self, text: str, chars: int, tail: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the last (or first) words of ``text`` that cover ``chars`` characters, as they are in its encoding."""
        if self.memory is None:
            return self.spans(text)
        if tail:
            start = text.rfind(" ", 0, max(0, len(text) - chars)) + 1
            ids, a, b = self.spans(text[start:])
            return ids, a + start, b + start
        end = text.find(" ", min(len(text), chars))
        return self.spans(text if end < 0 else text[:end])

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        if not left or not right:
            return right_ids if not left else left_ids
        width = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            if a == 0 and b == len(right):
                return self.leaf(left + right) if self.memory is None else self.spans(left + right)[0]
            ids, start, end = self.spans(left[a:] + right[:b])
            start, end, cut = start + a, end + a, len(left)
            clean = np.ones(len(ids), dtype=bool)
            clean[1:] &= end[:-1] <= start[1:]
            clean[:-1] &= end[:-1] <= start[1:]
            l_ids, l_start, l_end = self.edge(left, width, True)
            r_ids, r_start, r_end = self.edge(right, width, False)
            r_start, r_end = r_start + cut, r_end + cut
            far = len(left) + b - (0 if b == len(right) else AHEAD)
            before = clean & (end < cut) & (start <= cut - AHEAD)
            after = clean & (start >= cut) & (start <= far) & ((b == len(right)) | (end < len(left) + b))
            first = _match(ids, start, end, before, l_ids, l_start, l_end, last=False)
            last = _match(ids, start, end, after, r_ids, r_start, r_end, last=True)
            if first and last:
                i, in_left = first
                j, in_right = last
                keep = len(left_ids) - (len(l_ids) - in_left)
                return np.concatenate([left_ids[:keep], ids[i:j], right_ids[in_right:]])
            width *= 2

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> np.ndarray:
        """The whole tree of one text."""
        parts = halves(text, leaf, self.special)
        return self.concatenate([(p, self.leaf(p)) for p in parts])

    def concatenate(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Join neighbours level by level."""
        while len(parts) > 1:
            above = []
            for i in range(0, len(parts) - 1, 2):
                (left, left_ids), (right, right_ids) = parts[i], parts[i + 1]
                above.append((left + right, self.join(left, left_ids, right, right_ids)))
            parts = above + parts[len(above) * 2 :]
        return parts[0][1]


def _match(ids, start, end, usable, other_ids, other_start, other_end, last: bool) -> tuple[int, int] | None:
    """Positions, in the window and in a side, of the first (last) token that both have at the same characters."""
    places: dict[tuple[int, int, int], int | None] = {}
    for k, key in enumerate(zip(other_ids.tolist(), other_start.tolist(), other_end.tolist(), strict=True)):
        places[key] = None if key in places else k
    order = np.flatnonzero(usable)
    for i in order[::-1] if last else order:
        k = places.get((int(ids[i]), int(start[i]), int(end[i])))
        if k is not None:
            return int(i), k
    return None


_JOINERS: dict[str, Joiner] = {}


def joiner(file: TokenizerFile) -> Joiner:
    """The worker's joiner for a tokenizer version."""
    if file.digest not in _JOINERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(file.data.decode("utf-8"))
        t.no_truncation()
        t.no_padding()
        pack = lambda ids: np.array(ids, dtype=BYTES).tobytes()
        _JOINERS[file.digest] = Joiner(t, word_memory(file, "ids", pack, IDS_WORDS) if file.splits_words() else None, tuple(file.special_tokens()))
    return _JOINERS[file.digest]


def _result(own: Joiner, all_ids: list[np.ndarray]) -> dict[str, list]:
    return {
        "ids": [x.tobytes() for x in all_ids],
        "n_tokens": [len(x) for x in all_ids],
        "decoded": [own.tokenizer.decode(x.tolist(), skip_special_tokens=False) for x in all_ids],
    }


def digests(encoded: DataFrame) -> DataFrame:
    """``ids`` and ``decoded`` replaced by their SHA-256."""
    return encoded.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


def _short(file, keep_digest_only: bool):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = joiner(file.value)
        for frame in frames:
            for i in range(0, len(frame), 256):  # bounds what is held as tokens at once
                part = frame.iloc[i : i + 256]
                out = _result(own, [own.leaf(t) for t in part["text"]])
                yield _finish(pd.DataFrame({"doc_id": part["doc_id"].array, **out}), keep_digest_only)

    return encode


def _finish(out: pd.DataFrame, keep_digest_only: bool) -> pd.DataFrame:
    if not keep_digest_only:
        return out
    return pd.DataFrame(
        {
            **{c: out[c] for c in out.columns if c not in ("ids", "decoded")},
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in out["ids"]],
            "decoded_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in out["decoded"]],
        }
    )


def encode_documents(docs: DataFrame, file: TokenizerFile, leaf: int = LEAF_CHARS, digest_only: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` of every row; ids are little-endian unsigned 32-bit integers.

    With ``digest_only`` the tasks return the SHA-256 of ids and decoded text in their place.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(file)
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest_only else RESULT
    kind = docs.schema["doc_id"].dataType
    whole = docs.select(as_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = whole.filter(F.length("text") <= leaf).mapInPandas(_short(shared, digest_only), f"doc_id string, {fields}")

    long_rows = whole.filter(F.length("text") > leaf).withColumn("digest", F.sha2("text", 256))
    parts = long_rows.select("digest", "text").mapInPandas(_cut(leaf, tuple(file.special_tokens())), "digest string, part int, leaf string")
    encoded = parts.repartition("digest", "part").mapInPandas(_encode_leaves(shared), "digest string, part int, leaf string, ids binary")
    joined = encoded.groupBy("digest").applyInPandas(_join_leaves(shared, digest_only), f"digest string, {fields}")
    columns = [c for c in short.columns if c != "doc_id"]
    from_long = long_rows.select("doc_id", "digest").join(joined, "digest").select("doc_id", *columns)
    return short.select("doc_id", *columns).unionByName(from_long).withColumn("doc_id", F.col("doc_id").cast(kind))


def _cut(leaf: int, special: tuple[str, ...]):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for frame in frames:
            for digest, text in zip(frame["digest"], frame["text"], strict=True):
                if digest not in seen:
                    seen.add(digest)
                    parts = halves(text, leaf, special)
                    yield pd.DataFrame({"digest": digest, "part": range(len(parts)), "leaf": parts})

    return cut


def _encode_leaves(file):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = joiner(file.value)
        seen: set[tuple[str, int]] = set()  # copies met in several map tasks
        for frame in frames:
            keys = list(zip(frame["digest"], frame["part"], strict=True))
            fresh = [k not in seen and not seen.add(k) for k in keys]
            frame = frame[fresh]
            for i in range(0, len(frame), 64):
                part = frame.iloc[i : i + 64]
                yield part.assign(ids=[own.leaf(t).tobytes() for t in part["leaf"]])

    return encode


def _join_leaves(file, digest_only: bool):
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        own = joiner(file.value)
        frame = frame.sort_values("part")
        parts = [(t, np.frombuffer(x, dtype=BYTES)) for t, x in zip(frame["leaf"], frame["ids"], strict=True)]
        out = pd.DataFrame({"digest": [frame["digest"].iloc[0]], **_result(own, [own.concatenate(parts)])})
        return _finish(out, digest_only)

    return join
