"""Benchmark decontamination with templates.

A text becomes a template: its words in lower case, with numbers, units (a unit word after a number) and names (a capitalised
word inside a sentence, not in capitals throughout) replaced by typed placeholders, whose values are kept aside. Windows of ``WINDOW`` template words of the
benchmark items are hash-joined with those of the documents, so a question whose numbers or names were exchanged still
meets its original. Windows of one document and item at the same distance line up; neighbouring windows form a run. A run is
a leak if it covers ``RUN_WORDS`` words (or the whole item, if that is shorter) and its slots are consistent: each original value
stands for one value in the document and the other way round, for each type. Where they are not, the run is cut at the window that
breaks them, and the pieces are judged alike. Windows with fewer than ``LITERALS`` literal words say too little and are not looked up;
a window beside them carries the words around it, and they join its run where these are equal. An item all of whose windows
would be lost looks them up. Items with names have a second set of windows in which names are
literal words, because a copy in lower case or capitals shows no names. A capitalised word that opens a sentence may be a name or
not; items and documents have a further set of windows in which it is one, so that exchanged names are met there as well.

Scale: documents are scanned once against the benchmark's window hashes, and only windows that hit are shuffled, joined to
the items' windows and lined up. The hashes are broadcast in blocks of ``BLOCK_HASHES`` (16 MB); a larger benchmark means more
scans, not a larger broadcast. A group to line up is one (document, item), bounded by their lengths; a passage in a third of all
documents is that many small groups.

Defined cases: NULL and empty texts have no windows; items without words match nothing; items shorter than a window match as a
whole; repeated rows with one id and text are one document; NULL ids are kept; very long texts are hashed in pieces and looked up whole; repeated item rows add nothing; empty tables
give no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.llm.batches import as_text, runs
from larder.llm.jaccard import PIECE, mix, powers

WINDOW = 8
RUN_WORDS = 13
LITERALS = 4
BLOCK_HASHES = 1_000_000
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees metre metres meter meters mph kmh watt watts volt volts".split()
)
LITERAL, CAPITAL, NUMBER, UNIT = range(4)
_U = np.uint64
#: Template codes of the placeholders, by kind.
_SLOT = {NUMBER: _U(1), UNIT: _U(2), CAPITAL: _U(3)}


#: What a character is: part of no word, of a word, of a number, or a mark that ends a sentence.
_NONE, _LETTER, _DIGIT, _END = range(4)


def _describe(point: int) -> tuple[int, int, bool, bool]:
    """Kind, folded character, upper case, lower or title case."""
    c = chr(point)
    low = c.lower()
    kind = _DIGIT if "0" <= c <= "9" else _END if c in ".!?:\n" else _LETTER if c.isalnum() and not c.isdecimal() else _NONE
    return kind, ord(low) if len(low) == 1 else point, c.isupper(), c.islower() or category(c) == "Lt"


def _table(points) -> tuple[np.ndarray, ...]:
    rows = [_describe(p) if not 0xD800 <= p < 0xE000 else (_NONE, p, False, False) for p in points]
    kind, fold, upper, lower = zip(*rows, strict=True)
    return np.array(kind, np.int8), mix(np.array(fold, _U)), np.array(upper), np.array(lower)


_KIND, _FOLD, _UPPER, _LOWER = _table(range(0x10000))
_MANY = _U(0xBF58476D1CE4E5B9)


def _characters(text: str) -> tuple[np.ndarray, ...]:
    """Kind, hash of the folded character, upper case, lower case of every character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points) or points.max() < 0x10000:
        return _KIND[points], _FOLD[points], _UPPER[points], _LOWER[points]
    seen, at = np.unique(points, return_inverse=True)
    return tuple(column[at] for column in _table(seen.tolist()))


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[end] - total[start]


def _word_hashes(fold: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of character hashes times powers of an odd number counted from each word's start, in pieces of bounded size."""
    out = np.empty(len(start), dtype=_U)
    at = 0
    while at < len(start):
        first = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, first + PIECE, side="right")))
        last = int(end[stop - 1])
        forth, back = powers(last - first)
        with np.errstate(over="ignore"):
            total = np.zeros(last - first + 1, dtype=_U)
            np.cumsum(fold[first:last] * forth, out=total[1:])
            a, b = start[at:stop] - first, end[at:stop] - first
            out[at:stop] = mix((total[b] - total[a]) * back[a] + (b - a).astype(_U) * _MANY)
        at = stop
    return out


_UNIT_HASHES = np.sort(np.array([_word_hashes(_characters(u)[1], np.array([0]), np.array([len(u)]))[0] for u in UNITS], dtype=_U))


#: How capitalised words count: all as literal words, as names inside a sentence, or as names everywhere.
AS_WORDS, INSIDE, ANYWHERE = range(3)


def template(text: str | None, names: int = INSIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template codes, kinds (a literal or the type of slot), first and end character of the words of a text, and its openers.

    Words are runs of letters; numbers are digits with single points or commas between digits. Openers are capitalised words that open
    a sentence: literal words unless ``names`` is ``ANYWHERE``.
    """
    kind, fold, upper, lower = _characters(text or "")
    if not len(kind):
        return fold, kind, kind.astype(np.int64), kind.astype(np.int64), kind.astype(bool)
    digit = kind == _DIGIT
    if digit.any():
        points = np.flatnonzero(digit[:-2] & digit[2:]) + 1
        points = points[[text[i] in ".," for i in points]]
        kind = kind.copy()
        kind[points] = _DIGIT
    change = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    end = np.append(start[1:], len(kind))
    real = kind[start] != _NONE
    start, end = start[real], end[real]
    what = kind[start]
    code = _word_hashes(fold, start, end)
    slot = np.full(len(start), LITERAL, dtype=np.int8)
    number = what == _DIGIT
    after_mark = np.concatenate([[True], what[:-1] == _END])
    slot[number] = NUMBER
    near = np.minimum(np.searchsorted(_UNIT_HASHES, code), len(_UNIT_HASHES) - 1)
    slot[(_UNIT_HASHES[near] == code) & np.concatenate([[False], number[:-1]])] = UNIT
    capital = (what == _LETTER) & (slot == LITERAL) & upper[start] & (_sums(lower, start, end) > 0)
    if names != AS_WORDS:
        slot[capital & (~after_mark | (names == ANYWHERE))] = CAPITAL
    code |= _U(8)  # never one of the placeholders' codes
    for k, value in _SLOT.items():
        code[slot == k] = value
    word = what != _END
    return code[word], slot[word], start[word], end[word], (capital & after_mark)[word]


def windows(code: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` template words."""
    n = len(code) - size + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        h = np.full(n, _U(size), dtype=_U)
        for k in range(size):
            h *= _U(0x94D049BB133111EB)
            h += code[k : k + n]
        return mix(h)


def windows_with(words: np.ndarray, size: int) -> np.ndarray:
    """Places of the windows that hold one of these words."""
    if len(words) < size or not words.any():
        return np.empty(0, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(words)])
    return np.flatnonzero(total[size:] > total[:-size])


def telling(slot: np.ndarray, size: int, least: int) -> np.ndarray:
    """Which windows hold enough literal words."""
    total = np.concatenate([[0], np.cumsum(slot == LITERAL)])
    return total[size:] - total[:-size] >= least if len(slot) >= size else np.empty(0, dtype=bool)


def _values(text: str, slot: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, size: int) -> str:
    """Type and value of the slots of a window."""
    return "\x1f".join(f"{slot[i]}{text[start[i] : end[i]].lower()}" for i in range(at, at + size) if slot[i] != LITERAL)


def _reach(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many windows before and after each kept one are not kept, up to the next kept one."""
    at = np.flatnonzero(keep)
    edges = np.concatenate([[-1], at, [len(keep)]])
    return np.diff(edges)[:-1] - 1, np.diff(edges)[1:] - 1


def _near(text: str, code, slot, start, end, first: int, last: int) -> str:
    """The template words of a range with the values of its slots."""
    first, last = max(0, first), min(last, len(code))
    return "\x1e".join(f"={int(code[i]):x}" if slot[i] == LITERAL else f"{slot[i]}{text[start[i] : end[i]].lower()}" for i in range(first, last))


def extended(item_at: int, size: int, item: tuple[str, int], doc: tuple[str, int]) -> dict[int, tuple[str, str]]:
    """Windows next to a matched one over equal template words: place and (original, found) values. Pairs: words, how many stand before."""
    a, b = item[0].split("\x1e"), doc[0].split("\x1e")
    low, high = item[1], item[1] + size
    move = doc[1] - item[1]
    same = lambda i: 0 <= i < len(a) and 0 <= i + move < len(b) and (a[i] == b[i + move] if a[i][0] == "=" else a[i][0] == b[i + move][0])
    while same(low - 1):
        low -= 1
    while same(high):
        high += 1
    values = lambda x: "\x1f".join(w for w in x if w[0] != "=")
    return {item_at + i - item[1]: (values(a[i : i + size]), values(b[i + move : i + move + size])) for i in range(low, high - size + 1)}


def _item_windows(size: int, least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                usual = template(text)
                for names in (INSIDE, AS_WORDS, ANYWHERE):
                    code, slot, start, end, _ = usual if names == INSIDE else template(text, names)
                    if not len(code) or names != INSIDE and (slot == usual[1]).all():
                        continue
                    own = min(size, len(code))
                    h = windows(code, own)
                    keep = telling(slot, own, min(least, own))
                    keep = keep if keep.any() else np.ones(len(h), dtype=bool)
                    for i, left, right in zip(np.flatnonzero(keep).tolist(), *(x.tolist() for x in _reach(keep)), strict=True):
                        near = _near(text, code, slot, start, end, i - left, i + own + right) if left or right else ""
                        out.append((item, len(code), own, i, int(h[i].astype(np.int64)), _values(text, slot, start, end, i, own), left, right, near))
            yield pd.DataFrame(out, columns=["item_id", "item_words", "size", "item_at", "hash", "item_slots", "left", "right", "item_near"])

    return run


def _document_windows(block, sizes: list[int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, left, right = block.value
        for frame in frames:
            out = []
            for row, doc, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
                code, slot, start, end, opener = template(text)
                named = np.where(opener, _SLOT[CAPITAL], code), np.where(opener, np.int8(CAPITAL), slot)
                for size in sizes:
                    openers = windows_with(opener, size)
                    for own_code, own_slot, asked in ((code, slot, None), (*named, openers)):
                        h = windows(own_code, size).astype(np.int64)
                        places = np.arange(len(h)) if asked is None else asked
                        if not len(places):
                            continue
                        at = np.minimum(np.searchsorted(hashes, h[places]), len(hashes) - 1)
                        hit = hashes[at] == h[places]
                        for i, k in zip(places[hit].tolist(), at[hit].tolist(), strict=True):
                            a, b = int(left[k]), int(right[k])
                            values = _values(text, own_slot, start, end, i, size)
                            near = _near(text, own_code, own_slot, start, end, i - a, i + size + b) if a or b else ""
                            out.append((row, doc, i, int(h[i]), values, min(a, i), near))
                            if near and asked is None and opener[max(0, i - a) : i + size + b].any():
                                out.append((row, doc, i, int(h[i]), values, min(a, i), _near(text, *named, start, end, i - a, i + size + b)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "at", "hash", "slots", "before", "near"])

    return run


def consistent_runs(at: list[int], slots: list[tuple[str, str]], size: int) -> list[tuple[int, int, int]]:
    """(first, words, values that changed) of the runs of neighbouring windows whose slots stay consistent.

    ``at`` are the places of matched windows in rising order, ``slots`` their (original, found) values.
    """
    out: list[tuple[int, int, int]] = []
    first, last, there, back = None, None, {}, {}
    for place, (original, found) in zip(at, slots, strict=True):
        pairs = list(zip(original.split("\x1f"), found.split("\x1f"), strict=True)) if original else []
        fits = first is not None and place <= last + size
        if fits:
            new_there, new_back = dict(there), dict(back)
            fits = all(new_there.setdefault(a, b) == b and new_back.setdefault(b, a) == a for a, b in pairs)
        if fits:
            last, there, back = place, new_there, new_back
            continue
        if first is not None:
            out.append((first, last + size - first, sum(a != b for a, b in there.items())))
        first, last, there, back = place, place, {}, {}
        if not all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs):
            first = None  # this window contradicts itself
    if first is not None:
        out.append((first, last + size - first, sum(a != b for a, b in there.items())))
    return out


def _judge(run_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for group in runs(frames, ["row", "item_id"]):
            words, size = int(group["item_words"].iloc[0]), int(group["size"].iloc[0])
            need = min(run_words, words)
            best = None
            for shift, line in group.assign(shift=group["at"] - group["item_at"]).groupby("shift"):
                weak = {}
                for x in line[line["item_near"] != ""].itertuples():
                    weak |= extended(x.item_at, size, (x.item_near, x.left), (x.near, x.before))
                line = line.assign(slots_told=line["item_slots"].str.len()).sort_values(["item_at", "slots_told"]).drop_duplicates("item_at")
                strong = dict(zip(line["item_at"].tolist(), zip(line["item_slots"], line["slots"], strict=True), strict=True))
                for windows_of in [strong, weak | strong] if weak.keys() - strong.keys() else [strong]:
                    places = sorted(windows_of)
                    for first, length, changed in consistent_runs(places, [windows_of[k] for k in places], size):
                        if not any(first <= k <= first + length - size for k in strong):
                            continue
                        if length >= need and (best is None or (length, -first, -shift) > (best[0], -best[1], -best[2])):
                            best = (length, first, int(shift), changed)
            if best:
                found.append((group["doc_id"].iloc[0], group["item_id"].iloc[0], words, best[0], best[1], best[1] + best[2], best[3]))
            if len(found) >= 5_000:
                yield pd.DataFrame(found, columns=_LEAK)
                found = []
        yield pd.DataFrame(found, columns=_LEAK)

    return run


_LEAK = ["doc_id", "item_id", "item_words", "matched_words", "item_at", "doc_at", "changed_slots"]


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, run_words: int = RUN_WORDS, literals: int = LITERALS) -> DataFrame:
    """One row for each document and item that it leaks, with the longest run: its words, both places, exchanged slot values."""
    spark = docs.sparkSession
    items = benchmark.select(as_text("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    schema = "item_id string, item_words int, size int, item_at int, hash long, item_slots string, left int, right int, item_near string"
    own = materialize(items.mapInPandas(_item_windows(size, literals), schema).distinct(), "benchmark-windows")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most WINDOW numbers
    total = own.select("hash").distinct().count()
    blocks = max(1, -(-total // BLOCK_HASHES))

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), as_text("doc_id"), "text").filter("text IS NOT NULL")
    hits = None
    for b in range(blocks):
        part = own.filter(F.pmod("hash", F.lit(blocks)) == b).groupBy("hash").agg(F.max("left").alias("left"), F.max("right").alias("right")).collect()  # about BLOCK_HASHES rows
        part.sort(key=lambda r: r["hash"])
        hashes = np.array([r["hash"] for r in part], dtype=np.int64)
        if not len(hashes):
            continue
        shared = spark.sparkContext.broadcast((hashes, *(np.array([r[c] for r in part], dtype=np.int32) for c in ("left", "right"))))
        found = rows.mapInPandas(_document_windows(shared, sizes), "row long, doc_id string, at int, hash long, slots string, before int, near string")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "row long, doc_id string, at int, hash long, slots string, before int, near string")
    met = hits.join(own, "hash").repartition("row", "item_id").sortWithinPartitions("row", "item_id")
    schema = "doc_id string, item_id string, item_words int, matched_words int, item_at int, doc_at int, changed_slots int"
    out = met.mapInPandas(_judge(run_words), schema)
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    return out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def keep_clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not among the leaking documents; NULL ids compare as equal."""
    leaking = found.select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(leaking, docs["doc_id"].eqNullSafe(F.col("_leaking")), "left_anti")
