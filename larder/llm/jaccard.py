"""Exact n-gram Jaccard self-join by T-occurrence search (DivideSkip), with connected components.

A document is the set of its distinct word 4-grams (shingles). Two documents link if 100 * |A and B| >= 85 * |A or B|, that is
if B is in at least T = ceil(85 (|A| + |B|) / 185) of the inverted lists of A's shingles.

1. **Classes.** Equal sets are one class, so copies cost one row each and are never compared.
2. **Search blocks.** Linked sets differ in at most H = 15 (|A| + |B|) / 185 shingles. Shingles are dealt by hash to K parts (K is
   fixed for a band of sizes; a set near its band's end also goes to the next band). Two linked sets have equal contents in all
   but H of their parts, so under any common order of parts, the first H + 1 non-empty parts of both hold a common one. The
   order puts parts with many shingles first: unrelated documents that share a passage seldom agree in such a part. A bucket is
   the sets with one equal part among those. Sets with too few non-empty parts (hardly any) meet in a bucket of their own, which
   keeps the argument exact.
3. **T-occurrence search.** Within a bucket the smallest set id leads. The leader's shingles are looked up in the inverted lists
   of the block of sets that it leads: the longest lists are put aside, the short ones are heap-merged, and sets that occur
   often enough are probed by binary search in the long ones. Sets that reach T link to the leader.
4. **Rounds.** First each set is searched by the leader that it shares most buckets with, then by its other leaders if these
   are still in another component. Last, buckets that still hold several components are compared across them by
   sketches of parity bits, in which sets that link differ in at most H places: first only for as many pairs as could join the
   components, then, where some of these did not link, for all pairs that are left. What the sketches let pass goes to the
   search. A pair inside one component adds nothing to the result, so groups of near copies never unfold into all pairs.

Scale: one scan emits about a quarter of a bucket row per shingle, one shuffle brings them together; texts are read a second time
for the sets that have a candidate, found with a filter of fixed size (``FILTER_BYTES``, the only thing that is broadcast). These
sets are dealt by id once, as they are written; after that only the members of search blocks and of open buckets are shuffled.
A bucket that is hot inside a map task is cut into sub-buckets whose leaders stand for them in the bucket itself; a leader
with many sets has several blocks, and an open bucket is compared in squares of ``CHUNK_SETS`` sets. Set ids are 64-bit digests.

Defined cases: NULL or blank texts have no shingles and link with nothing; texts with fewer words than four have one shingle;
NULL ``doc_id`` rows take part, and a component's id is its smallest id that is not NULL; repeated rows stay; an empty table gives
no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize, materialize_by
from larder.llm.batches import as_text, runs
from larder.llm.components import components

WORDS = 4
#: A link: PART * intersection >= LEAST * union.
PART, LEAST = 100, 85
#: Upper sizes of the bands grow by this factor; parts hold about four shingles at the upper end.
BAND_GROWTH, PART_SHINGLES, FIRST_BAND = 1.5, 4, 11
#: Members of a bucket in one map task, and sets in one search block.
BUCKET_ROWS, BLOCK_SETS = 1024, 512
#: Sides of the squares in which an open bucket is compared.
CHUNK_SETS = 1024
FILTER_BYTES, FILTER_CHUNKS = 8 << 20, 16
#: Weight of a probe against a merge step when choosing how many lists are long.
PROBE_COST = 0.0085

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> _U(30))) * _M2
        x = (x ^ (x >> _U(27))) * _M3
        return x ^ (x >> _U(31))


def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    with np.errstate(over="ignore"):
        forth, back = np.full(n, _M3, dtype=_U), np.full(n, _U(pow(int(_M3), -1, 1 << 64)), dtype=_U)
        forth[0] = back[0] = 1
        return np.cumprod(forth), np.cumprod(back)


PIECE = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(256, dtype=_U) ^ _M2)
_FORTH, _BACK = _all_powers(PIECE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, from a table up to ``PIECE``."""
    return (_FORTH[:n], _BACK[:n]) if n <= len(_FORTH) else _all_powers(n)


def _piece_hashes(raw: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of some bytes: differences of one running sum, moved back to the word's start."""
    forth, back = powers(len(raw))
    inside = ~space[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(raw))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * forth, out=total[1:])
        return (total[end] - total[start]) * back[start] + (end - start).astype(_U) * _M1


def word_hashes(text: str | None, space: np.ndarray = _SPACE) -> np.ndarray:
    """Hashes of the words of a text.

    ``bytes.lower`` changes A-Z only; words end at the bytes marked in ``space``: blank and 0x09 to 0x0D. Very long texts are hashed in pieces that end at a
    word's end.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    out, at = [], 0
    while len(raw) - at > PIECE:
        gap = np.flatnonzero(space[raw[at : at + PIECE]])
        if len(gap):
            end = at + int(gap[-1]) + 1
        else:  # one word is longer than a piece
            later = np.flatnonzero(space[raw[at:]])
            end = at + int(later[0]) + 1 if len(later) else len(raw)
        out.append(_piece_hashes(raw[at:end], space))
        at = end
    out.append(_piece_hashes(raw[at:], space))
    return np.concatenate(out) if len(out) > 1 else out[0]


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = mix(word_hashes(text))
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < n:
            code = np.array([len(h)], dtype=_U)
            for k in range(len(h)):
                code = mix(code * _M2 + h[k])
            return code
        code = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            code *= _M3
            code += h[k : len(h) - n + 1 + k]
    code = mix(code)
    code.sort()
    return code[np.concatenate([[True], code[1:] != code[:-1]])]


def set_id(s: np.ndarray) -> int:
    """Digest of a shingle set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(s ^ _M1)) + _U(len(s))
    return int(mix(np.array([total], dtype=_U)).view(np.int64)[0])


def _bands() -> list[int]:
    edges = [FIRST_BAND]
    while edges[-1] < 1 << 40:
        edges.append(int(np.ceil(edges[-1] * BAND_GROWTH)))
    return edges


EDGES = _bands()


def _most(size: int) -> int:
    """The size of the largest set that can link to one of this size."""
    return size * PART // LEAST


def differing(size: int) -> int:
    """Upper bound of shingles that a linked set differs in."""
    return (PART - LEAST) * (size + _most(size)) // (PART + LEAST)


def required(a: int, b: int) -> int:
    """Common shingles that two linked sets of these sizes have at least."""
    return -(-LEAST * (a + b) // (PART + LEAST))


def _deal(s: np.ndarray, band: int, parts: int) -> np.ndarray:
    """The part of each shingle (which is well mixed already)."""
    with np.errstate(over="ignore"):
        place = (s * (_M1 + _U(2 * band)) >> _U(32)) % _U(parts)
    return place.astype(np.uint16 if parts <= 0xFFFF else np.int64)  # numpy sorts 16 bits by radix


def bucket_keys(s: np.ndarray) -> np.ndarray:
    """The buckets of one shingle set."""
    size = len(s)
    if size == 0:
        return np.empty(0, dtype=_U)
    need = differing(size) + 1
    band = int(np.searchsorted(EDGES, size))
    content = mix(s ^ _M2)
    out = []
    for g in (band, band + 1) if _most(size) > EDGES[band] else (band,):
        parts = 64 if g == 0 else max(-(-EDGES[g] // PART_SHINGLES), differing(EDGES[g]) + 5)
        place = _deal(s, g, parts)
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(starts, size)).astype(_U)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(content[order], starts)
            keys = mix(total + (place[starts].astype(_U) + _U(g << 32)) * _M1 + count)
        if len(keys) < need:
            out += [keys, mix(np.array([g], dtype=_U) + _M3)]
        elif len(keys) == need:
            out.append(keys)
        else:  # parts with many shingles first, then by key
            rank = (_U(255) - np.minimum(count, _U(255))) << _U(56) | keys >> _U(8)
            out.append(keys[np.argpartition(rank, need - 1)[:need]])
    return np.concatenate(out)


def sketches(s: np.ndarray) -> tuple[bytes, bytes]:
    """A parity bit for each of many parts, for the set's own band and for the next one.

    A shingle that only one of two sets has flips one bit at most, so linked sets differ in at most ``differing`` bits; and
    with four parts per shingle few flips cancel, so sets that do not link mostly differ in more.
    """
    band = int(np.searchsorted(EDGES, len(s)))
    out = []
    for g in (band, band + 1):
        bits = -(-EDGES[g] // 16) * 64
        out.append(np.packbits(np.bincount(_deal(s, g + 64, bits), minlength=bits) & 1).tobytes())
    return out[0], out[1]


def divide_skip(lists: list[np.ndarray], need: int) -> dict[int, int]:
    """Members of at least ``need`` of the sorted lists, with the number of lists that hold them."""
    if need <= 0 or len(lists) < need:
        return {}
    lists = sorted(lists, key=len, reverse=True)
    n_long = min(need - 1, int(need / (PROBE_COST * np.log2(max(2, len(lists[0]))) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    floor = need - n_long
    counts: dict[int, int] = {}
    member, times = None, 0
    for x in heapq.merge(*[x.tolist() for x in short]):
        if x != member:
            if times >= floor:
                counts[member] = times
            member, times = x, 0
        times += 1
    if times >= floor:
        counts[member] = times
    if not counts or not long:
        return {m: c for m, c in counts.items() if c >= need}
    probes = np.fromiter(counts, dtype=np.int64)
    total = np.fromiter(counts.values(), dtype=np.int64)
    for k, x in enumerate(long):
        if not len(x):
            continue
        at = np.searchsorted(x, probes)
        total += x[np.minimum(at, len(x) - 1)] == probes
        alive = total + (len(long) - k - 1) >= need  # what the lists left can still add
        if not alive.all():
            probes, total = probes[alive], total[alive]
            if not len(probes):
                return {}
    return {int(p): int(t) for p, t in zip(probes, total, strict=True) if t >= need}


def search(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Positions of the sets that link to ``query``, through inverted lists over its shingles."""
    a = len(query)
    sizes = np.array([len(s) for s in sets])
    fit = np.flatnonzero((sizes * PART >= LEAST * a) & (sizes * LEAST <= PART * a))
    if not len(fit) or not a:
        return []
    values = np.concatenate([sets[i] for i in fit])
    owner = np.repeat(fit, sizes[fit])
    at = np.minimum(np.searchsorted(query, values), a - 1)
    hit = query[at] == values
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cuts = np.searchsorted(at, np.arange(a + 1))
    lists = [owner[cuts[k] : cuts[k + 1]] for k in range(a)]
    common = divide_skip(lists, required(a, int(sizes[fit].min())))
    return [i for i, c in common.items() if c >= required(a, int(sizes[i]))]


# --- the same on Spark ------------------------------------------------------------------------------------------------


def _split_hot(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, root, id) rows of one map task: equal rows once, and buckets above ``BUCKET_ROWS`` cut into sub-buckets."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.empty(0, bool)
    keys, ids = keys[new], ids[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    count = np.diff(np.append(first, len(keys)))
    rank = np.arange(len(keys)) - np.repeat(first, count)
    hot = np.repeat(count > BUCKET_ROWS, count)
    bucket = keys.copy()
    lead = hot & (rank % BUCKET_ROWS == 0)
    if hot.any():
        # the sub-bucket is named by its first id, so sub-buckets of other tasks stay apart
        head = ids[np.flatnonzero(lead)][np.cumsum(lead)[hot] - 1]
        with np.errstate(over="ignore"):
            bucket[hot] = mix(keys[hot].view(_U) ^ mix(head.view(_U))).view(np.int64)
    return np.concatenate([bucket, keys[lead]]), np.concatenate([keys, keys[lead]]), np.concatenate([ids, ids[lead]])


#: Rows of the one scan: a set row for each document, and bucket rows of its classes. ``up`` is the bitwise difference of a
#: bucket and its root, which is 0 and takes no room on disk unless the bucket is cut.
SCAN = "is_set boolean, doc_id string, mark long, n_shingles int, id long, bucket long, up long"


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, keys, ids = set(), [], []
    for frame in frames:
        own, sizes = [], []
        for text in frame["text"]:
            s = shingles(text)
            i = set_id(s)
            own.append(i)
            sizes.append(len(s))
            if len(s) and i not in seen:
                seen.add(i)
                k = bucket_keys(s)
                keys.append(k.view(np.int64))
                ids.append(np.full(len(k), i, dtype=np.int64))
        yield pd.DataFrame(
            {"is_set": True, "doc_id": frame["doc_id"].array, "mark": frame["mark"].array, "n_shingles": sizes, "id": own, "bucket": 0, "up": 0}
        )
    if keys:
        bucket, root, member = _split_hot(np.concatenate(keys), np.concatenate(ids))
        up = bucket ^ root
        for i in range(0, len(bucket), 200_000):
            part = slice(i, i + 200_000)
            yield pd.DataFrame(
                {"is_set": False, "doc_id": None, "mark": 0, "n_shingles": 0, "id": member[part], "bucket": bucket[part], "up": up[part]}
            )


def _meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of buckets with at least two sets; all rows of a bucket are in this partition."""
    got = [f.to_numpy(dtype=np.int64) for f in frames]
    if not got:
        return
    rows = np.concatenate(got)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 2] == rows[:-1, 2])
    rows = rows[np.concatenate([[True], ~same])]
    first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    count = np.diff(np.append(first, len(rows)))
    leader = np.repeat(rows[first, 2], count)
    many = np.repeat(count > 1, count)
    for i in range(0, len(rows), 200_000):
        part = np.arange(i, min(i + 200_000, len(rows)))
        part = part[many[part]]
        yield pd.DataFrame({"root": rows[part, 0] ^ rows[part, 1], "leader": leader[part], "id": rows[part, 2]})


def _filter_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chunk_bytes = FILTER_BYTES // FILTER_CHUNKS
    bits: dict[int, np.ndarray] = {}
    for frame in frames:
        for c, part in frame.groupby("chunk"):
            flags = bits.setdefault(int(c), np.zeros(chunk_bytes * 8, dtype=bool))
            flags[_bit(part["mark"].to_numpy(dtype=np.int64).view(_U))] = True
    for c, flags in bits.items():
        yield pd.DataFrame({"chunk": [c], "bits": [np.packbits(flags).tobytes()]})


def _bit(mark: np.ndarray) -> np.ndarray:
    return ((mark >> _U(4)) % _U(FILTER_BYTES // FILTER_CHUNKS * 8)).astype(np.int64)


def _fixed_filter(marks: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BYTES``, whatever the number of marks; it lets every mark pass, and some others."""
    dealt = marks.withColumn("chunk", F.col("mark").bitwiseAND(FILTER_CHUNKS - 1).cast("int")).repartition(FILTER_CHUNKS, "chunk")
    rows = dealt.mapInPandas(_filter_chunks, "chunk int, bits binary").collect()  # FILTER_CHUNKS rows
    out = np.zeros(FILTER_BYTES, dtype=np.uint8)
    size = FILTER_BYTES // FILTER_CHUNKS
    for r in rows:
        out[r["chunk"] * size : (r["chunk"] + 1) * size] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _arrays(keep):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, bits = set(), keep.value
        for frame in frames:
            mark = frame["mark"].to_numpy(dtype=np.int64).view(_U)
            place = (mark & _U(FILTER_CHUNKS - 1)).astype(np.int64) * (FILTER_BYTES // FILTER_CHUNKS * 8) + _bit(mark)
            hit = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            out = []
            for text in frame["text"][hit]:
                s = shingles(text)
                i = set_id(s)
                if i not in seen:
                    seen.add(i)
                    out.append((i, len(s), s.tobytes(), int(np.searchsorted(EDGES, len(s))), *sketches(s)))
                if len(out) >= 1_000:
                    yield pd.DataFrame(out, columns=_ARRAY)
                    out = []
            yield pd.DataFrame(out, columns=_ARRAY)

    return run


_ARRAY = ["id", "n", "shingles", "band", "sketch", "next_sketch"]


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """The edges, tried in ``order``, that join what no edge before has joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for k in order:
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[x] = y
            kept.append(int(k))
    return kept


def _compare_squares(forest: bool):
    """Pairs of different components that may link. With ``forest`` only as many as could join the square's components."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for square in runs(frames, ["root", "a", "b"]):
            square = square.drop_duplicates("id").sort_values("id")
            sketch = np.frombuffer(b"".join(square["sketch"]), dtype=_U).reshape(len(square), -1)
            size, part, ids, chunk = (square[c].to_numpy() for c in ("n", "component", "id", "chunk"))
            cross = square["a"].iloc[0] != square["b"].iloc[0]
            left, right, flips = [], [], []
            for i in range(len(ids) - 1):
                rest = slice(i + 1, None)
                fit = (part[rest] != part[i]) & (size[rest] * PART >= size[i] * LEAST) & (size[i] * PART >= size[rest] * LEAST)
                if cross:
                    fit &= chunk[rest] != chunk[i]
                at = np.flatnonzero(fit) + i + 1
                if len(at):
                    most = (PART - LEAST) * (size[i] + size[at]) // (PART + LEAST)
                    count = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1)
                    near = at[count <= most]
                    left.append(np.full(len(near), i))
                    right.append(near)
                    flips.append(count[count <= most])
            if left and sum(map(len, left)):
                i, j, d = np.concatenate(left), np.concatenate(right), np.concatenate(flips)
                if forest:
                    kept = _forest(part[i], part[j], np.argsort(d, kind="stable"))
                    i, j = i[kept], j[kept]
                yield pd.DataFrame({"root": square["root"].iloc[0], "query": ids[i], "id": ids[j]})

    return run


def _search_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in runs(frames, ["query", "block"]):
        block = block.drop_duplicates("id")
        query = block["query"].iloc[0]
        own = block["id"].to_numpy() == query
        if own.any() and not own.all():
            as_set = lambda b: np.frombuffer(b, dtype=_U)
            others = block[~own]
            found = search(as_set(block["shingles"][own].iloc[0]), [as_set(b) for b in others["shingles"]])
            if found:
                yield pd.DataFrame({"a": query, "b": others["id"].iloc[found].to_numpy()})


def verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Those of ``pairs(query, id)`` that link, found by T-occurrence search of the queries over their blocks."""
    pairs = materialize(pairs.select("query", "id"), "jaccard-candidates")  # read twice, and ends the plan that made them
    if pairs.isEmpty():
        return pairs.select(F.col("query").alias("a"), F.col("id").alias("b"))
    sizes = pairs.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("blocks"))
    members = pairs.join(sizes, "query").select("query", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    queries = sizes.select("query", blocks.alias("block"), F.col("query").alias("id"))
    rows = members.unionByName(queries).join(arrays.select("id", "shingles"), "id").select("query", "block", "id", "shingles")
    placed = rows.repartition("query", "block").sortWithinPartitions("query", "block")
    return placed.mapInPandas(_search_blocks, "a long, b long")


def linked_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(as_text("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    scan = materialize(rows.mapInPandas(_scan, SCAN), "jaccard-scan")
    classes = scan.filter("is_set").select(F.col("doc_id").cast(kind).alias("doc_id"), "mark", "id", F.col("n_shingles").cast("long").alias("n_shingles"))

    met = scan.filter("NOT is_set").select("bucket", "up", "id").repartition("bucket")
    members = materialize(met.mapInPandas(_meet, "root long, leader long, id long"), "jaccard-buckets")

    shared = members.filter("id != leader").groupBy("leader", "id").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.withColumnRenamed("leader", "query"), "jaccard-pairs")
    wanted = members.select("id").distinct()
    marks = classes.groupBy("id").agg(F.min("mark").alias("mark")).join(wanted, "id").select("mark")
    keep = spark.sparkContext.broadcast(_fixed_filter(marks))
    found = rows.select("mark", "text").mapInPandas(_arrays(keep), "id long, n int, shingles binary, band int, sketch binary, next_sketch binary")
    arrays = found.join(wanted, "id", "left_semi").dropDuplicates(["id"])  # copies were met by several tasks
    arrays = materialize_by(arrays, "jaccard-arrays", "id")  # the largest rows, joined by id in every round

    best = shared.groupBy("id").agg(F.max(F.struct("n", "query"))["query"].alias("query")).select("query", "id")
    part = materialize(components(verified(best, arrays), "jaccard-parts"), "jaccard-parts")

    rest = _apart(shared.select("query", "id").join(best, ["query", "id"], "left_anti"), "query", "id", part)
    more = materialize(verified(rest, arrays), "jaccard-links")
    part = _joined(part, more)

    tried = shared.select("query", "id")
    near = materialize(_across_open_buckets(members.select("root", "id"), part, arrays, forest=True), "jaccard-near")
    new = near.select("query", "id").distinct().join(tried, ["query", "id"], "left_anti")
    more = materialize(verified(new, arrays), "jaccard-links")
    part = _joined(part, more)

    # Where all pairs that could join a bucket's components did link, nothing in it is left to compare.
    failed = near.join(more.select(F.col("a").alias("query"), F.col("b").alias("id")), ["query", "id"], "left_anti").select("root").distinct()
    failed = materialize(failed, "jaccard-failed")
    tried = tried.unionByName(near.select("query", "id"))
    rest = _across_open_buckets(members.select("root", "id").join(failed, "root"), part, arrays, forest=False)
    last = rest.select("query", "id").distinct().join(tried, ["query", "id"], "left_anti")
    part = _joined(part, materialize(verified(last, arrays), "jaccard-links"))

    group = classes.join(part.withColumnRenamed("node", "id"), "id", "left")
    group = group.withColumn("group", F.coalesce("component", "id")).select("doc_id", "n_shingles", "group")
    smallest = group.filter("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    filled = group.filter("n_shingles > 0").join(smallest, "group").select("doc_id", "n_shingles", "component_id")
    return filled.unionByName(group.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links; those there are enter as stars, which are nearly finished."""
    if links.isEmpty():
        return part
    stars = part.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialize(components(stars.unionByName(links), "jaccard-parts"), "jaccard-parts")


def _component_of(rows: DataFrame, column: str, part: DataFrame, name: str) -> DataFrame:
    own = part.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, a: str, b: str, part: DataFrame) -> DataFrame:
    """Pairs whose sides are in different components."""
    both = _component_of(_component_of(pairs, a, part, "_a"), b, part, "_b")
    return both.filter("_a != _b").select(*pairs.columns)


def _across_open_buckets(members: DataFrame, part: DataFrame, arrays: DataFrame, forest: bool) -> DataFrame:
    """(root, query, id) across the components of buckets that still hold several, as far as sizes and sketches allow a link.

    A bucket of two sets is closed by its leader's search, and of buckets with the same sets one is enough.
    """

    def place(rows: DataFrame) -> DataFrame:
        return _component_of(rows, "id", part, "component").join(arrays.select("id", "n", "band"), "id")

    several = place(members.distinct()).groupBy("root").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("sets"), F.max("band").alias("top"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    )
    open_ = several.filter("lo != hi AND sets > 2").groupBy("sets", "x", "y").agg(F.min(F.struct("root", "top")).alias("r"))
    open_ = open_.select("r.root", "r.top", F.ceil(F.col("sets") / CHUNK_SETS).cast("int").alias("chunks"))
    open_ = materialize(open_, "jaccard-open")
    still = place(members.join(open_, "root").distinct()).filter("band >= top - 1")  # sets two bands apart never link
    still = still.join(arrays.select("id", "sketch", "next_sketch"), "id")
    still = still.withColumn("sketch", F.when(F.col("band") == F.col("top"), F.col("sketch")).otherwise(F.col("next_sketch")))
    still = still.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")})
    columns = ["root", "a", "b", "chunk", "id", "component", "n", "sketch"]
    squares = dealt.select(*columns).repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return squares.mapInPandas(_compare_squares(forest), "root long, query long, id long")
