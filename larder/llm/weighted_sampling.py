"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

The terms of a text are its lower-cased words, weighted by how often they occur. For sample k every term draws, from its own
digest, r and c from Gamma(2, 1) and beta from U(0, 1); with ``t = floor(ln w / r + beta)`` and
``ln a = ln c - r (t - beta) - r`` the term with the smallest a is taken, and the sample is (term, t). Two texts agree in a sample
with the probability of their generalised Jaccard similarity, sum of min(w) over sum of max(w), so the share of equal samples
estimates it. A sample is kept as 32 bits; a fingerprint is ``SAMPLES`` of them in hexadecimal.

Draws: the MD5 of a term gives four 30-bit words. The five uniform numbers of sample k are ``mix(word_a + z word_b)`` for
z = 5k + 1 to 5k + 5 and changing pairs of words, where ``mix`` is a bijective scramble of 32 bits. Everything is whole-number
arithmetic and three logarithms, which another engine can repeat exactly. The expressions are kept free of NULLs and small:
a generated method beyond 8000 bytes of code would run uncompiled, so ``GROUP`` samples are computed per row and step.

Plan: all terms of a document are in one task, because texts are joined to their successors by document key before, so
neither the weights nor the minima need a shuffle. Weights of a document and of its edited text are counted side by side,
and share their draws. Only ids are sorted to find the next document; the text moves once whole, and once as the half that is
asked for. No document group exists, so there is no hot key; copies of a text are only equal in their results.

Defined cases: NULL is the empty text; a text without words has the fingerprint ``EMPTY``, which is like itself (1) and
unlike all others (0); documents are ordered by descending doc_id, NULL last, equal ids by a hash of their text; rows equal in
id and text are one document and repeated in the result; a single document is its own successor; of a very long text all terms count, as of any other; an empty table gives no rows;
other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.context import materialize
from larder.llm.sharding import numbered

SAMPLES = 24
#: Samples that one generated method computes; a row is repeated for each group of them.
GROUP = 4
EMPTY = "-"
MASK = 2**32 - 1
#: ln a is kept in fixed point: shifted to be positive, with this many binary places.
SHIFT, PLACES = 96, 23
#: Multipliers of the 32-bit scramble, and of t in a sample.
FIRST, SECOND, SPREAD = 0x05EBCA6B, 0x42B2AE35, 0x1E3779B1
#: Stands for "no term" among the packed minima.
NOTHING = 1 << 62


#: A document's key: two 64-bit hashes of its id and text.
KEY = ["k1", "k2"]
#: Documents in one task of the counting stage, so that its hash tables fit into memory at any size of the input.
TASK_DOCUMENTS = 1500


def _half(md5: Column, k: int) -> Column:
    """60 bits of a digest; two words of 30 bits."""
    return F.coalesce(F.conv(F.substring(md5, 1 + 16 * k, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def _mix(x: Column) -> Column:
    x = (x.bitwiseXOR(F.shiftright(x, 16)) * FIRST).bitwiseAND(MASK)
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * SECOND).bitwiseAND(MASK)
    return x.bitwiseXOR(F.shiftright(x, 16))


def draws(group: Column) -> list[dict[str, Column]]:
    """r, ln c and beta of the samples of a group from the words p0 to p3, in two steps."""
    mixed, out = {}, {}
    for k in range(GROUP):
        for j in range(5):
            z = group * (5 * GROUP) + (5 * k + j + 1)
            mixed[f"x{k}_{j}"] = _mix((F.col(f"p{j % 4}") + z * F.col(f"p{(j + 1 + j // 4) % 4}")).bitwiseAND(MASK))
        u = [(F.col(f"x{k}_{j}").cast("double") + 0.5) / (MASK + 1) for j in range(5)]
        out[f"r{k}"] = -F.log(u[0] * u[1])
        out[f"c{k}"] = F.log(-F.log(u[2] * u[3]))
        out[f"b{k}"] = u[4]
    plain = {n: F.coalesce(c, F.lit(0.0)) for n, c in out.items()}
    return [mixed, plain]


def _packed(k: int, log_weight: str, t: Column) -> Column:
    """Fixed-point ln a above 32 bits of the sample, so that the smallest number holds the sample with the smallest a."""
    r, c, b = F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"b{k}")
    level = F.floor((c - r * (t.cast("double") - b) - r + SHIFT) * (1 << PLACES))
    sample = (F.col("p0") + t.bitwiseAND(0xFFFFF) * SPREAD).bitwiseAND(MASK)
    return F.when(F.col(log_weight) < 0, F.lit(NOTHING)).otherwise(level * (MASK + 1) + sample)


def term_weights(texts: DataFrame, columns: list[str]) -> DataFrame:
    """The key, ``term`` and, for each text column, ``w_<column>``: how often the term occurs. Rows must be placed by the key."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate(columns)]))
    long = texts.select(*KEY, each.alias("e")).select(*KEY, "e.which", F.lower("e.text").alias("text"))
    words = long.select(*KEY, "which", F.explode(F.split("text", r"[ \t\n\u000B\f\r]+")).alias("term")).filter("term != ''")
    counts = [F.sum(F.when(F.col("which") == i, 1).otherwise(0)).alias(f"w_{c}") for i, c in enumerate(columns)]
    return words.groupBy(*KEY, "term").agg(*counts)


def signatures(weights: DataFrame, columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """The key and, for each column, ``s_<column>``: the array of samples (NULL without terms). Rows must be placed by the key."""
    logs = {f"l_{c}": F.when(F.col(f"w_{c}") > 0, F.coalesce(F.log(F.col(f"w_{c}").cast("double")), F.lit(-1.0))).otherwise(-1.0) for c in columns}
    drawn = weights.withColumn("d", F.md5(F.col("term").cast("binary")))
    drawn = drawn.select(*KEY, *[v.alias(n) for n, v in logs.items()], *[_half(F.col("d"), k).alias(f"h{k}") for k in range(2)])
    low = (1 << 30) - 1
    words = [w for k in range(2) for w in (F.col(f"h{k}").bitwiseAND(low), F.shiftright(f"h{k}", 30))]
    drawn = drawn.select(*KEY, *logs, *[w.alias(f"p{k}") for k, w in enumerate(words)])
    groups = -(-samples // GROUP)
    drawn = drawn.select("*", F.explode(F.array(*[F.lit(g).cast("long") for g in range(groups)])).alias("g"))
    mixed, values = draws(F.col("g"))
    drawn = drawn.select(*KEY, "g", "p0", *logs, *[v.alias(n) for n, v in mixed.items()])
    drawn = drawn.select(*KEY, "g", "p0", *logs, *[v.alias(n) for n, v in values.items()])
    step = {f"t_{c}_{k}": F.floor(F.col(f"l_{c}") / F.col(f"r{k}") + F.col(f"b{k}")) for c in columns for k in range(GROUP)}
    stepped = drawn.select("*", *[v.alias(n) for n, v in step.items()])
    least = [F.min(_packed(k, f"l_{c}", F.col(f"t_{c}_{k}"))).alias(f"m_{c}_{k}") for c in columns for k in range(GROUP)]
    minima = stepped.groupBy(*KEY, "g").agg(*least)
    whole = lambda m: F.when(m < NOTHING, m.bitwiseAND(MASK))
    parts = minima.select(*KEY, "g", *[F.array(*[whole(F.col(f"m_{c}_{k}")) for k in range(GROUP)]).alias(c) for c in columns])
    joined = parts.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("g", *columns))).alias("all"))
    return joined.select(*KEY, *[_whole(c, samples).alias(f"s_{c}") for c in columns])


def _whole(c: str, samples: int) -> Column:
    values = F.slice(F.flatten(F.col(f"all.{c}")), 1, samples)
    return F.when(F.element_at(values, 1).isNotNull(), values)


def text_form(samples: Column) -> Column:
    """A signature as text."""
    digits = F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(EMPTY))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprints(docs: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, fingerprint, edited_text's digest and fingerprint, likeness to it and to the next document``."""
    raw = F.coalesce(text, F.lit(""))
    keys = (F.xxhash64("doc_id", raw).alias("k1"), F.xxhash64(raw, F.lit(1), "doc_id").alias("k2"))
    rows = docs.select("doc_id", *keys, raw.alias("text"))

    ids = rows.groupBy(*KEY).agg(
        F.first("doc_id").alias("doc_id"), F.first(F.length("text").cast("long")).alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )
    order = [F.col("doc_id").desc_nulls_last(), *map(F.col, KEY)]
    ids = materialize(numbered(ids, order, "number", "fingerprint-order"), "fingerprint-ids")
    total, repeated = ids.agg(F.count(F.lit(1)), F.coalesce(F.max("copies"), F.lit(0)) > 1).first()
    follower = ids.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("number").alias("_n"))
    chain = ids.join(follower, F.pmod(ids["number"] + 1, F.lit(max(total, 1))) == follower["_n"]).drop("_n", "number")

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_DOCUMENTS)
    texts = rows.select(*KEY, "text")
    texts = (texts.dropDuplicates(KEY) if repeated else texts).repartition(tasks, *KEY)
    asked = chain.select(*[F.col(k).alias(f"for_{k}") for k in KEY], *[F.col(f"next_{k}").alias(k) for k in KEY], F.expr("cast(n_chars div 2 as int)").alias("take"))
    heads = texts.join(asked, KEY).select(*[F.col(f"for_{k}").alias(k) for k in KEY], "take", F.expr("left(text, take)").alias("head"))
    both = texts.join(heads.repartition(tasks, *KEY), KEY).select(
        *KEY, F.col("text").alias("own"), F.concat(F.expr("left(text, length(text) - take)"), F.col("head")).alias("edited")
    )
    digests = both.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    found = signatures(term_weights(both, ["own", "edited"]), ["own", "edited"], samples)
    marks = materialize(digests.join(found, KEY, "left"), "fingerprint-samples")

    after = marks.select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("s_own").alias("s_next"))
    out = chain.join(marks, KEY).join(after, [f"next_{k}" for k in KEY])
    out = out.withColumns(
        {
            "fingerprint": text_form(F.col("s_own")), "edited_fingerprint": text_form(F.col("s_edited")),
            "near_edited": likeness(F.col("s_own"), F.col("s_edited")), "near_next": likeness(F.col("s_own"), F.col("s_next")),
        }
    )
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
