"""Visible text of HTML pages and keyword context, in generated JVM code."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import WHITE, let

# Elements whose content is not text of the page.
DROPPED = ["script", "style", "noscript", "header", "footer", "nav", "aside"]
#: Elements whose content is no markup, so that a tag inside them means nothing.
RAW = ["script", "style"]


def _drop(html: Column) -> Column:
    """Remove the dropped elements, nested to any depth; one that is never closed runs to the end of the page.

    The page is cut before every tag of such an element. A running state (the outermost open element and its depth) tells
    which pieces lie outside.
    """
    names = "|".join(DROPPED)

    def read(piece: Column) -> Column:
        tag = rf"(?i)^<(/?)({names})\b"
        return F.struct(F.lower(F.regexp_extract(piece, tag, 2)).alias("name"), (F.regexp_extract(piece, tag, 1) == "").alias("opens"))

    def step(state: Column, tag: Column) -> Column:
        free, same = state["inside"] == "", state["inside"] == tag["name"]
        deeper = same & tag["opens"] & ~state["inside"].isin(RAW)
        depth = state["depth"] + F.when(deeper, 1).when(same & ~tag["opens"], -1).otherwise(0)
        entered = free & tag["opens"] & (tag["name"] != "")
        inside = F.when(entered, tag["name"]).when(free | (depth == 0), "").otherwise(state["inside"])
        return F.struct(
            inside.alias("inside"),
            F.when(entered, 1).when(free, 0).otherwise(depth).alias("depth"),
            F.array_append(state["outside"], inside == "").alias("outside"),
        )

    def assembled(pieces: Column) -> Column:
        start = F.struct(F.lit("").alias("inside"), F.lit(0).alias("depth"), F.lit([]).cast("array<boolean>").alias("outside"))
        outside = F.aggregate(F.transform(pieces, read), start, step, lambda s: s["outside"])
        kept = F.filter(F.arrays_zip(pieces.alias("piece"), outside.alias("outside")), lambda z: z["outside"])
        bare = F.transform(kept, lambda z: F.regexp_replace(z["piece"], rf"(?i)^</?(?:{names})\b[^>]*>?", " "))
        return F.array_join(bare, "")

    return let(F.split(html, rf"(?i)(?=</?(?:{names})\b)"), assembled)


def _entities(text: Column) -> Column:
    """Decode named (``&copy;``) and numeric (``&#8217;``, ``&#x2019;``) entities in one pass; unknown ones stay."""
    common = F.create_map(*[F.lit(x) for pair in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " ")) for x in pair])
    every = "\u0001".join(f"{name[:-1]}\u0002{char}" for name, char in html5.items() if name.endswith(";"))
    names = F.str_to_map(F.lit(every), F.lit("\u0001"), F.lit("\u0002"))

    def char(code: Column) -> Column:
        named = F.coalesce(F.try_element_at(common, code), F.try_element_at(names, code))
        decimal = F.regexp_extract(code, r"^#(\d+)$", 1)
        digits = F.when(decimal != "", F.hex(decimal.cast("long"))).otherwise(F.regexp_extract(code, r"^#[xX]([0-9a-fA-F]+)$", 1))
        return F.when(code.startswith("#"), F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(named)

    def decode(part: Column) -> Column:
        def joined(code: Column) -> Column:
            rest = F.substr(part, F.length(code) + 2)
            return F.coalesce(F.concat(F.when(code != "", char(code)), rest), F.concat(F.lit("&"), part))

        return let(F.regexp_extract(part, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1), joined)

    def decoded(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decode), ""))

    return F.when(text.contains("&"), let(F.split(text, "&"), decoded)).otherwise(text)


def html_to_text(html: Column, max_len: int | None = None) -> Column:
    """Visible text of a page with white space collapsed.

    Comments, declarations and the dropped elements vanish, every other tag becomes a blank. ``max_len`` caps the result
    for callers that feed a size-limited service; by default the text is whole.
    """
    bare = let(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), _drop)
    text = let(F.regexp_replace(bare, r"<[!?/a-zA-Z][^>]*>", " "), _entities)
    text = F.trim(F.regexp_replace(F.translate(text, WHITE, " " * len(WHITE)), " {2,}", " "))
    return text if max_len is None else F.substring(text, 1, max_len)


def keyword_segments(
    text: Column, keywords: list[str], before: int = 180, after: int = 320, fallback: int | None = None, max_chars: int | None = None
) -> Column:
    """Context of every keyword hit (any case), joined by ``\\n...\\n``; a text without a hit stays as it is.

    Hits are marked by two noncharacters (U+FDD0, U+FDD1) on one pass; a text should not hold them, and if it does, windows leave them
    out. Split at the marks, the text alternates between gaps and hits. A hit's context then is the end of the few pieces before it and
    the start of the few behind it: as many as can be needed if every gap were empty. So the cost of a hit follows the width of its
    window, not the length of the text, and windows may overlap. ``fallback`` shortens texts without a hit and ``max_chars`` the
    result, for size-limited services; both are off by default.
    """
    keywords = [k for k in keywords if k]
    if not keywords:
        return text if max_chars is None else F.substring(text, 1, max_chars)
    words = "|".join(re.escape(k) for k in keywords)
    first, last = "\ufdd0", "\ufdd1"
    shortest = min(map(len, keywords))

    def joined(pieces: Column, start: Column, size: Column) -> Column:
        return F.array_join(F.slice(pieces, start, size), "")

    def windows(pieces: Column) -> Column:
        """``pieces`` are gap, hit, gap, ..., hit, gap; hits stand at even places."""
        back, ahead = (2 * -(-width // shortest) + 1 for width in (before, after))

        def window(at: Column) -> Column:
            start = F.greatest(at - back, F.lit(1))
            left = F.right(joined(pieces, start, at - start), F.lit(before)) if before else F.lit("")
            right = F.left(joined(pieces, at + 1, F.lit(ahead)), F.lit(after)) if after else F.lit("")
            return F.concat(left, F.element_at(pieces, at), right)

        return F.array_join(F.transform(F.sequence(F.lit(2), F.size(pieces), F.lit(2)), window), "\n...\n")

    marked = F.regexp_replace(F.translate(text, first + last, ""), f"(?isu)({words})", f"{first}$1{last}")
    nothing = text if fallback is None else F.substring(text, 1, fallback)
    whole = let(F.split(marked, f"[{first}{last}]", -1), lambda pieces: F.when(F.size(pieces) > 1, windows(pieces)).otherwise(nothing))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)
