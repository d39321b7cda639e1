"""String helpers shared by the parsers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it.

    Without it every use repeats the whole expression, which for chains of patterns costs more than anything else.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# Unicode white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends (plain ``trim`` only removes U+0020)."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def contains_any(c: Column, terms: list[str]) -> Column:
    """True when any of the literal terms occurs in the string."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms], F.lit(False))


def keyword_match(columns: list[Column], keyword: str | None) -> Column:
    """Lower-case substring search over several columns; a blank keyword matches every row."""
    word = (keyword or "").strip().lower()
    if not word:
        return F.lit(True)
    return F.lower(F.concat_ws(" ", *columns)).contains(word)


def clean_tags(tags: Column) -> Column:
    """Trim the tags, drop empty ones and repeats, keep the first-seen order."""
    trimmed = F.transform(F.filter(tags, lambda t: t.isNotNull()), strip)
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def join_tags(tags: Column) -> Column:
    return F.array_join(clean_tags(tags), ", ")


def allowed_only(tags: Column, allowed: Column) -> Column:
    """Keep tags of the white list, in their own order (``array_intersect`` would also drop repeats)."""
    return F.filter(tags, lambda t: F.array_contains(allowed, t))


def search_text(name: Column, description: Column, tags: Column) -> Column:
    """The text a dish is searched by: ``name | description | tags``, absent parts left out."""
    return F.concat_ws(" | ", name, blank_to_null(description), blank_to_null(tags))


def differs(new: Column, old: Column) -> Column:
    """Change test in which NULL and the empty string are the same value."""
    return F.coalesce(new, F.lit("")) != F.coalesce(old, F.lit(""))
