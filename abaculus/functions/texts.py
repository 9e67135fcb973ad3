"""Texts: widths, keyword matching, similarity and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def half_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space as their plain forms."""
    return F.translate(c, _WIDE, _NARROW)


def name_key(c: Column) -> Column:
    """Half-width, lower-cased, without separators: for comparing file and bank names."""
    return F.regexp_replace(F.lower(half_width(c)), r"[\s_\-.()\[\]【】（）]+", "")


def matches(text: Column, keyword: str, mode: str = "contains") -> Column:
    """Whether ``text`` matches one keyword; null matches nothing."""
    test = {
        "contains": lambda: text.contains(keyword),
        "exact": lambda: text == keyword,
        "startswith": lambda: text.startswith(keyword),
        "endswith": lambda: text.endswith(keyword),
        "regex": lambda: text.rlike(keyword),
    }[mode]()
    return F.coalesce(test, F.lit(False))


def first_keyword(text: Column, keywords: list[str], mode: str = "contains") -> Column:
    """The first of ``keywords`` that matches, else null."""
    found = F.lit(None).cast("string")
    for k in reversed(keywords):
        found = F.when(matches(text, k, mode), k).otherwise(found)
    return found


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; equal texts 1, any empty or null one 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def comparable(c: Column) -> Column:
    """Text for comparing field values: trimmed, integral numbers without '.0', blank as null."""
    text = F.trim(c.cast("string"))
    return F.nullif(F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def same_value(a: Column, b: Column) -> Column:
    return comparable(a).eqNullSafe(comparable(b))


def same_amount(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) < F.lit(tolerance).cast("decimal(20,4)"))
