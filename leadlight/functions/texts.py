"""Texts for file names, anchors and pages, and ordered lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(text: Column, most: int = 80) -> Column:
    """A text as part of a file name: all but letters, digits, dot, dash and underscore become one underscore."""
    clean = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.substring(F.when(clean == "", F.lit("unnamed")).otherwise(clean), 1, most)


def structure_name(text: Column, most: int = 120) -> Column:
    """A text as the name of a structure's or a list's own file: as above, but trimmed of dots, dashes and underscores, "compound" if nothing is left."""
    given = F.coalesce(F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("")), F.lit("compound"))
    clean = F.trim(F.regexp_replace(given, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit("compound")), 1, most)


def slug(text: Column) -> Column:
    """A text as an anchor: lower case, words joined by dashes."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def html(text: Column) -> Column:
    """A text with the signs that HTML takes for its own spelled out."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def ordered_distinct(values: Column) -> Column:
    """A list without repetitions and nulls, each value where it first stands."""
    return F.array_distinct(F.array_compact(values))


def top_joined(values: Column, n: int, between: str = "|") -> Column:
    """The first ``n`` values of a list as one text."""
    return F.array_join(F.slice(values, 1, n), between)
