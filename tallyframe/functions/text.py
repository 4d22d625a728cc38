"""String helpers with the whitespace and word rules of Unicode text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trim(c: Column) -> Column:
    """Removes all Unicode whitespace at both ends, not only blanks."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def trim_chars(c: Column, char_class: str) -> Column:
    return F.regexp_replace(c, rf"^[{char_class}]+|[{char_class}]+$", "")


#: Stands at word boundaries; texts that hold it have the next control character instead.
EDGE, NO_EDGE = "\x01", "\x02"


def word_edges(c: Column) -> Column:
    """A text with a mark at every word boundary: texts that are compared by their marks need no pattern of their own."""
    return F.regexp_replace(F.translate(c, EDGE, NO_EDGE), r"(?U)\b", EDGE)


def as_words(edges: Column) -> Column:
    """What word_edges of a text holds where this marked piece stands between word boundaries."""
    return F.concat(F.lit(EDGE), F.regexp_replace(edges, f"^{EDGE}|{EDGE}$", ""), F.lit(EDGE))


def quote(c: Column) -> Column:
    r"""A literal piece of a pattern: \Q..\E, safe for texts that hold \E."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Trimmed, lower-case, runs of whitespace as one blank; null becomes ''."""
    return F.coalesce(F.regexp_replace(F.lower(trim(c)), rf"(?U){SPACE}+", " "), F.lit(""))


def letter(i: Column) -> Column:
    return F.char(F.lit(65) + i)


def index_of(a: Column, value: Column) -> Column:
    """0-based position of the first equal element, null when absent."""
    return F.nullif(F.array_position(a, value), F.lit(0)).cast("int") - 1
