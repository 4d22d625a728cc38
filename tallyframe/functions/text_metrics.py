"""Per-question text metrics as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import java_pattern
from .text import let, normalize

ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def exact_match(
    pred: Column,
    ref: Column,
    regexes_to_ignore: Sequence[str] | None = None,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    ignore_numbers: bool = False,
) -> Column:
    def prepared(c: Column) -> Column:
        for p in regexes_to_ignore or []:
            c = F.regexp_replace(c, java_pattern(p), "")
        c = F.lower(c) if ignore_case else c
        c = F.regexp_replace(c, ASCII_PUNCTUATION, "") if ignore_punctuation else c
        return F.regexp_replace(c, "[0-9]", "") if ignore_numbers else c

    return (prepared(pred) == prepared(ref)).cast("double")


def anls(pred: Column, refs: Column, threshold: float = 0.5) -> Column:
    """1 - the smallest edit distance over the references relative to the longer raw text; 0 below the threshold."""

    def relative(mine: Column, ref: Column) -> Column:
        longest = F.greatest(F.length(F.upper(ref)), F.length(F.upper(pred)))
        return F.when(longest == 0, F.lit(0.0)).otherwise(
            F.levenshtein(normalize(ref), mine).cast("double") / longest
        )

    least = let(normalize(pred), lambda mine: F.array_min(F.transform(refs, lambda r: relative(mine, r))))
    return let(F.lit(1.0) - least, lambda s: F.when(s < threshold, F.lit(0.0)).otherwise(s))


def max_over_references(metric: Callable[[Column, Column], Column], pred: Column, refs: Column) -> Column:
    return F.array_max(F.transform(refs, lambda r: metric(pred, r)))


def any_target(metric: Callable[[Column, Column], Column], pred: Column, targets: Column) -> Column:
    """1.0 when any of several targets scores non-zero."""
    return F.exists(targets, lambda t: metric(pred, t) != 0).cast("double")
