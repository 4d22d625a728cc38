"""Response filters: expressions over one array<string> of responses per question, and their composition."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import letter, quote, trim

DEFAULT_PATTERN = r"#### (\-?[0-9\.\,]+)"
FALLBACK = "[invalid]"
Filter = Callable[[Column], Column]


def take_first(c: Column) -> Column:
    return F.array(F.coalesce(F.get(c, F.lit(0)), F.lit("")))


def take_first_k(c: Column, k: int) -> Column:
    short = F.raise_error(F.concat(F.lit(f"need at least {k} responses per question, got "), F.size(c).cast("string")))
    return F.when(F.size(c) >= k, F.slice(c, 1, k)).otherwise(short.cast("array<string>"))


def majority_vote(c: Column) -> Column:
    """The most frequent response; of tied ones the one seen first."""
    counted = F.transform(
        F.array_distinct(c),
        lambda v: F.struct(F.size(F.filter(c, lambda r: r.eqNullSafe(v))).alias("n"), v.alias("v")),
    )
    best = F.reduce(
        F.slice(counted, 2, F.greatest(F.size(counted) - 1, F.lit(0))),
        F.get(counted, F.lit(0)),
        lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc),
    )
    return F.array(best["v"])


def java_pattern(pattern: str) -> str | None:
    """The pattern for the JVM, with Unicode word classes; None when the JVM has no such construct."""
    if "(?P=" in pattern or "(?(" in pattern or r"\Z" in pattern:
        return None
    return "(?U)" + pattern.replace("(?P<", "(?<")


def _pick(matches: Column, k: int) -> Column:
    return F.try_element_at(matches, F.lit(k + 1 if k >= 0 else k))


def find_match(resp: Column, pattern: str, group_select: int = 0) -> Column:
    """The chosen match, trimmed; with several groups the first non-empty one; null when there is none."""
    groups = re.compile(pattern).groups
    java = java_pattern(pattern)
    if java is None:
        return _python_match(pattern, group_select)(resp)
    picked = [
        _pick(F.regexp_extract_all(resp, F.lit(java), F.lit(g)), group_select)
        for g in (range(1, groups + 1) if groups else [0])
    ]
    if groups > 1:
        return trim(F.coalesce(*[F.nullif(p, F.lit("")) for p in picked]))
    return trim(picked[0])


def _python_match(pattern: str, k: int):
    @F.pandas_udf(T.StringType())
    def run(col):
        rx = re.compile(pattern)

        def one(text):
            found = rx.findall(text) if text is not None else []
            if not -len(found) <= k < len(found):
                return None
            hit = found[k]
            return (next((g for g in hit if g), "") if isinstance(hit, tuple) else hit).strip()

        return col.map(one)

    return run


def regex(c: Column, pattern: str = DEFAULT_PATTERN, group_select: int = 0, fallback: str = FALLBACK) -> Column:
    if java_pattern(pattern) is None:
        raise ValueError("this pattern needs regex_arrow(), it cannot run inside a JVM expression")
    return F.transform(c, lambda r: F.coalesce(find_match(r, pattern, group_select), F.lit(fallback)))


def regex_arrow(c: Column, pattern: str, group_select: int = 0, fallback: str = FALLBACK) -> Column:
    """The same for patterns only Python can compile; one Arrow batch at a time."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(col):
        rx = re.compile(pattern)

        def one(text):
            found = rx.findall(text)
            if not -len(found) <= group_select < len(found):
                return fallback
            hit = found[group_select]
            return (next((g for g in hit if g), fallback) if isinstance(hit, tuple) else hit).strip()

        return col.map(lambda rs: None if rs is None else [one(r) for r in rs])

    return run(c)


def _loosen(c: Column, ignore_case: bool, ignore_punctuation: bool, regexes_to_ignore: Sequence[str] | None) -> Column:
    for p in regexes_to_ignore or []:
        c = F.regexp_replace(c, java_pattern(p), "")
    c = F.lower(c) if ignore_case else c
    return F.regexp_replace(c, r"\p{P}", "") if ignore_punctuation else c


def _any_of(options: Column) -> Column:
    return F.array_join(F.transform(options, quote), "|")


def _first_option(text: Column, options: Column) -> Column:
    """The option that begins first in a text, of several at one place the one listed first; null if there is none."""
    places = F.transform(options, lambda o, i: F.struct(F.position(o, text).alias("at"), i.alias("i"), o.alias("o")))
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["o"]


def _last_index(a: Column, v: Column) -> Column:
    back = F.nullif(F.array_position(F.reverse(a), v), F.lit(0))
    return F.size(a) - back.cast("int")


def multi_choice_regex(
    c: Column,
    choices: Column,
    pattern: str = DEFAULT_PATTERN,
    group_select: int = 0,
    fallback: str = FALLBACK,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    regexes_to_ignore: Sequence[str] | None = None,
) -> Column:
    """The pattern's match, else the option text found in the response as "(A)", else a letter after a colon.

    The first option text is found by position; only other choices of group_select need a pattern per list of options.
    """

    def loose(x: Column) -> Column:
        return _loosen(x, ignore_case, ignore_punctuation, regexes_to_ignore)

    options = F.transform(choices, lambda x: loose(trim(x)))
    # without options nothing matches; letters end at Z
    last = F.char(F.lit(64) + F.least(F.size(choices), F.lit(26)))
    colon = r"(?U):[\s]*([A-Z])"

    def one(r: Column) -> Column:
        first = _first_option(loose(r), options) if group_select == 0 else _pick(F.regexp_extract_all(loose(r), _any_of(options), F.lit(0)), group_select)
        text = F.nullif(trim(first), F.lit(""))
        named = F.coalesce(F.concat(F.lit("("), letter(_last_index(options, text)), F.lit(")")), text)
        letters = F.filter(F.regexp_extract_all(r, F.lit(colon), F.lit(1)), lambda h: h <= last)
        after = F.when(F.size(choices) > 0, _pick(letters, group_select))
        return F.coalesce(
            F.nullif(find_match(r, pattern, group_select), F.lit("")),
            named,
            F.concat(F.lit("("), after, F.lit(")")),
            F.lit(fallback),
        )

    return F.transform(c, one)


def simple_multi_choice(c: Column, question: Column) -> Column:
    """Options are read from the question; the first response becomes the letter of the option text it holds."""
    options = F.transform(F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Z])\.\s+([^\n]*)"), F.lit(2)), trim)
    cleaned = trim(F.regexp_replace(F.coalesce(F.get(c, F.lit(0)), F.lit("")), r"(?U)[^\w\s]", ""))
    hit = F.coalesce(_first_option(cleaned, options), F.lit(""))
    return F.array(F.coalesce(letter(_last_index(options, hit)), cleaned))


def strip_leading_space(c: Column) -> Column:
    return F.transform(c, lambda r: F.regexp_replace(r, "^ ", ""))


def lowercase(c: Column) -> Column:
    return F.transform(c, F.lower)


def uppercase(c: Column) -> Column:
    return F.transform(c, F.upper)


def map_values(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Dictionary lookup; the dictionary is part of the configuration. Large ones belong in a join."""
    if not mapping:
        return F.transform(c, lambda r: F.lit(default).cast("string"))
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    # a key mapped to null must not fall back to the default
    return F.transform(
        c, lambda r: F.when(F.map_contains_key(table, r), F.try_element_at(table, r)).otherwise(F.lit(default))
    )


def strip_reasoning(c: Column, tag_pairs: Sequence[tuple[str, str]] | None) -> Column:
    """Removes [start, end] blocks; when only the end tag is left, keeps the text after the last one."""
    if tag_pairs is None:
        return c
    for start, end in tag_pairs:
        c = F.regexp_replace(c, rf"(?s){re.escape(start)}.*?{re.escape(end)}", "")
        open_only = F.contains(c, F.lit(start))
        c = F.when(~open_only, F.substring_index(c, end, -1)).otherwise(c)
    return trim(c)


def reasoning_tags(run_value: str | None = None, task_value=None) -> list | None:
    """The task setting beats the run setting; "none" turns it off. Text values are JSON lists of pairs."""
    import json

    value = task_value if task_value is not None else run_value
    if value is None or value is False or value == "none":
        return None
    return json.loads(value) if isinstance(value, str) else list(value)


FILTERS: dict[str, Callable[..., Column]] = {
    "take_first": take_first,
    "take_first_k": take_first_k,
    "majority_vote": majority_vote,
    "regex": regex,
    "regex_arrow": regex_arrow,
    "strip_leading_space": strip_leading_space,
    "lowercase": lowercase,
    "uppercase": uppercase,
    "map": map_values,
}
ROW_FILTERS = {"multi_choice_regex": (multi_choice_regex, "choices"), "simple_multi_choice": (simple_multi_choice, "question")}

Step = str | tuple[str, dict] | Filter


def register_filter(name: str, fn: Callable[..., Column]) -> None:
    FILTERS[name] = fn


def _apply(c: Column, step: Step) -> Column:
    if callable(step):
        return step(c)
    name, args = (step, {}) if isinstance(step, str) else step
    if name in ROW_FILTERS:
        fn, column = ROW_FILTERS[name]
        args = dict(args)
        return fn(c, F.col(args.pop("column", column)), **args)
    if name not in FILTERS:
        raise KeyError(f"filter {name!r} is not registered")
    return FILTERS[name](c, **args)


def apply_filters(
    df: DataFrame, pipelines: dict[str, Sequence[Step]] | None = None, responses: str = "responses"
) -> DataFrame:
    """One row per question and pipeline: `filter`, `filtered` (array) and `response` (its first element)."""
    pipelines = pipelines or {"none": ["take_first"]}
    made = []
    for name, steps in pipelines.items():
        c = F.col(responses)
        for step in steps:
            c = _apply(c, step)
        made.append(F.struct(F.lit(name).alias("filter"), c.cast("array<string>").alias("filtered")))
    keep = [c for c in df.columns if c != responses]
    return (
        df.withColumn("_f", F.explode(F.array(*made)))
        .select(*keep, "_f.filter", "_f.filtered")
        .withColumn("response", F.get("filtered", F.lit(0)))
    )
