"""Parsing of free model text: cleaned answer, chosen option, times and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_words, empty_to_null, index_of, let, normalize, trim, trim_chars, word_edges

# Patterns and word lists that decide what counts as an answer.
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
COMBINING_LINE = "\u0332"
REASONING_TAIL = r"(?isU)</think>.*$"
FINAL_LETTER = r"(?iU)(?:final\s+answer|answer|correct\s+answer|option|choice)\s*(?:is|=|:|-)?\s*\(?\s*([A-Z])\s*\)?\b"
FINAL_TEXT = r"(?iU)(?:final\s+answer|answer|correct\s+answer)\s*(?:is|=|:|-)\s*([^\n\r]+)"
ECHO = (
    r"(?isU)\n\s*(?:Question\s*:|Options\s*:|Select\s+the\s+best\s+option"
    r"|\[BATCH\]|\[STEP\]|\[CLEANED OUTPUT\]).*$"
)
FIRST_LINE = r"^[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*"
LETTER_PHRASE = (
    r"(?iU)(?:FINAL\s+ANSWER|ANSWER|CORRECT\s+ANSWER|OPTION|CHOICE)\s*(?:IS|=|:|-)?\s*[\(\[]?\s*([A-",
    r"])(?=$|[^A-Z])",
)
LETTER_LEADING = (r"(?iU)^[\s\W_`'\"“”‘’（(【\[]*([A-", r"])(?=$|[^A-Z])")
LETTER_BULLET = (r"(?iU)^[\s>*\-•]+[\(\[]?\s*([A-", r"])(?=$|[^A-Z])")
OUTER_PUNCTUATION = r" .,:;!?()\[\]{}\"'`*_"
YES_NO = r"(?iU)\b(yes|no)\b"
RELATION_SYNONYMS = {
    "right": "to the right",
    "left": "to the left",
    "front": "in front of",
    "in front": "in front of",
    "ahead of": "in front of",
    "back": "behind",
    "at the back": "behind",
}
TIME_TOKEN = r"(?i)<TIME\s+(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)(?:\s+video\s+\d+)?>"
NUMBER = r"[-+]?\d*\.?\d+"
BARE_NUMBER = r"[-+]?\d*\.\d+|[-+]?\d+"
TIME_TEXTS = [
    rf"(?U)time\s*[:=]\s*({NUMBER})\s*s?",
    rf"(?U)last\s+visible\s*(?:at|time)?\s*[:=]?\s*({NUMBER})\s*s?",
    rf"(?U)({NUMBER})\s*s(?:ec(?:ond)?s?)?",
]
POINT_TEXTS = [
    rf"(?U)point\s*[:=]\s*\(?\s*({NUMBER})\s*,\s*({NUMBER})\s*\)?",
    rf"(?U)(?:coord(?:inate)?s?|location|position|pixel|xy|x,y)\s*[:=]\s*\(?\s*({NUMBER})\s*,\s*({NUMBER})\s*\)?",
    rf"(?U)\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)",
    rf"(?U)\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]",
    rf"(?U)x\s*[:=]\s*({NUMBER})\s*[,; ]+y\s*[:=]\s*({NUMBER})",
]


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ANSI, ""), COMBINING_LINE, "")


def first_line(c: Column) -> Column:
    return trim(F.regexp_extract(c, FIRST_LINE, 0))


def clean_prediction(c: Column) -> Column:
    """The answer part of a model text, one line.

    Everything from `</think>` on is dropped here, so `strip_reasoning` must run first for reasoning models.
    """
    text = trim(F.regexp_replace(trim(strip_ansi(F.coalesce(c, F.lit("")))), REASONING_TAIL, ""))

    def answer(t: Column) -> Column:
        stated = F.coalesce(
            F.try_element_at(F.regexp_extract_all(t, F.lit(FINAL_LETTER), F.lit(1)), F.lit(-1)),
            F.try_element_at(F.regexp_extract_all(t, F.lit(FINAL_TEXT), F.lit(1)), F.lit(-1)),
        )
        return F.coalesce(first_line(trim(stated)), first_line(trim(F.regexp_replace(t, ECHO, ""))))

    return let(text, answer)


def letter_index(pred: Column, n: Column) -> Column:
    """Index of the option letter named in a text, -1 if none; letters beyond the n-th option never match.

    The patterns are the same for every n: matches with a later letter are passed over. No other match begins inside one of
    them, so what is left is what a pattern with n letters would find.
    """
    up = trim(F.upper(strip_ansi(F.coalesce(pred, F.lit("")))))

    def found(text: Column, parts: tuple[str, str]) -> Column:
        letters = F.regexp_extract_all(text, F.lit(parts[0] + "Z" + parts[1]), F.lit(1))
        return F.get(F.filter(F.transform(letters, lambda h: F.ascii(h) - 65), lambda i: i < n), F.lit(0))

    kinds = (LETTER_PHRASE, LETTER_LEADING, LETTER_BULLET)
    return let(up, lambda t: F.coalesce(*[found(t, k) for k in kinds], F.lit(-1)))


def relation_text(c: Column) -> Column:
    """Normalized text with short forms of spatial relations spelled out and outer punctuation removed."""
    pairs = [F.lit(x) for kv in RELATION_SYNONYMS.items() for x in kv]
    full = let(normalize(c), lambda t: F.coalesce(F.try_element_at(F.create_map(*pairs), t), t))
    return trim_chars(full, OUTER_PUNCTUATION)


def _choice_hit(norm: Column, options: Column) -> Column:
    yes_no = F.lower(F.regexp_extract(norm, YES_NO, 1))
    marked = F.transform(options, lambda c: F.struct(c.alias("text"), word_edges(c).alias("edges")))
    whole = let(F.struct(norm.alias("text"), word_edges(norm).alias("edges"), marked.alias("options")), _worded)
    return F.coalesce(index_of(options, norm), F.when(yes_no != "", index_of(options, yes_no)), whole, F.lit(-1))


def _worded(s: Column) -> Column:
    """The first option that stands in the text as whole words, else the first in which the text does."""
    inside = lambda part, text: (part["text"] != "") & F.contains(text["edges"], as_words(part["edges"]))
    return F.coalesce(
        index_of(F.transform(s["options"], lambda c: inside(c, s)), F.lit(True)),
        index_of(F.transform(s["options"], lambda c: inside(s, c)), F.lit(True)),
    )


def choice_text_index(pred: Column, choices: Column) -> Column:
    """Index of the option whose text was given, -1 if none."""
    norm, options = relation_text(clean_prediction(pred)), F.transform(choices, relation_text)
    return let(F.struct(norm.alias("t"), options.alias("o")), lambda s: _choice_hit(s["t"], s["o"]))


def with_prediction_index(df: DataFrame, pred: str, choices: str, out: str = "pred_idx") -> DataFrame:
    """Letter, then option text, on the cleaned answer; then both on the raw text."""
    n = F.coalesce(F.size(choices), F.lit(0))
    asked = n > 0

    def prepared(c: Column) -> Column:
        return F.when(asked, relation_text(clean_prediction(c)))

    step = df.withColumn("_clean", clean_prediction(F.col(pred))).withColumns(
        {
            "_options": F.transform(choices, relation_text),
            "_norm": prepared(F.col("_clean")),
            "_raw_norm": F.when(asked, relation_text(F.col("_clean"))),
        }
    )
    idx = F.coalesce(
        F.nullif(letter_index(F.col("_clean"), n), F.lit(-1)),
        F.nullif(_choice_hit(F.col("_norm"), F.col("_options")), F.lit(-1)),
        F.nullif(letter_index(F.col(pred), n), F.lit(-1)),
        F.nullif(_choice_hit(F.col("_raw_norm"), F.col("_options")), F.lit(-1)),
    )
    return step.withColumn(out, F.coalesce(F.when(asked, idx), F.lit(-1))).drop("_clean", "_options", "_norm", "_raw_norm")


def parse_time_token(c: Column) -> Column:
    h, m, s = [F.regexp_extract(c, TIME_TOKEN, g).try_cast("double") for g in (1, 2, 3)]
    return h * 3600 + m * 60 + s


def _number(c: Column) -> Column:
    return empty_to_null(c).try_cast("double")


def parse_time_point(pred: Column, time_only: bool = False) -> Column:
    """struct(time_sec, x, y) read from a text; any part may be null."""
    return time_point_of(clean_prediction(pred), time_only)


def time_point_of(clean: Column, time_only: bool = False) -> Column:
    """The same for a text already cleaned."""

    def read(s: Column) -> Column:
        text, low = s["text"], s["low"]
        numbers = F.transform(F.regexp_extract_all(low, F.lit(BARE_NUMBER), F.lit(0)), lambda v: v.try_cast("double"))
        time = F.coalesce(parse_time_token(text), *[_number(F.regexp_extract(low, p, 1)) for p in TIME_TEXTS])
        if time_only:
            time = F.coalesce(time, F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0))))
        # both numbers of a point come from one pattern
        points = [
            F.struct(_number(F.regexp_extract(low, p, 1)).alias("x"), _number(F.regexp_extract(low, p, 2)).alias("y"))
            for p in POINT_TEXTS
        ]
        point = F.coalesce(*[F.when(F.rlike(low, F.lit(p)), q) for p, q in zip(POINT_TEXTS, points)])
        return F.struct(
            time.alias("t"), point.alias("p"), numbers.alias("n"), (~F.contains(low, F.lit("<time"))).alias("bare")
        )

    def fill(r: Column) -> Column:
        n = r["n"]
        bare = r["bare"] & (F.size(n) >= 3)
        return F.struct(
            F.coalesce(r["t"], F.when(bare, F.get(n, F.lit(0)))).alias("time_sec"),
            F.coalesce(r["p"]["x"], F.when(bare, F.try_element_at(n, F.lit(-2)))).alias("x"),
            F.coalesce(r["p"]["y"], F.when(bare, F.try_element_at(n, F.lit(-1)))).alias("y"),
        )

    return let(let(let(clean, lambda c: F.struct(c.alias("text"), F.lower(c).alias("low"))), read), fill)
