"""Queries over model responses: filters, parsing, scoring, text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters as E
from ..functions import parsing as P
from ..functions import text_metrics as M
from ..operators import contamination, media
from ..operators import scoring as S
from ..operators import text_corpus as C
from . import fixtures as V
from .catalog import VIEWS, query, rounded, spread, table

# --- filters: responses are the words of a document's lines, or several attempts per question ---

VIEWS["line_words"] = """
SELECT doc_id, string_split(text, chr(10)) AS lines, n_chars FROM documents"""


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("responses"))


def _joined(df, *steps):
    out = E.apply_filters(df, {"x": list(steps)})
    return out.select("doc_id", F.size("filtered").alias("n"), F.array_join("filtered", "|").alias("filtered"))


@query("take_first", "SELECT doc_id, 1 AS n, lines[1] AS filtered FROM line_words", ["line_words"])
def take_first(spark, d):
    return _joined(_lines(spark, d), "take_first")


@query(
    "take_first_k",
    "SELECT doc_id, 2 AS n, array_to_string(list_slice(list_concat(lines, lines), 1, 2), '|') AS filtered FROM line_words",
    ["line_words"],
)
def take_first_k(spark, d):
    # every document answers twice, so that there are always k responses
    return _joined(_lines(spark, d).withColumn("responses", F.concat("responses", "responses")), ("take_first_k", {"k": 2}))


@query(
    "majority_vote",
    """, w AS (SELECT doc_id, unnest(lines) AS v, generate_subscripts(lines, 1) AS i FROM line_words),
c AS (SELECT doc_id, v, count(*) AS n, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, 1 AS n, v AS filtered FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM c) WHERE r = 1""",
    ["line_words"],
)
def majority_vote(spark, d):
    return _joined(_lines(spark, d), "majority_vote")


@query(
    "regex",
    """ SELECT doc_id, len(lines) AS n, array_to_string([CASE WHEN len(regexp_extract_all(x, '([0-9]+)[:. ]', 1)) > 0 THEN regexp_extract_all(x, '([0-9]+)[:. ]', 1)[1] ELSE '[invalid]' END for x in lines], '|') AS filtered FROM line_words""",
    ["line_words"],
)
def regex(spark, d):
    return _joined(_lines(spark, d), ("regex", {"pattern": r"([0-9]+)[:. ]"}))


@query(
    "regex_groups",
    """ SELECT doc_id, len(lines) AS n, array_to_string([CASE WHEN len(regexp_extract_all(x, '(?:([0-9]+)%|([a-z]+)[?!.])')) > 0 THEN regexp_replace(regexp_extract_all(x, '(?:([0-9]+)%|([a-z]+)[?!.])')[-1], '[%?!.]', '') ELSE 'none' END for x in lines], '|') AS filtered FROM line_words""",
    ["line_words"],
)
def regex_groups(spark, d):
    step = ("regex", {"pattern": r"(?:([0-9]+)%|([a-z]+)[?!.])", "group_select": -1, "fallback": "none"})
    return _joined(_lines(spark, d), step)


@query("regex_arrow", """ SELECT doc_id, len(lines) AS n, array_to_string([CASE WHEN len(regexp_extract_all(x, '(?i)([aeiou])[aeiou]', 1)) > 0 THEN regexp_extract_all(x, '(?i)([aeiou])[aeiou]', 1)[1] ELSE '[invalid]' END for x in lines], '|') AS filtered FROM line_words""", ["line_words"])
def regex_arrow(spark, d):
    return _joined(_lines(spark, d), ("regex_arrow", {"pattern": r"([aeiouAEIOU])(?=[aeiouAEIOU])"}))


@query(
    "strip_leading_space",
    "SELECT doc_id, len(lines) AS n, array_to_string([CASE WHEN starts_with(x, ' ') THEN x[2:] ELSE x END for x in [CASE WHEN doc_id % 2 = 0 THEN ' ' || y ELSE y END for y in lines]], '|') AS filtered FROM line_words",
    ["line_words"],
)
def strip_leading_space(spark, d):
    rows = _lines(spark, d).withColumn("responses", F.transform("responses", lambda x: F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), x)).otherwise(x)))
    return _joined(rows, "strip_leading_space")


@query("lowercase", "SELECT doc_id, len(lines) AS n, lower(array_to_string(lines, '|')) AS filtered FROM line_words", ["line_words"])
def lowercase(spark, d):
    return _joined(_lines(spark, d), "lowercase")


@query("uppercase", "SELECT doc_id, len(lines) AS n, upper(replace(array_to_string(lines, '|'), 'ß', 'SS')) AS filtered FROM line_words", ["line_words"])
def uppercase(spark, d):
    # the capital of the German sharp s is two letters here; SQL keeps the letter unless told
    return _joined(_lines(spark, d), "uppercase")


@query(
    "map_values",
    "SELECT conv_id AS doc_id, turn, CASE role WHEN 'user' THEN 'ask' WHEN 'assistant' THEN 'answer' ELSE 'other' END AS response FROM conversations",
)
def map_values(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.array("role").alias("responses"))
    steps = [("map", {"mapping": {"user": "ask", "assistant": "answer"}, "default": "other"})]
    return E.apply_filters(rows, {"x": steps}).select("doc_id", "turn", "response")


# options are words of the next turn, so some are in the text and some are not
VIEWS["worded"] = """
SELECT conv_id, turn, prediction, [list_extract(string_split(reference, ' '), CAST((k * 3) % len(string_split(reference, ' ')) + 1 AS BIGINT)) for k in [0, 1, 2, 3]] AS options FROM turn_pairs"""


def _worded(spark, d):
    words = F.split("reference", " ")
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(words, (k * 3) % F.size(words)))
    return V.turn_pairs(spark, d).select("conv_id", "turn", "prediction", options.alias("options"))


@query(
    "multi_choice_regex",
    """, o AS (SELECT conv_id, turn, prediction, [regexp_replace(lower(x), '^\\s+|\\s+$', '', 'g') for x in options] AS options, lower(prediction) AS text FROM worded),
 h AS (SELECT *, list_min([{'at': strpos(text, options[k]), 'k': k} for k in [1, 2, 3, 4] if contains(text, options[k])]).k AS k FROM o)
 SELECT conv_id, turn, CASE WHEN options[k] <> '' THEN '(' || chr(CAST(64 + list_max([j for j in [1, 2, 3, 4] if options[j] = options[k]]) AS INTEGER)) || ')'
 ELSE COALESCE('(' || NULLIF(regexp_extract(prediction, ':\\s*([A-D])', 1), '') || ')', '[invalid]') END AS response FROM h""",
    ["turn_pairs", "worded"],
)
def multi_choice_regex(spark, d):
    rows = _worded(spark, d).select("conv_id", "turn", F.col("options").alias("choices"), F.array("prediction").alias("responses"))
    step = ("multi_choice_regex", {"pattern": "#### ([A-Z])", "ignore_case": True})
    return E.apply_filters(rows, {"x": [step]}).select("conv_id", "turn", "response")


@query(
    "simple_multi_choice",
    """, o AS (SELECT conv_id, turn, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in options] AS options, regexp_replace(regexp_replace(prediction, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM worded),
 h AS (SELECT *, list_min([{'at': strpos(text, options[k]), 'k': k} for k in [1, 2, 3, 4] if contains(text, options[k])]).k AS k FROM o)
 SELECT conv_id, turn, CASE WHEN k IS NULL THEN text ELSE chr(CAST(64 + list_max([j for j in [1, 2, 3, 4] if options[j] = options[k]]) AS INTEGER)) END AS response FROM h""",
    ["turn_pairs", "worded"],
)
def simple_multi_choice(spark, d):
    o = [F.get("options", F.lit(k)) for k in range(4)]
    question = F.concat(F.lit("Pick:\nA. "), o[0], F.lit("\nB.  "), o[1], F.lit("\nC. "), o[2], F.lit(" \nD. "), o[3])
    rows = _worded(spark, d).select("conv_id", "turn", question.alias("question"), F.array("prediction").alias("responses"))
    return E.apply_filters(rows, {"x": ["simple_multi_choice"]}).select("conv_id", "turn", "response")


@query(
    "apply_filters",
    """ SELECT doc_id, 'first' AS filter, 1 AS n, lines[1] AS response FROM line_words
 UNION ALL SELECT doc_id, 'upper2', 2, upper(lines[1]) FROM line_words WHERE len(lines) >= 2
 UNION ALL SELECT doc_id, 'upper2', len(lines), upper(lines[1]) FROM line_words WHERE len(lines) < 2
 UNION ALL SELECT doc_id, 'own', len(lines), lines[1] || '.' FROM line_words""".replace("upper(", "lower("),
    ["line_words"],
)
def apply_filters(spark, d):
    pipes = {
        "first": ["take_first"],
        "upper2": ["lowercase", lambda c: F.slice(c, 1, 2)],
        "own": [lambda c: F.transform(c, lambda x: F.concat(x, F.lit(".")))],
    }
    return E.apply_filters(_lines(spark, d), pipes).select("doc_id", "filter", F.size("filtered").alias("n"), "response")


@query(
    "strip_reasoning",
    """ SELECT conv_id, turn, regexp_replace(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN role WHEN 2 THEN role || text ELSE '<think>' || role END, '^\\s+|\\s+$', '', 'g') AS response FROM conversations""",
)
def strip_reasoning(spark, d):
    t = F.col("turn") % 4
    s = F.col("text")
    reply = (
        F.when(t == 0, F.concat(F.lit("<think>a\nb</think> "), s))
        .when(t == 1, F.concat(s, F.lit("</think>x</think>\n"), "role"))
        .when(t == 2, F.concat("role", F.lit("<r>"), s, F.lit("</r><think></think>"), s))
        .otherwise(F.concat(F.lit("<think>"), "role", F.lit(" ")))
    )
    tags = E.reasoning_tags('[["<think>", "</think>"], ["<r>", "</r>"]]')
    return table(spark, d, "conversations").select("conv_id", "turn", E.strip_reasoning(reply, tags).alias("response"))


# --- parsing ---

CHOICE = "list_extract(['up', 'to the left', 'no', 'behind it'], CAST(pick + 1 AS INTEGER))"


@query(
    "clean_prediction",
    f""" SELECT doc_id, CASE kind WHEN 0 THEN letter WHEN 1 THEN '(' || letter || ') 2022' WHEN 2 THEN '- ' || letter || '.' WHEN 3 THEN letter
 WHEN 4 THEN {CHOICE} WHEN 5 THEN CASE WHEN pick = 9 THEN '' ELSE {CHOICE} || '!' END WHEN 6 THEN '' ELSE 'It would be 12345 ' || {CHOICE} END AS cleaned FROM replies""",
    ["replies"],
)
def clean_prediction(spark, d):
    return V.replies(spark, d).select("doc_id", P.clean_prediction(F.col("prediction")).alias("cleaned"))


PREDICTION = f"""CASE kind WHEN 0 THEN 'The answer is (' || letter || ').' || chr(10) || text WHEN 1 THEN '(' || letter || ') 2022' || chr(10) || text
 WHEN 2 THEN chr(10) || '- ' || letter || '.' || chr(10) || chr(10) || 'Question: ' || text WHEN 3 THEN letter || '</think>' || text WHEN 4 THEN {CHOICE} || chr(10) || ' [step] ' || text
 WHEN 5 THEN 'Final answer: ' || {CHOICE} || '!' || chr(10) || text WHEN 6 THEN '' ELSE 'It would be 12345 ' || {CHOICE} END"""
#: The three patterns with a letter range, as the other engine writes them.
LETTERS = [
    "(?:FINAL\\s+ANSWER|ANSWER|CORRECT\\s+ANSWER|OPTION|CHOICE)\\s*(?:IS|=|:|-)?\\s*[\\(\\[]?\\s*([A-{0}])(?:$|[^A-Z])",
    "^[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]*(?:[_`\"][^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]*)*([A-{0}])(?:$|[^A-Z])",
    "^[\\s>*\\-•]+[\\(\\[]?\\s*([A-{0}])(?:$|[^A-Z])",
]


def _letter_sql(top: str) -> str:
    found = ", ".join("NULLIF(regexp_extract(p, '" + x.format(top) + "', 1), '')" for x in LETTERS)
    return f"COALESCE(ascii(COALESCE({found})) - 65, -1)"


@query(
    "letter_index",
    f""", r AS (SELECT doc_id, upper(regexp_replace({PREDICTION}, '^\\s+|\\s+$', '', 'g')) AS p FROM replies)
 SELECT doc_id, {_letter_sql("D")} AS idx4, {_letter_sql("B")} AS idx2 FROM r""",
    ["replies"],
)
def letter_index(spark, d):
    p = F.col("prediction")
    return V.replies(spark, d).select("doc_id", P.letter_index(p, F.lit(4)).alias("idx4"), P.letter_index(p, F.lit(2)).alias("idx2"))


# kinds 4, 5 and 7 give an option's text; the others start with a line that holds none, or no whole one
@query(
    "choice_text_index",
    """ SELECT doc_id, CASE WHEN kind IN (4, 5, 7) THEN pick ELSE -1 END AS idx FROM replies""",
    ["replies"],
)
def choice_text_index(spark, d):
    return V.replies(spark, d).select("doc_id", P.choice_text_index(F.col("prediction"), F.col("choices")).alias("idx"))


@query(
    "prediction_index",
    """ SELECT doc_id, kind, CASE WHEN kind = 6 THEN -1 ELSE pick END AS idx FROM replies""",
    ["replies"],
)
def prediction_index(spark, d):
    return P.with_prediction_index(V.replies(spark, d), "prediction", "choices", "idx").select("doc_id", "kind", "idx")


@query("parse_time_token", "SELECT event_id, round(value * 30, 0) / 2 AS seconds FROM events")
def parse_time_token(spark, d):
    half = F.round(F.col("value") * 30, 0) / 2
    token = media.time_token(half)
    return table(spark, d, "events").select("event_id", P.parse_time_token(F.concat(F.lit("at "), token)).alias("seconds"))


TIMES = "round(value, 1) AS t, (event_id % 11) / 10.0::DOUBLE AS x, (event_id % 7) / 10.0::DOUBLE AS y"


def _time_replies(spark, d):
    e = table(spark, d, "events")
    t, x, y = F.round("value", 1), (F.col("event_id") % 11) / F.lit(10.0), (F.col("event_id") % 7) / F.lit(10.0)
    k = F.col("event_id") % 6
    s = lambda c: c.cast("string")
    text = (
        F.when(k == 0, F.concat(media.time_token(t), F.lit("; Point=("), s(x), F.lit(", "), s(y), F.lit(")")))
        .when(k == 1, F.concat(F.lit("time: "), s(t), F.lit(" s, location = ("), s(x), F.lit(", "), s(y), F.lit(")")))
        .when(k == 2, F.concat(s(t), F.lit(" "), s(x), F.lit(" "), s(y)))
        .when(k == 3, F.concat(F.lit("Last visible at "), s(t), F.lit(" seconds [ "), s(x), F.lit(" ,"), s(y), F.lit("]")))
        .when(k == 4, F.concat(s(t), F.lit("sec x="), s(x), F.lit("; y: "), s(y)))
        .otherwise(F.lit("cannot tell"))
    )
    return e.select("event_id", "event_type", "value", t.alias("t"), x.alias("x"), y.alias("y"), k.alias("kind"), text.alias("prediction"))


@query(
    "parse_time_point",
    f"SELECT event_id, CASE WHEN event_id % 6 < 5 THEN t END AS time_sec, CASE WHEN event_id % 6 < 5 THEN x END AS px, CASE WHEN event_id % 6 < 5 THEN y END AS py FROM (SELECT event_id, {TIMES} FROM events)",
)
def parse_time_point(spark, d):
    r = _time_replies(spark, d).withColumn("p", P.parse_time_point(F.col("prediction")))
    return r.select("event_id", "p.time_sec", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


# --- scoring ---


@query(
    "score_time_point",
    f"""WITH e AS (SELECT event_id, {TIMES}, event_id % 6 < 5 AS seen FROM events),
g AS (SELECT *, event_id % 3 = 0 AS listed, t + (event_id % 5) * 0.4 AS gt, x + (event_id % 4) * 0.03 AS gx FROM e),
s AS (SELECT *, abs(t - gt) AS dt, abs(x - gx) AS dc FROM g)
SELECT event_id, 'time_point' AS scored_as, CASE WHEN seen AND dt <= 1.0 AND dc <= 0.08 THEN 1.0 ELSE 0.0 END AS accuracy, seen AS parsed, TRUE AS scorable,
 CASE WHEN seen THEN round(dt, 6) END AS time_error, CASE WHEN seen THEN round(dc, 6) END AS coord_error,
 CASE WHEN NOT listed THEN 'default_single_gold' WHEN seen THEN 'near' ELSE 'far' END AS source FROM s""",
)
def score_time_point(spark, d):
    r = _time_replies(spark, d)
    e = F.col("event_id")
    gt, gx = F.col("t") + (e % 5) * 0.4, F.col("x") + (e % 4) * 0.03
    point = lambda dt, name: F.struct(
        (gt + dt).alias("time_sec"), F.array(gx, F.col("y")).alias("normalized_projected_pixel"), F.lit(name).alias("reference_source")
    )
    meta = F.struct(
        gt.alias("sampled_last_visible_time_sec"),
        F.lit(None).cast("double").alias("last_placement_time_sec"),
        F.array(gx, F.col("y")).alias("normalized_projected_pixel"),
        F.when(e % 3 == 0, F.array(point(F.lit(50.0), "far"), point(F.lit(0.0), "near"))).alias("acceptable_answer_metadata"),
    )
    rows = r.select(
        "event_id",
        "prediction",
        F.lit("OOS_step2_last_visible ").alias("step_question_class"),
        F.lit(None).cast("array<string>").alias("choices"),
        F.lit(None).cast("int").alias("answer_idx"),
        F.lit("later").alias("answer"),
        F.lit(None).cast("array<string>").alias("acceptable_answers"),
        F.lit(None).cast("array<int>").alias("acceptable_answer_idxs"),
        meta.alias("answer_metadata"),
    )
    out = S.score_answers(rows)
    return rounded(
        out.select(
            "event_id",
            "scored_as",
            "accuracy",
            "parsed",
            "scorable",
            F.col("time_error_sec").alias("time_error"),
            F.col("coord_error_linf").alias("coord_error"),
            F.col("matched_gold_source").alias("source"),
        )
    )


def _questions(spark, d):
    """A question per reply: options for three classes, text answers, and some without any gold."""
    r = V.replies(spark, d)
    k = F.col("kind")
    many = k.isin(0, 1, 2, 3, 7)
    meta = "struct<sampled_last_visible_time_sec:double,last_placement_time_sec:double,normalized_projected_pixel:array<double>,acceptable_answer_metadata:array<struct<time_sec:double,normalized_projected_pixel:array<double>,reference_source:string>>>"
    return r.select(
        "doc_id",
        "task",
        F.when(k == 5, "oos_step2_last_visible").otherwise("plain").alias("step_question_class"),
        F.when(many, F.col("choices")).alias("choices"),
        F.when(many, F.lit(1)).alias("answer_idx"),
        F.when(k == 4, F.lit("  UP ")).when(k == 5, F.lit("no!")).alias("answer"),
        F.when(k == 4, F.array(F.lit(" "), F.lit("Behind  it"))).alias("acceptable_answers"),
        F.when(k == 2, F.array(F.lit(0), F.lit(3))).alias("acceptable_answer_idxs"),
        F.lit(None).cast(meta).alias("answer_metadata"),
    )


@query(
    "score_responses",
    """ SELECT doc_id, CASE WHEN kind IN (0, 1, 2, 3, 7) THEN 'choice' WHEN kind IN (4, 5) THEN 'text' ELSE 'none' END AS scored_as,
 CASE WHEN kind IN (0, 1, 3, 7) THEN CAST(pick = 1 AS DOUBLE) WHEN kind = 2 THEN CAST(pick IN (0, 3) AS DOUBLE) WHEN kind = 4 THEN CAST(pick IN (0, 3) AS DOUBLE)
 WHEN kind = 5 THEN CAST(pick = 2 AS DOUBLE) END AS accuracy, kind <> 6 AS parsed, kind <> 6 AS scorable,
 CASE WHEN kind IN (0, 1, 2, 3, 7) THEN list_extract(['up', 'to the left', 'no', 'behind it'], CAST(pick + 1 AS INTEGER)) END AS pred_choice FROM replies""",
    ["replies"],
)
def score_responses(spark, d):
    responses = V.replies(spark, d).select("doc_id", "task", "prediction")
    out = S.score_responses(_questions(spark, d), responses)
    return out.select("doc_id", "scored_as", "accuracy", "parsed", "scorable", "pred_choice")


@query(
    "exact_match",
    r""" SELECT conv_id, turn, NOT contains(prediction, 'ß') AS same, lower(prediction) = lower(reference) AS other FROM turn_pairs""",
    ["turn_pairs"],
)
def exact_match(spark, d):
    p = V.turn_pairs(spark, d)
    noisy = F.upper(F.concat(F.lit("12, "), "prediction", F.lit("!?7")))
    same = M.exact_match(noisy, F.col("prediction"), ["^12, "], True, True, True)
    other = M.exact_match(F.col("prediction"), F.col("reference"), ignore_case=True)
    return p.select("conv_id", "turn", (same == 1).alias("same"), (other == 1).alias("other"))




# no SQL: the other engine's edit distance counts bytes; tests/test_whole_queries.py holds all rows against brute force
@query("anls")
def anls(spark, d):
    p = spread(V.turn_pairs(spark, d), "doc_id")
    return rounded(p.select("conv_id", "turn", M.anls(F.col("prediction"), F.col("references"), 0.25).alias("anls")))


@query(
    "max_over_references",
    "SELECT conv_id, turn, greatest(CAST(length(reference) % 5 = length(prediction) % 5 AS DOUBLE), CAST(length(reference2) % 5 = length(prediction) % 5 AS DOUBLE)) AS best FROM turn_pairs",
    ["turn_pairs"],
)
def max_over_references(spark, d):
    same = lambda p, r: (F.length(p) % 5 == F.length(r) % 5).cast("double")
    p = V.turn_pairs(spark, d)
    return p.select("conv_id", "turn", M.max_over_references(same, F.col("prediction"), F.col("references")).alias("best"))


@query(
    "score_generation",
    """, p AS (SELECT conv_id, turn, turn % 3 AS k, prediction, reference, regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') AS said FROM turn_pairs)
 SELECT conv_id, turn, CAST(CASE k WHEN 0 THEN said = prediction WHEN 1 THEN said = prediction OR said = reference ELSE said IN ('1', '2') END AS DOUBLE) AS exact_match, CAST(k < 2 AS DOUBLE) AS anls FROM p""",
    ["turn_pairs"],
)
def score_generation(spark, d):
    p = spread(V.turn_pairs(spark, d), "doc_id")
    k = F.col("turn") % 3
    targets = F.when(k == 0, F.array("prediction")).when(k == 1, F.array("reference", "prediction")).otherwise(F.array(F.lit("1"), F.lit("2")))
    rows = p.select("conv_id", "turn", F.concat(F.lit(" "), "prediction", F.lit("\n")).alias("response"), targets.alias("targets"))
    metrics = {"exact_match": M.exact_match, "anls": (lambda p, ts: M.anls(p, ts, 0.95), "whole")}
    return S.score_generation(rows, metrics).select("conv_id", "turn", "exact_match", "anls")


@query(
    "strip_results",
    "SELECT doc_id, array_to_string([trim(x, ' ' || chr(9) || chr(10) || chr(13)) for x in lines], '|') AS stripped FROM line_words",
    ["line_words"],
)
def strip_results(spark, d):
    rows = _lines(spark, d).withColumn("nested", F.array("responses", F.array(F.lit("x"))))
    return rows.select("doc_id", F.array_join(S.strip_nested_results(F.col("nested")), "|").alias("stripped"))


@query(
    "score_loglikelihood",
    "SELECT vec_id, idx, CAST(ll AS DOUBLE) AS perplexity, CAST(ll > 0 AS INTEGER) AS acc FROM (SELECT vec_id, unnest(l) AS ll, generate_subscripts(l, 1) - 1 AS idx FROM losses)",
    ["losses"],
)
def score_loglikelihood(spark, d):
    rows = V.losses(spark, d).select("vec_id", F.posexplode("losses").alias("idx", "ll"))
    return S.score_loglikelihood(rows.withColumn("is_greedy", F.col("ll") > 0)).select("vec_id", "idx", "perplexity", "acc")


MC = """, x AS (SELECT vec_id, gold, l, [CAST(l[i] AS DOUBLE) / (1 + (i - 1) % 7) for i in range(1, len(l) + 1)] AS per, [CAST(l[i] AS DOUBLE) - CAST(u[i] AS DOUBLE) for i in range(1, len(l) + 1)] AS more FROM losses),
 p AS (SELECT vec_id, gold, list_position(l, list_min(l)) - 1 AS pred, list_position(per, list_min(per)) - 1 AS pn, l[CAST(gold + 1 AS INTEGER)] > 0 AS g, list_position(more, list_max(more)) - 1 AS mi FROM x)"""


@query(
    "score_multiple_choice",
    MC
    + """ SELECT vec_id, pred, CAST(pred = gold AS DOUBLE) AS acc, CAST(pn = gold AS DOUBLE) AS acc_norm, CAST(g AS INTEGER) AS exact_match, CAST(mi = gold AS DOUBLE) AS acc_mutual_info FROM p WHERE vec_id % 10 > 0
 UNION ALL SELECT vec_id, pred, 0.0, 0.0, 0, 0.0 FROM p WHERE vec_id % 10 = 0""",
    ["losses"],
)
def score_multiple_choice(spark, d):
    rows = V.losses(spark, d)
    bad = F.col("vec_id") % 10 == 0
    rows = rows.withColumns(
        {"golds": F.array(F.when(bad, 1_000).otherwise(F.col("gold"))), "greedy": F.transform("losses", lambda x: x > 0)}
    )
    out = S.score_multiple_choice(rows, unconditional="unconditional")
    return out.select("vec_id", "pred", "acc", "acc_norm", "exact_match", "acc_mutual_info")


@query(
    "score_multiple_choice_rows",
    MC + " SELECT vec_id, pred, CAST(pred = gold AS DOUBLE) AS acc, CAST(pn = gold AS DOUBLE) AS acc_norm, CAST(g AS INTEGER) AS exact_match FROM p",
    ["losses"],
)
def score_multiple_choice_rows(spark, d):
    rows = V.losses(spark, d).select("vec_id", "gold", F.posexplode(F.arrays_zip("losses", "choices")).alias("idx", "z"))
    rows = rows.select("vec_id", "gold", F.col("z.losses").alias("ll"), F.col("z.choices").alias("choice"), "idx", (F.col("z.losses") > 0).alias("is_greedy"))
    return S.score_multiple_choice_rows(rows, ["vec_id"]).select("vec_id", "pred", "acc", "acc_norm", "exact_match")


# --- corpus text metrics ---

BLEU_SQL = r""", s0 AS (SELECT conv_id, turn, task, side, replace(replace(replace(replace(' ' || replace(replace(replace(t, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ') || ' ', '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS t
 FROM (SELECT conv_id, turn, task, 0 AS side, prediction AS t FROM turn_pairs UNION ALL SELECT conv_id, turn, task, 1, reference FROM turn_pairs UNION ALL SELECT conv_id, turn, task, 2, reference2 FROM turn_pairs WHERE reference2 IS NOT NULL)),
s1 AS (SELECT * REPLACE (regexp_replace(t, '([\{-\~\[-\x60 -\&\(-\+\:-\@/])', ' \1 ', 'g') AS t) FROM s0),
s2 AS (SELECT * REPLACE (regexp_replace(t, '([^0-9])([\.,])', '\1 \2 ', 'g') AS t) FROM s1),
s3 AS (SELECT * REPLACE (regexp_replace(t, '([\.,])([^0-9])', ' \1 \2', 'g') AS t) FROM s2),
s4 AS (SELECT * REPLACE (regexp_replace(t, '([0-9])(-)', '\1 \2 ', 'g') AS t) FROM s3),
w AS (SELECT conv_id, turn, task, side, [x for x in regexp_split_to_array(t, '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+') if x <> ''] AS w FROM s4),
g AS (SELECT conv_id, turn, task, side, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT w.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(n))),
c AS (SELECT conv_id, turn, task, side, n, gram, count(*) AS k FROM g GROUP BY ALL),
r AS (SELECT conv_id, turn, n, gram, max(k) AS k FROM c WHERE side > 0 GROUP BY ALL),
m AS (SELECT c.task, c.n, sum(c.k) AS total, sum(least(c.k, COALESCE(r.k, 0))) AS hit FROM c LEFT JOIN r USING (conv_id, turn, n, gram) WHERE side = 0 GROUP BY ALL),
lens AS (SELECT p.task, p.conv_id, p.turn, len(p.w) AS pl, len(q.w) AS rl, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY abs(len(q.w) - len(p.w)), len(q.w)) AS k FROM w p JOIN w q USING (conv_id, turn) WHERE p.side = 0 AND q.side > 0),
b AS (SELECT task, sum(pl) AS pl, sum(rl) AS rl FROM lens WHERE k = 1 GROUP BY task)
SELECT task, round(100 * CASE WHEN pl < rl THEN exp(1 - rl / pl) ELSE 1 END * exp(avg(ln(CASE WHEN hit > 0 THEN hit ELSE pow(0.5, z) END / total))), 6) AS bleu
FROM (SELECT *, count(*) FILTER (WHERE hit = 0) OVER (PARTITION BY task ORDER BY n) AS z FROM m) JOIN b USING (task) GROUP BY task, pl, rl"""


@query("bleu", BLEU_SQL, ["turn_pairs"])
def bleu(spark, d):
    return rounded(C.corpus_metric(V.turn_pairs(spark, d), ["task"], "bleu"))


CHRF_SQL = r""", s AS (SELECT conv_id, turn, task, side, regexp_replace(t, '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+', '', 'g') AS t FROM (SELECT conv_id, turn, task, 0 AS side, prediction AS t FROM turn_pairs UNION ALL SELECT conv_id, turn, task, 1, reference FROM turn_pairs)),
g AS (SELECT conv_id, turn, task, side, n, substring(t, i, n) AS gram FROM (SELECT s.*, n, unnest(range(1, length(t) - n + 2)) AS i FROM s, (VALUES (1), (2), (3), (4), (5), (6)) x(n))),
c AS (SELECT conv_id, turn, task, n, gram, count(*) FILTER (WHERE side = 0) AS h, count(*) FILTER (WHERE side = 1) AS r FROM g GROUP BY ALL),
o AS (SELECT task, n, sum(least(h, r)) / sum(h) AS p, sum(least(h, r)) / sum(r) AS q FROM c GROUP BY ALL),
a AS (SELECT task, avg(p) AS p, avg(q) AS q FROM o GROUP BY task)
SELECT task, round(100 * 5 * p * q / (4 * p + q), 6) AS chrf FROM a"""


@query("chrf", CHRF_SQL, ["turn_pairs"])
def chrf(spark, d):
    rows = V.turn_pairs(spark, d).withColumn("references", F.array("reference"))
    return rounded(C.corpus_metric(rows, ["task"], "chrf"))


@query("ter")
def ter(spark, d):
    return rounded(C.corpus_metric(spread(V.turn_pairs(spark, d), "doc_id"), ["task"], "ter"))


# --- contamination ---

WORDS = "[x for x in string_split(trim(regexp_replace(lower({0}), '[\\s\\x{{a0}}]+', ' ', 'g')), ' ') if x <> '']"


@query(
    "split_contamination",
    f"""WITH q AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), c AS (SELECT {WORDS.format('text')} AS w FROM documents),
qg AS (SELECT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM q)),
cg AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM c))
SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM qg JOIN cg USING (g)) THEN 'only_contamination' ELSE 'no_contamination' END AS subset FROM benchmark""",
)
def split_contamination(spark, d):
    q = contamination.decontamination_query(table(spark, d, "benchmark"), "text")
    return contamination.split_contamination(q, table(spark, d, "documents"), ["item_id"]).select("item_id", "subset")


@query(
    "decontamination_query",
    "SELECT conv_id, turn, role || ': ' || lower(text) AS query, text AS plain FROM conversations",
)
def decontamination_query(spark, d):
    t = table(spark, d, "conversations").withColumn("prompt", F.col("text"))
    t = contamination.decontamination_query(t, "concat(role, ': ', lower(text))")
    return contamination.decontamination_query(t, None, name="plain").select("conv_id", "turn", "query", "plain")
