"""Hand-worked cases of parsing, filters and scoring."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import filters as E
from tallyframe.functions import parsing as P
from tallyframe.functions import text_metrics as M
from tallyframe.operators import media
from tallyframe.operators import scoring as S


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("o")).collect()]


def test_clean_prediction(spark):
    cases = {
        "The answer is (B).": "B",
        "B. yes\nQuestion: …": "B. yes",
        "B</think>A": "B",
        "\x1b[31mC\x1b[0m": "C",
        "final answer: the red one\nmore": "the red one",
        "Option A, no: option B": "B",
        "    x  \n\n y": "x",
        "x\u0332": "x",
        "": "",
        None: "",
        "one\u2028two": "one",
        "a\n\n [STEP] b": "a",
    }
    assert column(spark, list(cases), P.clean_prediction) == list(cases.values())


def test_letter_index(spark):
    four = {
        "(C)": 2,
        "- B.": 1,
        "**D** because": 3,
        "answer = a": 0,
        "Bad": -1,
        "E": -1,
        "b": 1,
        "É": -1,
        None: -1,
        "“B” it is": 1,
    }
    assert column(spark, list(four), lambda c: P.letter_index(c, F.lit(4))) == list(four.values())
    assert column(spark, ["(C)", "A"], lambda c: P.letter_index(c, F.lit(2))) == [-1, 0]


def test_choice_text_index(spark):
    ch = F.array(F.lit("to the right"), F.lit("to the left"), F.lit("No."), F.lit("a.b (c)"))
    cases = {"left": 1, "It is to the right of it": 0, "no way": 2, "see a.b (c) here": 3, "axb (c)": -1, "": -1, "righ": -1}
    assert column(spark, list(cases), lambda c: P.choice_text_index(c, ch)) == list(cases.values())


def test_quoted_options_are_literal(spark):
    ch = F.array(F.lit("x\\Ey.z"))
    assert column(spark, ["is x\\Ey.z ok", "is xyz ok"], lambda c: P.choice_text_index(c, ch)) == [0, -1]


def test_time_and_point(spark):
    got = column(spark, ["<TIME 00:01:05.5 video 1>", "<time 01:00:00>", "TIME 1"], P.parse_time_token)
    assert got == [65.5, 3600.0, None]
    text = ["<TIME 00:00:12.3 video 1>; Point=(0.45, 0.62)", "xy: 0.1, .2 at 5 sec", "4 0.3 0.4", "<TIME bad> 1 2 3", "7"]
    got = [tuple(r) for r in column(spark, text, P.parse_time_point)]
    assert got[0] == (12.3, 0.45, 0.62)
    assert got[1] == (5.0, 0.1, 0.2)
    assert got[2] == (4.0, 0.3, 0.4)
    assert got[3] == (None, None, None)
    assert got[4] == (None, None, None)
    assert column(spark, ["7"], lambda c: P.parse_time_point(c, True)["time_sec"]) == [7.0]


def test_time_tokens(spark):
    vals = [65.5, 3661.25, 0.0, 59.95, 0.75]
    got = column(spark, vals, media.time_token, "double")
    assert got == [f"<TIME {int(v // 3600):02d}:{int(v % 3600 // 60):02d}:{v % 60:04.1f} video 1>" for v in vals]


def run_filter(spark, responses, *steps, **extra):
    df = spark.createDataFrame([(responses,)], "responses array<string>")
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return E.apply_filters(df, {"x": list(steps)}).first()["filtered"]


def test_filters(spark):
    assert run_filter(spark, ["b", "a", "a", "b"], "majority_vote") == ["b"]
    assert run_filter(spark, [], "take_first") == [""]
    assert run_filter(spark, ["x #### 1,200", "no"], "regex") == ["1,200", "[invalid]"]
    assert run_filter(spark, ["ab12 cd34"], ("regex", {"pattern": "([a-z]+)|([0-9]+)", "group_select": 1})) == ["12"]
    assert run_filter(spark, ["a1 b2"], ("regex", {"pattern": r"(?P<w>\w)\d", "group_select": -1})) == ["b"]
    assert run_filter(spark, ["aa bb"], ("regex_arrow", {"pattern": r"(?P<x>\w)(?P=x)"})) == ["a"]
    assert run_filter(spark, ["  a", "b"], "strip_leading_space") == [" a", "b"]
    assert run_filter(spark, ["a", "z"], ("map", {"mapping": {"a": "1"}, "default": "0"})) == ["1", "0"]
    assert run_filter(spark, ["É"], "lowercase", "uppercase") == ["É"]
    with pytest.raises(Exception, match="need at least 3"):
        run_filter(spark, ["a"], ("take_first_k", {"k": 3}))
    with pytest.raises(KeyError):
        run_filter(spark, ["a"], "unknown")


def test_choice_filters(spark):
    ch = F.array(F.lit("Red"), F.lit("blue"), F.lit("blue"))
    got = run_filter(spark, ["#### 7", "it is blue", "Red, blue", "x: B", "?"], "multi_choice_regex", choices=ch)
    assert got == ["7", "(C)", "(A)", "(B)", "[invalid]"]
    got = run_filter(spark, ["r-ed!"], ("multi_choice_regex", {"ignore_case": True, "ignore_punctuation": True}), choices=ch)
    assert got == ["(A)"]
    q = F.lit("Which?\nA. red\nB. dark blue")
    assert run_filter(spark, ["*dark blue*."], "simple_multi_choice", question=q) == ["B"]
    assert run_filter(spark, ["gr-een!"], "simple_multi_choice", question=q) == ["green"]
    assert run_filter(spark, ["gr-een!"], "simple_multi_choice", question=F.lit("none")) == ["green"]


def test_strip_reasoning(spark):
    tags = [("<think>", "</think>")]
    cases = {
        "<think>x</think>A": "A",
        "x</think>A": "A",
        "<think>a<think>b</think>c</think> d": "d",
        "<think>open": "<think>open",
        "a<think>x</think>b<think>y\n</think>c": "abc",
        "</think>x<think>": "</think>x<think>",
    }
    assert column(spark, list(cases), lambda c: E.strip_reasoning(c, tags)) == list(cases.values())
    assert E.reasoning_tags("none") is None
    assert E.reasoning_tags('[["a","b"]]', [["c", "d"]]) == [["c", "d"]]


def test_text_metrics(spark):
    df = spark.createDataFrame([("helo", ["hello", "x"]), ("abc", ["xyz"]), ("", [""])], "p string, r array<string>")
    assert [r[0] for r in df.select(M.anls(F.col("p"), F.col("r"))).collect()] == [0.8, 0.0, 1.0]
    df = spark.createDataFrame([("It's 5!", "its ")], "p string, r string")
    assert df.select(M.exact_match(F.col("p"), F.col("r"), None, True, True, True)).first()[0] == 1.0


META = (
    "struct<sampled_last_visible_time_sec:double,last_placement_time_sec:double,normalized_projected_pixel:array<double>,"
    "acceptable_answer_metadata:array<struct<time_sec:double,normalized_projected_pixel:array<double>,reference_source:string>>>"
)
SCHEMA = (
    "prediction string, step_question_class string, choices array<string>, answer_idx int, answer string, acceptable_answers array<string>, "
    f"acceptable_answer_idxs array<int>, answer_metadata {META}"
)


def score(spark, *row, **options):
    return S.score_answers(spark.createDataFrame([row], SCHEMA), **options).first()


def test_score_answers(spark):
    p = "<TIME 00:00:12.3 video 1>; Point=(0.45, 0.62)"
    r = score(spark, p, "oos_step2_last_visible", None, None, None, None, None, (12.0, None, [0.40, 0.60], None))
    assert (r.accuracy, r.parsed, r.scored_as) == (1.0, True, "time_point")
    assert abs(r.time_error_sec - 0.3) < 1e-9 and abs(r.coord_error_linf - 0.05) < 1e-9
    near = [(40.0, [0.4, 0.6], "far"), (12.5, [0.9, 0.6], "off"), (13.0, [0.45, 0.62], "near")]
    r = score(spark, p, "oos_step3_last_placement", None, None, None, None, None, (None, None, None, near))
    assert (r.accuracy, r.matched_gold_source) == (1.0, "near")
    r = score(spark, p, "oos_step3_last_placement", None, None, "later", None, None, (None, None, None, None))
    assert (r.scored_as, r.accuracy) == ("text", 0.0)
    r = score(spark, "12", "oos_step2_last_visible", None, None, None, None, None, (12.9, None, None, None), time_only=True)
    assert (r.accuracy, r.parsed) == (1.0, True)
    ab = ["yes", "no"]
    assert score(spark, "A", "c", ab, 0, None, [], [], None).accuracy == 1.0
    assert score(spark, "B", "c", ab, 0, None, [], [], None).accuracy == 0.0
    r = score(spark, "B", "c", ab, 0, None, [], [1], None)
    assert (r.accuracy, r.gold_choice, r.gold_idxs) == (1.0, "yes", [1])
    r = score(spark, "?", "c", ab, 0, None, [], [], None)
    assert (r.accuracy, r.parsed, r.pred_idx, r.pred_choice) == (0.0, False, -1, None)
    r = score(spark, " Red  cup ", "c", [], None, "", ["red cup"], [], None)
    assert (r.accuracy, r.scored_as) == (1.0, "text")
    r = score(spark, "x", "c", [], None, " ", [], [], None)
    assert (r.accuracy, r.scorable, r.parsed) == (None, False, True)


def test_multiple_choice_ties_and_bad_gold(spark):
    df = spark.createDataFrame(
        [([2.0, 1.0, 1.0], [False, True, False], ["a", "bb", "c"], [1]), ([1.0, 2.0, 3.0], [True, True, True], ["a", "b", "c"], [5])],
        "losses array<double>, greedy array<boolean>, choices array<string>, golds array<int>",
    )
    a, b = S.score_multiple_choice(df).collect()
    assert (a.pred, a.acc, a.acc_norm, a.exact_match) == (1, 1.0, 1.0, 1)
    assert (b.pred, b.acc, b.exact_match) == (0, 0.0, 0)
