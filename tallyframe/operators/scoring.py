"""Scoring of answered questions: one row per question, scored in the output stage of one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import clean_prediction, time_point_of, with_prediction_index
from ..functions.text import normalize, trim
from ..functions.text_metrics import anls, any_target, exact_match
from .aggregates import METRICS

# Question classes answered by a time and a point, and the tolerances.
TIME_POINT_GOLD = {
    "oos_step2_last_visible": "sampled_last_visible_time_sec",
    "oos_step3_last_placement": "last_placement_time_sec",
}
TIME_TOLERANCE_SEC = 1.0
COORD_TOLERANCE = 0.08

GOLD = "array<struct<time_sec:double,x:double,y:double,source:string>>"


def _gold_points(meta: Column, cls: Column, time_only: bool) -> Column:
    xy = "normalized_projected_pixel"

    def usable(p: Column) -> Column:
        return p["time_sec"].isNotNull() & (F.lit(time_only) | (F.coalesce(F.size(p[xy]), F.lit(0)) >= 2))

    def point(t: Column, p: Column | None, source: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            t.alias("time_sec"),
            (none if time_only else F.get(p, F.lit(0))).alias("x"),
            (none if time_only else F.get(p, F.lit(1))).alias("y"),
            source.alias("source"),
        )

    listed = F.transform(
        F.filter(F.coalesce(meta["acceptable_answer_metadata"], F.array()), usable),
        lambda p: point(p["time_sec"], p[xy], p["reference_source"]),
    )
    default_time = F.coalesce(*[F.when(cls == k, meta[v]) for k, v in TIME_POINT_GOLD.items()])
    default_ok = default_time.isNotNull() & (F.lit(time_only) | (F.coalesce(F.size(meta[xy]), F.lit(0)) >= 2))
    single = F.array(point(default_time, meta[xy], F.lit("default_single_gold")))
    return F.when(F.size(listed) > 0, listed).when(default_ok, single).cast(GOLD)


def _best_gold(golds: Column, guess: Column, time_tol: float, coord_tol: float, time_only: bool) -> Column:
    def judged(g: Column, pos: Column) -> Column:
        dt = F.abs(guess["time_sec"] - g["time_sec"])
        dx, dy = F.abs(guess["x"] - g["x"]), F.abs(guess["y"] - g["y"])
        dc = F.when(guess["time_sec"].isNotNull() & dx.isNotNull() & dy.isNotNull(), F.greatest(dx, dy))
        if time_only:
            dc = F.lit(None).cast("double")
        time_ok = F.coalesce(dt <= time_tol, F.lit(False))
        coord_ok = F.lit(True) if time_only else F.coalesce(dc <= coord_tol, F.lit(False))
        far = F.lit(float("inf"))
        err = F.coalesce(dt, far) + F.coalesce(dc, far)
        return F.struct(
            F.when(time_ok & coord_ok, F.lit(-1.0)).otherwise(F.lit(0.0)).alias("miss"),
            err.alias("err"),
            pos.alias("pos"),
            dt.alias("time_error_sec"),
            dc.alias("coord_error_linf"),
            time_ok.alias("time_ok"),
            coord_ok.alias("coord_ok"),
            g.alias("gold"),
        )

    return F.array_min(F.transform(golds, judged))


def score_answers(
    df: DataFrame,
    prediction: str = "prediction",
    time_tol: float = TIME_TOLERANCE_SEC,
    coord_tol: float = COORD_TOLERANCE,
    time_only: bool = False,
) -> DataFrame:
    """Adds prediction, choice, gold, accuracy, parsed and scorable columns to questions with an answer.

    A time-and-point question with numeric gold is judged by distance; else options by index; else text by equality;
    without usable gold accuracy stays null and scorable is false.
    """
    cls = F.lower(trim(F.coalesce(F.col("step_question_class"), F.lit(""))))
    has_choices = F.coalesce(F.size("choices"), F.lit(0)) > 0
    pred = F.col(prediction)
    df = df.withColumn("clean_prediction", clean_prediction(pred))
    df = with_prediction_index(df, prediction, "choices", "_idx")
    df = df.withColumn(
        "_golds",
        F.when(~has_choices & cls.isin(*TIME_POINT_GOLD), _gold_points(F.col("answer_metadata"), cls, time_only)),
    )
    df = df.withColumn("_guess", F.when(F.col("_golds").isNotNull(), time_point_of(F.col("clean_prediction"), time_only)))
    df = df.withColumn("_best", _best_gold(F.col("_golds"), F.col("_guess"), time_tol, coord_tol, time_only))
    own = F.filter(F.array("answer"), lambda x: x.isNotNull() & (x != ""))
    texts = F.filter(
        F.concat(own, F.coalesce("acceptable_answers", F.array().cast("array<string>"))),
        lambda x: x.isNotNull() & (normalize(x) != ""),
    )
    # distance-scored rows need neither
    by_text = F.col("_golds").isNull()
    df = df.withColumn("_texts", F.when(by_text, texts)).withColumn(
        "_norm", F.when(by_text, normalize(F.col("clean_prediction")))
    )
    df = df.withColumn(
        "scored_as",
        F.when(F.col("_golds").isNotNull(), "time_point")
        .when(has_choices & F.col("answer_idx").isNotNull(), "choice")
        .when(F.size("_texts") > 0, "text")
        .otherwise("none"),
    )
    kind = F.col("scored_as")
    listed = F.coalesce(F.size("acceptable_answer_idxs"), F.lit(0)) > 0
    gold_idxs = F.when(listed, F.col("acceptable_answer_idxs")).otherwise(F.array("answer_idx"))
    guess, best = F.col("_guess"), F.col("_best")
    whole = guess["time_sec"].isNotNull()
    if not time_only:
        whole = whole & guess["x"].isNotNull() & guess["y"].isNotNull()
    is_choice = kind == "choice"
    out = {
        "pred_idx": F.when(is_choice, F.col("_idx")),
        "pred_choice": F.when(is_choice & (F.col("_idx") >= 0), F.get("choices", F.col("_idx"))),
        "gold_idx": F.when(is_choice, F.col("answer_idx")),
        "gold_choice": F.when(is_choice & (F.col("answer_idx") >= 0), F.get("choices", F.col("answer_idx"))).when(
            kind == "text", F.get("_texts", F.lit(0))
        ),
        "gold_idxs": F.when(is_choice, gold_idxs),
        "accuracy": F.when(kind == "time_point", -best["miss"])
        .when(is_choice, F.array_contains(gold_idxs, F.col("_idx")).cast("double"))
        .when(
            kind == "text",
            F.array_contains(F.transform("_texts", normalize), F.col("_norm")).cast("double"),
        ),
        "parsed": F.when(kind == "time_point", whole)
        .when(is_choice, F.col("_idx") != -1)
        .otherwise(F.col("_norm") != ""),
        "scorable": kind != "none",
        "pred_time_sec": guess["time_sec"],
        "pred_point_x": guess["x"],
        "pred_point_y": guess["y"],
        "matched_gold_time_sec": best["gold"]["time_sec"],
        "matched_gold_source": best["gold"]["source"],
        "time_error_sec": best["time_error_sec"],
        "coord_error_linf": best["coord_error_linf"],
        "time_within_tolerance": F.when(kind == "time_point", best["time_ok"]),
        "coord_within_tolerance": F.when(kind == "time_point", best["coord_ok"]),
    }
    return df.withColumns(out).drop("_idx", "_golds", "_guess", "_best", "_texts", "_norm")


def score_responses(questions: DataFrame, responses: DataFrame, **options) -> DataFrame:
    """Questions joined to their responses on (task, doc_id), scored.

    Several responses per question (repeats) are kept apart by their own columns. A question with very many responses
    is split by the runtime skew join: nothing after the join needs its rows together.
    """
    keys = [k for k in ("task", "doc_id") if k in questions.columns and k in responses.columns]
    return score_answers(responses.join(questions, keys), **options)


def score_loglikelihood(df: DataFrame, ll: str = "ll", is_greedy: str = "is_greedy") -> DataFrame:
    return df.withColumn("perplexity", F.col(ll)).withColumn("acc", F.col(is_greedy).cast("int"))


def gold_index(gold: Column, choices: Column) -> Column:
    """Index of a gold given as option text; -100 when it is not an option."""
    return F.coalesce(F.nullif(F.array_position(choices, gold), F.lit(0)).cast("int") - 1, F.lit(-100))


def _arg_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def score_multiple_choice(
    df: DataFrame, losses: str = "losses", greedy: str = "greedy", golds: str = "golds", unconditional: str | None = None
) -> DataFrame:
    """Array form, one row per question: losses, greedy flags, choices and the list of gold indexes.

    The smallest loss wins, ties to the lower index. A gold outside the options makes the answer wrong. With
    unconditional losses the largest difference wins.
    """
    n = F.size("choices")
    valid = F.transform(golds, lambda g: F.when((g < n) & (g >= 0), g).otherwise(F.lit(-100)))
    per_char = F.zip_with(losses, "choices", lambda v, c: v / F.nullif(F.length(c), F.lit(0)).cast("double"))
    pred, pred_norm = _arg_min(F.col(losses)), _arg_min(per_char)
    out = {
        "pred": pred,
        "acc": F.array_contains(valid, pred).cast("double"),
        "acc_norm": F.coalesce(F.array_contains(valid, pred_norm).cast("double"), F.lit(0.0)),
        "exact_match": F.exists(valid, lambda g: F.when(g >= 0, F.get(F.col(greedy), g)).otherwise(F.lit(False))).cast(
            "int"
        ),
    }
    if unconditional:
        gain = F.zip_with(losses, unconditional, lambda a, b: a - b)
        best = F.array_position(gain, F.array_max(gain)).cast("int") - 1
        out["acc_mutual_info"] = F.array_contains(valid, best).cast("double")
    return df.withColumns(out)


def score_multiple_choice_rows(rows: DataFrame, keys: list[str], idx: str = "idx", loss: str = "ll") -> DataFrame:
    """Long form, one row per choice: needs `choice`, `is_greedy`, `gold`. Aggregates only, so copies cost nothing."""
    per_char = F.col(loss) / F.nullif(F.length("choice"), F.lit(0)).cast("double")
    return (
        rows.groupBy(*keys)
        .agg(
            F.min_by(idx, F.struct(loss, idx)).alias("pred"),
            F.min_by(F.when(per_char.isNotNull(), F.col(idx)), F.struct(per_char, F.col(idx))).alias("pred_norm"),
            F.max("gold").alias("gold"),
            F.max(F.when(F.col(idx) == F.col("gold"), F.col("is_greedy").cast("int"))).alias("_greedy"),
        )
        .withColumn("acc", (F.col("pred") == F.col("gold")).cast("double"))
        .withColumn("acc_norm", (F.col("pred_norm") == F.col("gold")).cast("double"))
        .withColumn("exact_match", F.coalesce("_greedy", F.lit(0)))
        .drop("_greedy")
    )


def score_choice_requests(
    requests: DataFrame, responses: DataFrame, golds: DataFrame, keys: list[str], several_contexts: bool = False, target_delimiter: str = " "
) -> DataFrame:
    """One row per question from its likelihood requests, their responses (keys, idx, ll, is_greedy) and golds (keys, gold).

    A choice is the continuation without its delimiter, or with several contexts the context. gold is an index, or the
    text of a choice; a text that is none of the choices, or an index beyond them, makes the answer wrong.
    """
    choice = F.col("context") if several_contexts else F.substring("continuation", len(target_delimiter) + 1, 1 << 30)
    asked = requests.where((F.col("repeat") == 0) & (F.lit(True) if several_contexts else F.col("context") != ""))
    asked = asked.select(*keys, "idx", choice.alias("choice"))
    rows = asked.join(responses.select(*keys, "idx", "ll", "is_greedy"), [*keys, "idx"]).join(golds.select(*keys, "gold"), keys)
    if isinstance(golds.schema["gold"].dataType, T.StringType):
        # the place of the first choice with the gold's text, known only when all of a question's choices are together
        named = rows.groupBy(*keys).agg(F.min(F.when(F.col("choice") == F.col("gold"), F.col("idx"))).alias("_at"))
        rows = rows.join(named, keys).withColumn("gold", F.coalesce("_at", F.lit(-100))).drop("_at")
    return score_multiple_choice_rows(rows, keys)


def metric_function(name: str):
    """fn(pred, target), or (fn(pred, targets), "whole") for metrics that take all targets at once."""
    known = {"exact_match": exact_match, "anls": (anls, "whole")}
    fn = METRICS.get(name, {}).get("fn") or known.get(name)
    if fn is None:
        raise KeyError(f"metric {name!r} has no scoring function")
    return fn


def score_generation(
    df: DataFrame, metrics: dict | list[str], pred: str = "response", targets: str = "targets", choices: str | None = None
) -> DataFrame:
    """Each metric against the targets: 1.0 if any scores non-zero; a metric marked "whole" gets the whole list.

    metrics: registered names, or name -> fn(pred, target) or (fn(pred, targets), "whole"). With choices, targets are
    positions in that column's options, counted from 0; positions outside it are no targets.
    """
    if not isinstance(metrics, dict):
        metrics = {m: metric_function(m) for m in metrics}
    p, t = trim(F.col(pred)), F.col(targets)
    if choices is not None:
        inside = F.filter(t, lambda g: (g >= 0) & (g < F.size(choices)))
        t = F.transform(inside, lambda g: F.get(F.col(choices), g.cast("int")))
    cols = {}
    for name, fn in metrics.items():
        if isinstance(fn, tuple):
            cols[name] = fn[0](p, t)
        else:
            cols[name] = F.when(F.size(t) == 1, fn(p, F.get(t, F.lit(0)))).otherwise(any_target(fn, p, t))
    return df.withColumns(cols)


def strip_results(c: Column) -> Column:
    return F.transform(c, trim)


def strip_nested_results(c: Column) -> Column:
    """For array<array<string>>: only the first list counts."""
    return F.transform(F.coalesce(F.get(c, F.lit(0)), F.array().cast("array<string>")), trim)
