"""Reports over scored questions: totals, classes, videos, steps and trajectories, as long (metric, key, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import loosely

STEP_PATTERN = r"^(\d+)([A-Za-z]*)$"
NO_NUMBER = 10**9
#: Names of the trajectory results, in order.
TRAJECTORY_RESULTS = [
    "trajectory_count",
    "trajectory_success_rate",
    "completed_without_error_rate",
    "avg_first_mistake_step",
    "median_first_mistake_step",
    "error_propagation_rate",
    "post_error_failure_rate",
]


def step_sort_key(step: Column) -> Column:
    """struct(num, suffix): steps like 3 or 3b by number, then suffix; all others last."""
    s = F.trim(step)
    # plain numbers, by far the most, need no pattern
    plain = (s != "") & (F.translate(s, "0123456789", "") == "")
    num = F.when(plain, s.try_cast("bigint")).otherwise(F.regexp_extract(s, STEP_PATTERN, 1).try_cast("bigint"))
    tail = F.when(plain, "").otherwise(F.regexp_extract(s, STEP_PATTERN, 2))
    return F.struct(
        F.coalesce(num, F.lit(NO_NUMBER)).alias("num"), F.when(num.isNotNull(), tail).otherwise(s).alias("suffix")
    )


def _known(c: str) -> Column:
    """NaN is not a score."""
    return F.when(~F.isnan(F.col(c)), F.col(c))


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.explode(rows).alias("r")).select("r.metric", F.lit(None).cast("string").alias("key"), "r.value")


def _with_blank(df: DataFrame, zeros: list[str]) -> DataFrame:
    """df and one more row: 0 in the given columns, null elsewhere."""
    cols = [F.lit(0 if f.name in zeros else None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.unionByName(df.sparkSession.range(1).select(*cols))


def accuracy_report(scored: DataFrame) -> DataFrame:
    """Counts, parse rate (over all rows), per-class means, their mean, the overall mean and the mean over videos.

    One flow: rows to (class, video) totals, grouping sets over those for classes, videos and the whole, and once more
    for the means over classes and over videos.
    """
    scorable = F.coalesce("scorable", F.lit(False))
    acc = F.when(scorable, _known("accuracy"))
    cell = scored.groupBy("question_class", "source_video_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(scorable).alias("scorable"),
        F.count_if(F.coalesce("parsed", F.lit(False))).alias("parsed"),
        F.sum(acc).alias("total"),
        F.count(acc).alias("n"),
    )
    counts = ["rows", "scorable", "parsed"]
    # grouping sets of no rows give not even the total, hence one row without class, video or content
    groups = _with_blank(cell, counts).groupingSets([[], ["question_class"], ["source_video_id"]], "question_class", "source_video_id").agg(
        F.grouping_id().alias("_g"),
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
    )
    g = F.col("_g")
    named = F.when(g == 1, F.col("question_class")).when(g == 2, F.col("source_video_id"))
    level = F.when(g == 3, "all").when(g == 1, "class").otherwise("video")
    # a null class or video is no group; classes count only when something in them can be scored
    kept = groups.where((g == 3) | (named.isNotNull() & ((g == 2) | (F.col("scorable") > 0))))
    means = (
        kept.select(level.alias("level"), named.alias("key"), "mean", *counts)
        .groupingSets([["level"], ["level", "key"]], "level", "key")
        .agg(F.grouping("key").alias("whole"), F.avg("mean").alias("mean"), *[F.max(c).alias(c) for c in counts])
    )
    whole, zero = F.col("whole") == 1, F.lit(0.0)
    mean = F.col("mean")

    def rows(*named_values) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in named_values])

    n = F.col("rows")
    total = rows(
        ("total_count", n),
        ("scorable_count", F.col("scorable")),
        ("unscorable_count", n - F.col("scorable")),
        ("parse_rate", F.coalesce(F.try_divide(F.col("parsed"), n), zero)),
        ("micro_avg", F.coalesce(mean, zero)),
    )
    nothing = F.col("scorable") == 0
    empty = rows(("macro_avg", zero), ("overall", zero))
    out = (
        F.when((F.col("level") == "all") & whole, F.when(nothing, F.concat(total, empty)).otherwise(total))
        .when((F.col("level") == "class") & whole, rows(("macro_avg", F.coalesce(mean, zero)), ("overall", F.coalesce(mean, zero))))
        .when((F.col("level") == "video") & whole & mean.isNotNull(), rows(("video_macro_avg", mean)))
        .when((F.col("level") == "class") & ~whole, rows(("class_accuracy", mean)))
    )
    return means.select("key", F.explode(out).alias("r")).select("r.metric", "key", "r.value")


def _multi_turn(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("mode") == "multi_turn") & F.coalesce("scorable", F.lit(False)) & F.col("step").isNotNull())


def _nothing(scored: DataFrame) -> Column:
    """Whether no row can be scored, as a scalar."""
    return scored.where(F.coalesce("scorable", F.lit(False))).agg(F.count(F.lit(1)) == 0).scalar()


def step_means(scored: DataFrame) -> DataFrame:
    """(step, step_num, step_suffix, accuracy, rows); order by step_num, step_suffix."""
    per = _multi_turn(scored).groupBy("step").agg(
        F.avg(_known("accuracy")).alias("accuracy"), F.count(F.lit(1)).alias("rows")
    )
    key = step_sort_key(F.col("step"))
    return per.select("step", key["num"].alias("step_num"), key["suffix"].alias("step_suffix"), "accuracy", "rows")


def step_report(scored: DataFrame) -> DataFrame:
    """Step means, their mean and the number of rows, in one flow; zeros only if nothing at all can be scored."""
    both = _with_blank(step_means(scored), ["rows"]).groupingSets([[], ["step"]], "step").agg(
        F.grouping("step").alias("whole"), F.avg("accuracy").alias("mean"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")
    )
    row = lambda n, v: F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"))
    total = F.array(row("step_macro_avg", F.coalesce("mean", F.lit(0.0))), row("multi_turn_step_count", F.col("n")))
    out = F.when(F.col("whole") == 1, total).otherwise(F.array(row("step_accuracy", F.col("mean"))))
    both = both.where((F.col("step").isNotNull()) | ((F.col("whole") == 1) & ((F.col("n") > 0) | _nothing(scored))))
    return both.select(F.col("step").alias("key"), F.explode(out).alias("r")).select("r.metric", "key", "r.value")


def trajectory_rows(scored: DataFrame, tie: str = "id") -> DataFrame:
    """One row per trajectory: rows, wrong, first_wrong_step, later (steps after it), later_wrong.

    The first wrong position and the number of wrong rows are aggregated per trajectory, then every row is compared with
    them; no task ever sorts a whole trajectory. All rows before the first wrong one are right, and all other wrong ones lie
    after it. Equal steps are ordered by `tie`, and where that is equal too the wrong one counts as first.
    """
    key = step_sort_key(F.col("step"))
    rows = _multi_turn(scored).where(F.col("trajectory_id").isNotNull())
    rows = rows.select(
        "trajectory_id",
        F.struct(key["num"].alias("num"), key["suffix"].alias("suffix"), F.col(tie).alias("tie")).alias("pos"),
        "step",
        F.coalesce(F.col("accuracy") != 1.0, F.lit(True)).alias("bad"),
    )
    wrong = F.count(F.lit(1)).alias("wrong")
    first = loosely(rows.where("bad"), ["trajectory_id"], F.min(F.struct("pos", "step")).alias("first"), wrong)
    first = first.select("trajectory_id", F.col("first.pos").alias("first_pos"), F.col("first.step").alias("first_wrong_step"), "wrong")
    # step and count are the same in all rows of a trajectory: as keys beside counts they are hashed, as aggregates sorted
    per = loosely(
        rows.select("trajectory_id", "pos").join(first, "trajectory_id", "left"),
        ["trajectory_id", "first_wrong_step", "wrong"],
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("pos") < F.col("first_pos")).alias("before"),
    ).withColumn("wrong", F.coalesce("wrong", F.lit(0).cast("long")))
    some = F.col("wrong") > 0
    return per.select(
        "trajectory_id",
        "rows",
        "wrong",
        "first_wrong_step",
        F.when(some, F.col("rows") - F.col("before") - 1).alias("later"),
        F.when(some, F.col("wrong") - 1).alias("later_wrong"),
    )


def trajectory_report(scored: DataFrame, tie: str = "id") -> DataFrame:
    """Success, first mistakes, propagation and later failures over trajectories; 0.0 where undefined."""
    return _trajectory_results(scored, tie, _nothing(scored))


def _trajectory_results(scored: DataFrame, tie: str, zeros: Column) -> DataFrame:
    per = trajectory_rows(scored, tie).withColumn(
        "first_num", F.regexp_extract("first_wrong_step", r"^(\d+)", 1).try_cast("bigint")
    )
    has_later = F.col("later") > 0
    # trajectories that share all of these are counted once before the final, single-group aggregate
    cell = per.groupBy("first_num").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("wrong") == 0).alias("clean"),
        F.count_if(has_later).alias("with_later"),
        F.count_if(has_later & (F.col("later_wrong") > 0)).alias("spread"),
        F.sum(F.when(has_later, F.col("later_wrong") / F.col("later"))).alias("rate_sum"),
    )
    num = F.col("first_num").cast("double")
    known = F.when(F.col("first_num").isNotNull(), F.col("n"))
    zero = F.lit(0.0)
    out = cell.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("trajectory_count"),
        F.coalesce(F.try_divide(F.sum("clean"), F.sum("n")), zero).alias("trajectory_success_rate"),
        F.coalesce(F.try_divide(F.sum(num * known), F.sum(known)), zero).alias("avg_first_mistake_step"),
        F.coalesce(F.percentile(num, 0.5, F.coalesce(known, F.lit(0))), zero).alias("median_first_mistake_step"),
        F.coalesce(F.try_divide(F.sum("spread"), F.sum("with_later")), zero).alias("error_propagation_rate"),
        F.coalesce(F.try_divide(F.sum("rate_sum"), F.sum("with_later")), zero).alias("post_error_failure_rate"),
    ).withColumn("completed_without_error_rate", F.col("trajectory_success_rate"))
    return _long(out.where((F.col("trajectory_count") > 0) | zeros), TRAJECTORY_RESULTS)


def _class_video_and_step_results(scored: DataFrame) -> DataFrame:
    """accuracy_report and step_report in one flow over the rows.

    Every row counts for its cell of class and video and, with several turns, for its step; cells count for the whole, their
    class, their video and their step; these for the means over classes, videos and steps. Where nothing can be scored
    there are no steps and trajectories either, so the row of the whole also gives their zeros.
    """
    scorable = F.coalesce("scorable", F.lit(False))
    text = lambda c: F.col(c).cast("string")
    cell = lambda tag, a, b: F.struct(F.lit(tag).alias("tag"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    several = (F.col("mode") == "multi_turn") & scorable & F.col("step").isNotNull()
    places = F.array_compact(F.array(cell("class", text("question_class"), text("source_video_id")), F.when(several, cell("step", text("step"), none))))
    rows = scored.select(scorable.alias("scorable"), F.coalesce("parsed", F.lit(False)).alias("parsed"), F.when(scorable, _known("accuracy")).alias("acc"), F.explode(places).alias("p"))
    cells = rows.groupBy("p.tag", "p.a", "p.b").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("scorable").alias("scorable"),
        F.count_if("parsed").alias("parsed"),
        F.sum("acc").alias("total"),
        F.count("acc").alias("n"),
    )
    counts = ["rows", "scorable", "parsed"]
    blank = scored.sparkSession.range(1).select(F.lit("class").alias("tag"), none.alias("a"), none.alias("b"), *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(None).cast("double").alias("total"), F.lit(0).cast("long").alias("n"))
    at = lambda level, key: F.struct(F.lit(level).alias("level"), key.alias("key"))
    a, b = F.col("a"), F.col("b")
    of_class = F.array_compact(F.array(at("all", none), F.when(a.isNotNull(), at("class", a)), F.when(b.isNotNull(), at("video", b))))
    levels = F.when(F.col("tag") == "class", of_class).otherwise(F.array(at("steps", none), at("step", a)))
    groups = cells.unionByName(blank).select(F.explode(levels).alias("g"), *counts, "total", "n").groupBy("g.level", "g.key").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), *[F.sum(c).alias(c) for c in counts]
    )
    # classes count only when something in them can be scored
    groups = groups.where((F.col("level") != "class") | (F.col("scorable") > 0))
    level = F.col("level")
    upper = F.when(level.isin("class", "video", "step"), F.array(at("", F.col("key")), F.struct(F.lit("mean").alias("level"), none.alias("key")))).otherwise(F.array(at("", none)))
    means = groups.select(level, F.explode(upper).alias("u"), "mean", *counts).groupBy("level", F.col("u.level").alias("over"), F.col("u.key").alias("key")).agg(
        F.avg("mean").alias("mean"), *[F.max(c).alias(c) for c in counts]
    )
    n, zero, mean = F.col("rows"), F.lit(0.0), F.col("mean")

    def named(*values) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values])

    total = named(
        ("total_count", n),
        ("scorable_count", F.col("scorable")),
        ("unscorable_count", n - F.col("scorable")),
        ("parse_rate", F.coalesce(F.try_divide(F.col("parsed"), n), zero)),
        ("micro_avg", F.coalesce(mean, zero)),
    )
    empty = named(*[(k, zero) for k in ["macro_avg", "overall", "step_macro_avg", "multi_turn_step_count", *TRAJECTORY_RESULTS]])
    single = F.col("over") == ""
    known = F.coalesce(mean, zero)
    out = (
        F.when(level == "all", F.when(F.col("scorable") == 0, F.concat(total, empty)).otherwise(total))
        .when(level == "steps", named(("multi_turn_step_count", n)))
        .when((level == "class") & single, named(("class_accuracy", mean)))
        .when(level == "class", named(("macro_avg", known), ("overall", known)))
        .when((level == "video") & ~single & mean.isNotNull(), named(("video_macro_avg", mean)))
        .when((level == "step") & single, named(("step_accuracy", mean)))
        .when((level == "step"), named(("step_macro_avg", known)))
    )
    return means.select("key", F.explode(out).alias("r")).select("r.metric", "key", "r.value")


def score_report(scored: DataFrame, tie: str = "id") -> DataFrame:
    """The whole report of a run: the rows are read once for classes, videos and steps and twice for trajectories."""
    return _class_video_and_step_results(scored).unionByName(_trajectory_results(scored, tie, F.lit(False)))
