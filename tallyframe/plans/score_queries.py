"""Queries over score tables: reports, aggregations, statistics, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import reports as R
from ..operators import result_tables as K
from ..operators import statistics as H
from ..operators import telemetry as I
from . import fixtures as V
from .catalog import query, rounded, spread, table, with_views

TRAJECTORY = """
, t AS (SELECT trajectory_id, step, COALESCE(accuracy = 1.0, FALSE) AS ok, row_number() OVER (PARTITION BY trajectory_id ORDER BY {order}) AS rn
  FROM {view} {where}),
f AS (SELECT trajectory_id, count(*) AS n, min(rn) FILTER (WHERE NOT ok) AS fw FROM t GROUP BY 1),
p AS (SELECT f.trajectory_id, fw, count(*) FILTER (WHERE rn > fw) AS later, count(*) FILTER (WHERE rn > fw AND NOT ok) AS bad,
  max(CASE WHEN rn = fw THEN TRY_CAST(regexp_extract(step, '^[0-9]+') AS DOUBLE) END) AS num FROM f JOIN t USING (trajectory_id) GROUP BY f.trajectory_id, fw),
g AS (SELECT CAST(count(*) AS DOUBLE) AS c, avg(CAST(fw IS NULL AS DOUBLE)) AS s, avg(num) AS m, median(num) AS md,
  avg(CAST(bad > 0 AS DOUBLE)) FILTER (WHERE later > 0) AS pr, avg(bad / later) FILTER (WHERE later > 0) AS pf FROM p)"""
TRAJECTORY_ROWS = """
SELECT 'trajectory_count' AS metric, CAST(NULL AS VARCHAR) AS key, c AS value FROM g
UNION ALL SELECT 'trajectory_success_rate', NULL, round(s, 6) FROM g
UNION ALL SELECT 'completed_without_error_rate', NULL, round(s, 6) FROM g
UNION ALL SELECT 'avg_first_mistake_step', NULL, round(COALESCE(m, 0), 6) FROM g
UNION ALL SELECT 'median_first_mistake_step', NULL, round(COALESCE(md, 0), 6) FROM g
UNION ALL SELECT 'error_propagation_rate', NULL, round(COALESCE(pr, 0), 6) FROM g
UNION ALL SELECT 'post_error_failure_rate', NULL, round(COALESCE(pf, 0), 6) FROM g"""
STEP_ROWS = """
SELECT 'step_accuracy' AS metric, step AS key, round(avg(accuracy), 6) AS value FROM {view} WHERE mode = 'multi_turn' AND scorable GROUP BY step
UNION ALL SELECT 'step_macro_avg', NULL, round(avg(a), 6) FROM (SELECT avg(accuracy) AS a FROM {view} WHERE mode = 'multi_turn' AND scorable GROUP BY step)
UNION ALL SELECT 'multi_turn_step_count', NULL, CAST(count(*) AS DOUBLE) FROM {view} WHERE mode = 'multi_turn' AND scorable"""
ACCURACY_ROWS = """
SELECT 'total_count' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM {view}
UNION ALL SELECT 'scorable_count', NULL, CAST(count(*) AS DOUBLE) FROM {view} WHERE scorable
UNION ALL SELECT 'unscorable_count', NULL, CAST(count(*) AS DOUBLE) FROM {view} WHERE NOT scorable
UNION ALL SELECT 'parse_rate', NULL, round(avg(CAST(COALESCE(parsed, FALSE) AS DOUBLE)), 6) FROM {view}
UNION ALL SELECT 'micro_avg', NULL, round(avg(accuracy), 6) FROM {view} WHERE scorable
UNION ALL SELECT m, NULL, round(avg(a), 6) FROM (SELECT avg(accuracy) AS a FROM {view} WHERE scorable AND question_class IS NOT NULL GROUP BY question_class), (VALUES ('macro_avg'), ('overall')) x(m) GROUP BY m
UNION ALL SELECT 'video_macro_avg', NULL, round(avg(a), 6) FROM (SELECT avg(accuracy) AS a FROM {view} WHERE scorable AND source_video_id IS NOT NULL GROUP BY source_video_id)
UNION ALL SELECT 'class_accuracy', question_class, round(avg(accuracy), 6) FROM {view} WHERE scorable AND question_class IS NOT NULL GROUP BY question_class"""
MIXED_ORDER = (
    "CASE WHEN regexp_matches(step, '^[0-9]+[A-Za-z]*$') THEN CAST(regexp_extract(step, '^[0-9]+') AS BIGINT) ELSE 1000000000 END, "
    "CASE WHEN regexp_matches(step, '^[0-9]+[A-Za-z]*$') THEN regexp_extract(step, '[A-Za-z]*$') ELSE step END"
)


@query(
    "score_report",
    TRAJECTORY.format(view="scored_steps", where="", order="turn")
    + ACCURACY_ROWS.format(view="scored_steps") + " UNION ALL " + STEP_ROWS.format(view="scored_steps")
    + " UNION ALL " + TRAJECTORY_ROWS,
    ["scored_steps"],
)
def score_report(spark, d):
    return rounded(R.score_report(V.scored_steps(spark, d)))


@query("accuracy_report", ACCURACY_ROWS.format(view="mixed_steps"), ["scored_steps", "mixed_steps"])
def accuracy_report(spark, d):
    return rounded(R.accuracy_report(V.mixed_steps(spark, d)))


@query("step_report", STEP_ROWS.format(view="mixed_steps"), ["scored_steps", "mixed_steps"])
def step_report(spark, d):
    return rounded(R.step_report(V.mixed_steps(spark, d)))


@query(
    "trajectory_report",
    TRAJECTORY.format(view="mixed_steps", where="WHERE mode = 'multi_turn' AND scorable", order=MIXED_ORDER) + TRAJECTORY_ROWS,
    ["scored_steps", "mixed_steps"],
)
def trajectory_report(spark, d):
    return rounded(R.trajectory_report(V.mixed_steps(spark, d)))


@query("trajectory_report_lines", TRAJECTORY.format(view="line_steps", where="", order="turn, tie") + TRAJECTORY_ROWS, ["line_steps"])
def trajectory_report_lines(spark, d):
    return rounded(R.trajectory_report(V.line_steps(spark, d)))


# --- aggregations ---


@query("mean", "SELECT task, avg(score) AS mean FROM scores GROUP BY task", ["scores"])
def mean(spark, d):
    return A.by_key(V.scores(spark, d), ["task"], mean=A.mean("score"))


@query(
    "median",
    "SELECT task, n_chars AS median FROM (SELECT task, n_chars, row_number() OVER (PARTITION BY task ORDER BY n_chars) AS r, "
    "count(*) OVER (PARTITION BY task) AS n FROM scores) WHERE r = n // 2 + 1",
    ["scores"],
)
def median(spark, d):
    return A.median(V.scores(spark, d), ["task"], "n_chars")


@query(
    "middle_row",
    "SELECT task, n_chars AS median FROM (SELECT task, n_chars, row_number() OVER (PARTITION BY task ORDER BY doc_id) AS r, "
    "count(*) OVER (PARTITION BY task) AS n FROM scores) WHERE r = n // 2 + 1",
    ["scores"],
)
def middle_row(spark, d):
    return A.middle_row(V.scores(spark, d), ["task"], "doc_id", "n_chars")


@query("perplexity", "SELECT task, round(exp(-avg(value)), 6) AS perplexity FROM scores GROUP BY task", ["scores"])
def perplexity(spark, d):
    return rounded(A.by_key(V.scores(spark, d), ["task"], perplexity=A.perplexity()))


@query(
    "weighted_perplexity",
    "SELECT task, round(exp(-sum(value) / sum(weight)), 6) AS word_perplexity FROM scores GROUP BY task",
    ["scores"],
)
def weighted_perplexity(spark, d):
    return rounded(A.by_key(V.scores(spark, d), ["task"], word_perplexity=A.weighted_perplexity()))


@query(
    "bits_per_byte",
    "SELECT lang, round(sum(n_chars % 97) / sum(CAST(strlen(text) AS DOUBLE)) / ln(2), 6) AS bits_per_byte, "
    "CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang",
)
def bits_per_byte(spark, d):
    rows = table(spark, d, "documents").select(
        "lang", (-(F.col("n_chars") % 97)).cast("double").alias("value"), A.count_bytes(F.col("text")).alias("weight")
    )
    return rounded(A.by_key(rows, ["lang"], bits_per_byte=A.bits_per_byte(), bytes=F.sum("weight")))


@query(
    "f1",
    "SELECT task, round(2.0 * count(*) FILTER (WHERE gold = 1 AND pred = 1) / (2 * count(*) FILTER (WHERE gold = 1 AND pred = 1) "
    "+ count(*) FILTER (WHERE (gold = 1) <> (pred = 1))), 6) AS f1 FROM scores GROUP BY task",
    ["scores"],
)
def f1(spark, d):
    return rounded(A.by_key(V.scores(spark, d), ["task"], f1=A.f1()))


@query(
    "mcc",
    """, k AS (SELECT task, gold AS cls, count(*) AS t, 0 AS p FROM scores GROUP BY 1, 2 UNION ALL SELECT task, pred, 0, count(*) FROM scores GROUP BY 1, 2),
c AS (SELECT task, cls, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS p FROM k GROUP BY 1, 2),
a AS (SELECT task, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM c GROUP BY 1),
s AS (SELECT task, CAST(count(*) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE gold = pred) AS DOUBLE) AS ok FROM scores GROUP BY 1)
SELECT task, round(COALESCE((ok * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0), 6) AS mcc FROM a JOIN s USING (task)""",
    ["scores"],
)
def mcc(spark, d):
    return rounded(A.mcc(V.scores(spark, d), ["task"]))


@query(
    "brier",
    """, p AS (SELECT vec_id, gold, [abs(CAST(x AS DOUBLE)) for x in l] AS a FROM losses)
SELECT gold AS gold_class, round(avg(list_sum([pow(a[i] - CASE WHEN i - 1 = gold THEN 1 ELSE 0 END, 2) for i in range(1, len(a) + 1)])), 6) AS brier FROM p GROUP BY gold""",
    ["losses"],
)
def brier(spark, d):
    rows = V.losses(spark, d).withColumn("probs", F.transform("losses", F.abs)).withColumn("gold_class", F.col("gold"))
    return rounded(A.by_key(rows, ["gold_class"], brier=A.brier()))


@query(
    "acc_all",
    "SELECT event_type, avg(a) AS acc_all FROM (SELECT event_type, user_id, CAST(bool_and(value > 10) AS DOUBLE) AS a FROM events GROUP BY 1, 2) GROUP BY 1",
)
def acc_all(spark, d):
    return A.acc_all(table(spark, d, "events"), ["event_type"], ["user_id"], F.col("value") > 10)


@query(
    "acc_all_stderr",
    "SELECT event_type, round(stddev_samp(a) / sqrt(count(*)), 9) AS acc_all_stderr FROM (SELECT event_type, user_id, CAST(bool_and(value > 10) AS DOUBLE) AS a FROM events GROUP BY 1, 2) GROUP BY 1",
)
def acc_all_stderr(spark, d):
    return rounded(H.acc_all_stderr(table(spark, d, "events"), ["event_type"], ["user_id"], F.col("value") > 10), 9)


@query("expected_accuracy", "SELECT event_type, avg(score) AS expected_accuracy FROM attempts GROUP BY 1", ["attempts"])
def expected_accuracy(spark, d):
    return A.expected_accuracy(V.attempts(spark, d), ["event_type"], "score")


PER_QUESTION = ", q AS (SELECT event_type, question, count(*) AS k, sum(score) AS s, var_samp(score) AS v, min(score) AS lo, max(score) AS hi FROM attempts GROUP BY 1, 2) "


@query(
    "consensus_accuracy",
    PER_QUESTION + "SELECT event_type, avg(CAST(s > k / 2 AS DOUBLE)) AS consensus_accuracy FROM q GROUP BY 1",
    ["attempts"],
)
def consensus_accuracy(spark, d):
    return A.consensus_accuracy(V.attempts(spark, d), ["event_type"], ["question"], "score")


@query("internal_variance", PER_QUESTION + "SELECT event_type, round(avg(v), 9) AS internal_variance FROM q GROUP BY 1", ["attempts"])
def internal_variance(spark, d):
    return rounded(A.internal_variance(V.attempts(spark, d), ["event_type"], ["question"], "score"), 9)


@query(
    "consistency_rate",
    PER_QUESTION + "SELECT event_type, avg(CAST(lo = hi AS DOUBLE)) AS consistency_rate FROM q GROUP BY 1",
    ["attempts"],
)
def consistency_rate(spark, d):
    return A.consistency_rate(V.attempts(spark, d), ["event_type"], ["question"], "score")


@query(
    "stability_report",
    PER_QUESTION
    + "SELECT event_type AS task, round(sum(s) / sum(k), 9) AS expected_accuracy, round(avg(CAST(s > k / 2 AS DOUBLE)), 9) AS consensus_accuracy, "
    "round(avg(v), 9) AS internal_variance, round(avg(CAST(lo = hi AS DOUBLE)), 9) AS consistency_rate FROM q GROUP BY 1",
    ["attempts"],
)
def stability_report(spark, d):
    rows = V.attempts(spark, d).withColumnRenamed("event_type", "task")
    return rounded(A.stability_report(rows, ["task"], ["question"], "score"), 9)


TASK_RESULTS = """, r AS (SELECT task, avg(score) AS value, stddev_samp(score) / sqrt(count(*)) AS stderr, count(*) AS samples FROM scores GROUP BY task),
m AS (SELECT task, CASE WHEN task < 'e' THEN 'low' ELSE 'high' END AS grp FROM r UNION ALL SELECT task, 'all' FROM r)"""


def _task_results(spark, d):
    s = V.scores(spark, d)
    r = s.groupBy("task").agg(F.avg("score").alias("value"), H.mean_stderr("score").alias("stderr"), F.count(F.lit(1)).alias("samples"))
    return r.select("task", F.lit("acc").alias("metric"), F.lit("none").alias("filter"), "value", "stderr", "samples")


def _membership(spark, d):
    tasks = V.scores(spark, d).select("task").distinct()
    half = tasks.select("task", F.when(F.col("task") < "e", "low").otherwise("high").alias("parent"))
    top = half.select(F.lit("all").alias("parent"), F.col("parent").alias("child")).distinct()
    return A.flatten_membership(half.select("parent", F.col("task").alias("child")).unionByName(top))


@query(
    "group_report",
    TASK_RESULTS
    + """ SELECT grp AS "group", 'acc' AS metric, 'none' AS filter, round(CASE WHEN grp = 'low' THEN avg(value) ELSE sum(value * samples) / sum(samples) END, 6) AS value,
 round(sqrt(sum((samples - 1) * stderr * stderr * samples) / (sum(samples) - count(*)) / sum(samples)), 9) AS stderr, CAST(sum(samples) AS BIGINT) AS samples
 FROM r JOIN m USING (task) GROUP BY grp""",
    ["scores"],
)
def group_report(spark, d):
    members = _membership(spark, d)
    config = members.select("group").distinct().select(
        "group", F.lit("acc").alias("metric"), F.lit("none").alias("filter"), (F.col("group") != "low").alias("weight_by_size")
    )
    out = A.group_report(_task_results(spark, d), members, config)
    return out.withColumn("value", F.round("value", 6)).withColumn("stderr", F.round("stderr", 9))


@query(
    "group_report_own",
    TASK_RESULTS
    + """ SELECT grp AS "group", round(CASE WHEN grp = 'low' THEN min(value) WHEN grp = 'high' THEN exp(avg(ln(value + 1))) - 1 ELSE sum(value * samples) / sum(samples) END, 6) AS value, CAST(sum(samples) AS BIGINT) AS samples
 FROM r JOIN m USING (task) GROUP BY grp""",
    ["scores"],
)
def group_report_own(spark, d):
    """Groups whose values are the caller's own aggregations over the subtasks."""
    members = _membership(spark, d)
    how = F.when(F.col("group") == "low", "worst").when(F.col("group") == "high", "geometric").otherwise(F.lit(None).cast("string"))
    config = members.select("group").distinct().select(
        "group", F.lit("acc").alias("metric"), F.lit("none").alias("filter"), F.lit(True).alias("weight_by_size"), how.alias("aggregation")
    )
    own = {"worst": lambda v, n, w: F.min(v), "geometric": lambda v, n, w: F.exp(F.avg(F.ln(v + 1))) - 1}
    out = A.group_report(_task_results(spark, d), members, config, own)
    return out.select("group", F.round("value", 6).alias("value"), "samples")


@query(
    "pooled_stderr",
    TASK_RESULTS
    + """ SELECT grp AS "group", round(sqrt(sum((samples - 1) * stderr * stderr * samples) / (sum(samples) - count(*)) / sum(samples)), 9) AS pooled_stderr
 FROM r JOIN m USING (task) GROUP BY grp""",
    ["scores"],
)
def pooled_stderr(spark, d):
    rows = _task_results(spark, d).join(_membership(spark, d), "task")
    return rounded(H.pooled_stderr(rows, ["group"]), 9)


@query(
    "metric_direction",
    TASK_RESULTS
    + """ SELECT grp AS "group", x.metric, CASE WHEN x.metric = 'acc' THEN TRUE WHEN min(task < 'f') = max(task < 'f') THEN min(task < 'f') END AS higher_is_better
 FROM m, (VALUES ('acc'), ('loss')) x(metric) GROUP BY grp, x.metric""",
    ["scores"],
)
def metric_direction(spark, d):
    tasks = V.scores(spark, d).select("task").distinct()
    rows = tasks.withColumn("metric", F.explode(F.array(F.lit("acc"), F.lit("loss")))).withColumn(
        "higher_is_better", F.when(F.col("metric") == "acc", F.lit(True)).otherwise(F.col("task") < "f")
    )
    return A.metric_direction(rows, _membership(spark, d))


AGGREGATED = {"acc": "mean", "perplexity": "perplexity", "word_perplexity": "weighted_perplexity", "bits_per_byte": "bits_per_byte", "f1": "f1"}


@query(
    "aggregate_metrics",
    """ SELECT task, metric, filter, round(CASE any_value(metric) WHEN 'acc' THEN avg(value) WHEN 'perplexity' THEN exp(-avg(value))
 WHEN 'word_perplexity' THEN exp(-sum(value) / sum(weight)) WHEN 'bits_per_byte' THEN -sum(value) / sum(weight) / ln(2)
 ELSE 2.0 * count(*) FILTER (WHERE gold = 1 AND pred = 1) / (2 * count(*) FILTER (WHERE gold = 1 AND pred = 1) + count(*) FILTER (WHERE (gold = 1) <> (pred = 1))) END, 6) AS value,
 count(*) AS samples FROM long_scores GROUP BY task, metric, filter""",
    ["scores", "long_scores"],
)
def aggregate_metrics(spark, d):
    return rounded(A.aggregate_metrics(V.long_scores(spark, d), AGGREGATED))


@query("default_metrics", "SELECT task, 'acc' AS metric, 'none' AS filter, avg(score) AS value, count(*) AS samples FROM scores GROUP BY task", ["scores"])
def default_metrics(spark, d):
    rows = V.long_scores(spark, d, ("acc", "bits_per_byte"))
    return A.aggregate_metrics(rows, output_type="multiple_choice")


@query("metrics_with_error")
def metrics_with_error(spark, d):
    rows = V.long_scores(spark, d, ("acc", "perplexity", "f1", "mcc", "median", "bits_per_byte"))
    plan = {"acc": "mean", "perplexity": "perplexity", "f1": "f1", "mcc": "mcc", "median": "median", "bits_per_byte": "bits_per_byte"}
    return rounded(H.metrics_with_error(rows, plan, iters=200))


@query(
    "mean_with_error",
    "SELECT task, 'acc' AS metric, 'none' AS filter, round(avg(score), 9) AS value, count(*) AS samples, round(stddev_samp(score) / sqrt(count(*)), 9) AS stderr FROM scores GROUP BY task",
    ["scores"],
)
def mean_with_error(spark, d):
    return rounded(H.metrics_with_error(V.long_scores(spark, d, ("acc",)), {"acc": "mean"}, iters=1), 9)


@query(
    "sample_counts",
    "SELECT lang AS task, count(*) AS original, least(count(*), 100) AS effective FROM documents GROUP BY lang",
)
def sample_counts(spark, d):
    from ..operators.questions import sample_counts as counts

    return counts(table(spark, d, "documents").select(F.col("lang").alias("task")), ["task"], 100)


# --- statistics ---


@query(
    "stddev",
    "SELECT task, round(stddev_pop(score), 9) AS pop_stddev, round(stddev_samp(score), 9) AS sample_stddev, round(stddev_samp(score) / sqrt(count(*)), 9) AS mean_stderr FROM scores GROUP BY task",
    ["scores"],
)
def stddev(spark, d):
    return rounded(
        A.by_key(V.scores(spark, d), ["task"], pop_stddev=H.pop_stddev("score"), sample_stddev=H.sample_stddev("score"), mean_stderr=H.mean_stderr("score")),
        9,
    )


CLUSTERED = """, g AS (SELECT {key} AS k, avg({s}) AS m, count(*) AS n, var_samp({s}) AS v FROM {view} GROUP BY 1),
c AS (SELECT {key} AS k, {c} AS c, sum({s} - m) AS d, sum(({s} - m) * ({s} - m)) AS q FROM {view} JOIN g ON g.k = {key} GROUP BY 1, 2),
x AS (SELECT k, sum(d * d - q) AS cross_sum, count(DISTINCT c) AS clusters FROM c GROUP BY k)"""


@query(
    "clustered_stderr",
    CLUSTERED.format(key="task", s="score", c="cluster", view="scores")
    + " SELECT k AS task, n, round(m, 9) AS mean, round(sqrt(v / n), 9) AS stderr_clt, clusters, round(sqrt(v / n + cross_sum / (n * n)), 9) AS stderr_clustered FROM g JOIN x USING (k)",
    ["scores"],
)
def clustered_stderr(spark, d):
    return rounded(H.clustered_stderr(V.scores(spark, d), ["task"], "score", "cluster"), 9)


@query(
    "clustered_stderr_lines",
    CLUSTERED.format(key="question_class", s="accuracy", c="source_video_id", view="line_steps")
    + " SELECT k AS task, n, round(m, 8) AS mean, round(sqrt(v / n), 8) AS stderr_clt, clusters, round(sqrt(v / n + cross_sum / (n * n)), 8) AS stderr_clustered FROM g JOIN x USING (k)",
    ["line_steps"],
)
def clustered_stderr_lines(spark, d):
    rows = V.line_steps(spark, d).withColumnRenamed("question_class", "task")
    return rounded(H.clustered_stderr(rows, ["task"], "accuracy", "source_video_id"), 8)


@query(
    "clt_stderr",
    CLUSTERED.format(key="task", s="score", c="cluster", view="scores")
    + " SELECT k AS task, round(sqrt(v / n), 9) AS stderr_clt, CASE WHEN clusters > 1 THEN round(sqrt(v / n + cross_sum / (n * n)), 9) END AS stderr_clustered FROM g JOIN x USING (k)",
    ["scores"],
)
def clt_stderr(spark, d):
    return rounded(H.clt_stderr(V.scores(spark, d), ["task"], "score", "cluster"), 9)


@query(
    "paired_moments",
    "SELECT task, count(*) AS n, round(avg(score - baseline), 9) AS mean_diff, round(stddev_samp(score - baseline) / sqrt(count(*)), 9) AS se_diff, "
    "round(CASE WHEN stddev_samp(score - baseline) = 0 THEN CASE WHEN avg(score - baseline) > 0 THEN 'inf'::DOUBLE WHEN avg(score - baseline) < 0 THEN '-inf'::DOUBLE ELSE 0 END ELSE avg(score - baseline) / (stddev_samp(score - baseline) / sqrt(count(*))) END, 6) AS t_stat, round(avg(baseline), 9) AS baseline_mean FROM scores GROUP BY task",
    ["scores"],
)
def paired_moments(spark, d):
    out = rounded(H.paired_moments(V.scores(spark, d), ["task"], "score", "baseline"), 9)
    return out.withColumn("t_stat", F.round("t_stat", 6))


# Distribution functions for the checks, by Simpson's rule over 1,000 intervals; {0} is the upper limit.
SIMPSON = "{0} / 3000.0 * list_sum([(CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {1} for i in range(1001)])"
T_HALF = (
    "(exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * "
    + SIMPSON.format("{0}", "pow(1 + pow({0} * i / 1000.0, 2) / nu, -(nu + 1) / 2)")
    + ")"
)
NORMAL_HALF = "(" + SIMPSON.format("{0}", "exp(-pow({0} * i / 1000.0, 2) / 2) / sqrt(2 * pi())") + ")"
# per task: difference, error, t, its two-sided p, and the 97.5 % point of t by 45 halvings
T_TEST = (
    with_views(["scores"], "").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", m AS (SELECT task, count(*) AS n, count(*) - 1.0::DOUBLE AS nu, avg(score - baseline) AS d, stddev_samp(score - baseline) / sqrt(count(*)) AS se, avg(baseline) AS b FROM scores GROUP BY task),
t AS (SELECT *, CASE WHEN se > 0 THEN d / se WHEN d > 0 THEN 'inf'::DOUBLE WHEN d < 0 THEN '-inf'::DOUBLE ELSE 0 END AS t FROM m),
c AS (SELECT task, nu, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, 32.0::DOUBLE AS mid, 0 AS step FROM m
 UNION ALL SELECT task, nu, lo2, hi2, (lo2 + hi2) / 2, step + 1 FROM (SELECT task, nu, step, CASE WHEN {T_HALF.format('mid')} < 0.475 THEN mid ELSE lo END AS lo2,
  CASE WHEN {T_HALF.format('mid')} < 0.475 THEN hi ELSE mid END AS hi2 FROM c WHERE step < 45)),
r AS (SELECT t.*, c.mid AS crit, CASE WHEN se = 0 THEN CASE WHEN d = 0 THEN 1 ELSE 0 END ELSE 1 - 2 * {T_HALF.format('abs(t)')} END AS p FROM t JOIN (SELECT task, mid FROM c WHERE step = 45) c ON c.task = t.task)
"""
)


@query(
    "paired_ttest",
    T_TEST
    + "SELECT task, n, round(d, 6) AS mean_diff, round(se, 6) AS se_diff, round(d - crit * se, 6) AS ci_lower, round(d + crit * se, 6) AS ci_upper, round(t, 6) AS t_stat, round(p, 6) AS p_value, round(b, 6) AS baseline_mean FROM r",
)
def paired_ttest(spark, d):
    return rounded(H.paired_ttest(V.scores(spark, d), ["task"], "score", "baseline"))


@query(
    "compare_to_baseline",
    "SELECT task, 'other' AS paired_baseline, round(100 * avg(baseline), 6) AS paired_baseline_score, round(100 * avg(score - baseline), 6) AS paired_diff, count(*) AS paired_n FROM scores GROUP BY task",
    ["scores"],
)
def compare_to_baseline(spark, d):
    s = V.scores(spark, d)
    out = H.compare_to_baseline(
        s.select("task", "doc_id", "score"), s.select("task", "doc_id", "baseline"), ["task"], "score", "baseline", "other"
    )
    return rounded(out.drop("paired_ci_lower", "paired_ci_upper", "paired_pvalue"))


@query(
    "baseline_intervals",
    T_TEST
    + "SELECT task, 'other' AS paired_baseline, round(100 * b, 4) AS paired_baseline_score, round(100 * d, 4) AS paired_diff, round(100 * (d - crit * se), 4) AS paired_ci_lower, round(100 * (d + crit * se), 4) AS paired_ci_upper, round(p, 4) AS paired_pvalue, n AS paired_n FROM r",
)
def baseline_intervals(spark, d):
    s = V.scores(spark, d)
    out = H.compare_to_baseline(
        s.select("task", "doc_id", "score"), s.select("task", "doc_id", "baseline"), ["task"], "score", "baseline", "other"
    )
    return rounded(out, 4)


@query(
    "power_report",
    """, p AS (SELECT task, count(*) AS n, stddev_samp(score) AS a, stddev_samp(baseline) AS b, COALESCE(covar_samp(score, baseline) / nullif(stddev_samp(score) * stddev_samp(baseline), 0), 0.5) AS r FROM scores GROUP BY task),
q AS (SELECT *, sqrt(a * a + b * b - 2 * r * a * b) AS sd FROM p)
SELECT task, n, round(a, 6) AS std_a, round(b, 6) AS std_b, round(r, 6) AS correlation, CAST(ceil(pow((1.959963984540054 + 0.8416212335729143) * sd / 0.05, 2)) AS BIGINT) AS min_n,
 round((1.959963984540054 + 0.8416212335729143) * sd / sqrt(n), 4) AS min_detectable_effect, n >= ceil(pow((1.959963984540054 + 0.8416212335729143) * sd / 0.05, 2)) AS sufficient FROM q""",
    ["scores"],
)
def power_report(spark, d):
    return rounded(H.power_report(V.scores(spark, d), ["task"], "score", "baseline", 0.05).drop("current_power"))


Z = "(1.959963984540054 + 0.8416212335729143)"
POWER = "0.5 + " + NORMAL_HALF.format("z")


@query(
    "power_now",
    f""", p AS (SELECT task, count(*) AS n, stddev_samp(score) AS a, stddev_samp(baseline) AS b, COALESCE(covar_samp(score, baseline) / nullif(stddev_samp(score) * stddev_samp(baseline), 0), 0.5) AS r FROM scores GROUP BY task),
q AS (SELECT *, sqrt(a * a + b * b - 2 * r * a * b) AS sd FROM p), w AS (SELECT *, 0.05 / nullif(sd, 0) * sqrt(n) - 1.959963984540054 AS z FROM q)
SELECT task, n, CASE WHEN z IS NOT NULL THEN round({POWER}, 4) END AS current_power FROM w""",
    ["scores"],
)
def power_now(spark, d):
    return H.power_report(V.scores(spark, d), ["task"], "score", "baseline", 0.05).select("task", "n", "current_power")


@query(
    "power_from_sizes",
    f""", p AS (SELECT task, count(*) AS n FROM scores GROUP BY task), w AS (SELECT *, 0.03 / 0.5 * sqrt(n) - 1.959963984540054 AS z FROM p)
SELECT task, n, CAST(ceil(pow({Z} * 0.5 / 0.03, 2)) AS BIGINT) AS min_n, round({POWER}, 4) AS current_power, round({Z} * 0.5 / sqrt(n), 4) AS min_detectable_effect, n >= ceil(pow({Z} * 0.5 / 0.03, 2)) AS sufficient FROM w""",
    ["scores"],
)
def power_from_sizes(spark, d):
    sizes = V.scores(spark, d).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return rounded(H.power_from_sizes(sizes, 0.03))


@query("bootstrap_stderr")
def bootstrap_stderr(spark, d):
    s = V.scores(spark, d)
    parts = [
        H.bootstrap_stderr(s, ["task"], m, 200).select("task", F.lit(m).alias("metric"), "bootstrap_stderr")
        for m in ("f1", "mcc", "perplexity")
    ]
    med = H.bootstrap_median(s, ["task"], "n_chars", 1000).select("task", F.lit("median").alias("metric"), "bootstrap_stderr")
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(med))


@query("bootstrap_agrees", "SELECT lang AS task, TRUE AS close FROM documents GROUP BY lang")
def bootstrap_agrees(spark, d):
    """The resampled error of a perplexity against its closed form, perplexity * s / sqrt(n), within a quarter."""
    n = F.col("n_chars")
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("task"), (-(n % 97) / F.lit(97.0)).alias("value"))
    boot = H.bootstrap_stderr(rows, ["task"], "perplexity", 200, seed=3)
    exact = rows.groupBy("task").agg((A.perplexity() * H.mean_stderr()).alias("exact"))
    close = F.abs(F.col("bootstrap_stderr") / F.col("exact") - 1) < 0.25
    return boot.join(exact, "task").select("task", close.alias("close"))


@query("bootstrap_text")
def bootstrap_text(spark, d):
    return rounded(H.bootstrap_stderr(spread(V.turn_pairs(spark, d), "doc_id"), ["task"], "chrf", 100))


# --- telemetry ---

USAGE_SUMS = "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(input_tokens + output_tokens + reasoning_tokens) AS BIGINT) AS total_tokens, count(*) AS n_api_calls"


@query(
    "usage_report",
    f"SELECT 'total' AS level, CAST(NULL AS VARCHAR) AS name, {USAGE_SUMS} FROM usage_log "
    f"UNION ALL SELECT 'task', COALESCE(task_name, '_unknown'), {USAGE_SUMS} FROM usage_log GROUP BY 2 "
    f"UNION ALL SELECT 'source', source, {USAGE_SUMS} FROM usage_log GROUP BY 2",
    ["usage_log"],
)
def usage_report(spark, d):
    return I.usage_report(V.usage(spark, d))


@query(
    "budget_cutoff",
    """, r AS (SELECT seq, sum(input_tokens + output_tokens + reasoning_tokens) OVER (ORDER BY seq) AS s FROM usage_log),
t AS (SELECT CAST(max(s) AS BIGINT) AS total FROM r), h AS (SELECT seq, s FROM r WHERE s >= 200000 ORDER BY seq LIMIT 1)
SELECT CAST(200000 AS BIGINT) AS budget, total AS total_tokens, total >= 200000 AS budget_exceeded, seq AS first_call, CAST(s AS BIGINT) AS tokens_then FROM t LEFT JOIN h ON TRUE""",
    ["usage_log"],
)
def budget_cutoff(spark, d):
    return I.budget_cutoff(V.usage(spark, d), "seq", 200_000)


@query(
    "throughput_report",
    """ SELECT CAST(sum(len(string_split(text, ' ')) * 1.5) AS DOUBLE) AS total_gen_tokens, CAST(sum(n_chars) AS DOUBLE) / 8 AS total_elapsed_time,
 round(sum(len(string_split(text, ' ')) * 1.5) / (sum(n_chars) / 8.0), 6) AS avg_speed, round(sum(n_chars) / 8.0 / count(*), 6) AS avg_latency, round(avg(doc_id % 10), 6) AS avg_retries FROM documents""",
)
def throughput_report(spark, d):
    log = table(spark, d, "documents").select(
        I.space_tokens(F.col("text")).alias("total_gen_tokens"),
        (F.col("n_chars") / 8).alias("total_elapsed_time"),
        I.token_throughput(I.space_tokens(F.col("text")), F.col("n_chars") / 8).alias("avg_speed"),
        F.lit(1).alias("total_requests"),
        (F.col("doc_id") % 10).alias("retries"),
    )
    return rounded(I.throughput_report(log, ["retries"]))


EFFICIENCY = """CAST(count(*) AS DOUBLE) AS docs, CAST(count(*) FILTER (WHERE has) AS DOUBLE) AS docs_with_token_counts, COALESCE(sum(i) FILTER (WHERE has), 0)::DOUBLE AS total_input_tokens,
 COALESCE(sum(o) FILTER (WHERE has), 0)::DOUBLE AS total_output_tokens, COALESCE(sum(i + o) FILTER (WHERE has), 0)::DOUBLE AS total_tokens, COALESCE(sum(s) FILTER (WHERE s > 0), 0)::DOUBLE AS total_correct_score,
 round(COALESCE(sum(o) FILTER (WHERE has) / count(*) FILTER (WHERE has), 0), 6) AS avg_output_tokens_per_sample, round(sum(o) FILTER (WHERE has) / sum(s) FILTER (WHERE s > 0), 6) AS tokens_per_correct_answer"""


@query(
    "efficiency_report",
    f""", e AS (SELECT event_type AS task, event_id % 4 <> 0 AS has, floor(value) AS i, CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(value * 2) END + 1 AS o,
 CASE WHEN event_id % 6 = 0 THEN CAST(value > 80 AS DOUBLE) ELSE CAST(value > 50 AS DOUBLE) END AS s FROM attempts)
 SELECT 'task' AS level, task, {EFFICIENCY} FROM e GROUP BY task UNION ALL SELECT 'overall', NULL, {EFFICIENCY} FROM e""",
    ["attempts"],
)
def efficiency_report(spark, d):
    e, v = F.col("event_id"), F.col("value")
    counts = F.array(
        F.struct(F.floor(v).alias("input_tokens"), F.when(e % 3 != 0, F.floor(v * 2)).alias("output_tokens")),
        F.struct(F.lit(None).cast("bigint").alias("input_tokens"), F.lit(1).cast("bigint").alias("output_tokens")),
        F.lit(None),
    )
    rows = V.attempts(spark, d).select(
        F.col("event_type").alias("task"),
        F.when(e % 4 != 0, counts).alias("token_counts"),
        F.when(e % 6 != 0, F.struct(F.col("score").alias("score"))).alias("video_score"),
        (v > 80).cast("double").alias("zz_score"),
    )
    return rounded(I.efficiency_report(rows, "missing"))


# --- result tables ---


@query(
    "results_long",
    CLUSTERED.format(key="task", s="score", c="cluster", view="scores")
    + """ SELECT k AS task, 'none' AS filter, 'acc' AS metric, round(m, 8) AS value, n AS samples, round(sqrt(v / n), 8) AS stderr, round(sqrt(v / n), 8) AS stderr_clt,
 CASE WHEN clusters > 1 THEN round(sqrt(v / n + cross_sum / (n * n)), 8) END AS stderr_clustered, CAST(NULL AS DOUBLE) AS expected_accuracy, CAST(NULL AS DOUBLE) AS consensus_accuracy,
 CAST(NULL AS DOUBLE) AS internal_variance, CAST(NULL AS DOUBLE) AS consistency_rate, upper(k) AS alias, 'other' AS paired_baseline, round(100 * b, 6) AS paired_baseline_score, round(100 * (m - b), 6) AS paired_diff
 FROM g JOIN x USING (k) JOIN (SELECT task AS k, avg(baseline) AS b FROM scores GROUP BY 1) USING (k)""",
    ["scores"],
)
def results_long(spark, d):
    s = V.scores(spark, d).withColumn("filter", F.lit("none")).withColumn("metric", F.lit("acc"))
    values = A.aggregate_metrics(V.long_scores(spark, d, ("acc",)), {"acc": "mean"})
    plain = s.groupBy(*K.KEYS).agg(H.mean_stderr("score").alias("stderr"))
    clt = H.clt_stderr(s, K.KEYS, "score", "cluster")
    stats = [K.statistic_rows(plain, ["stderr"]), K.statistic_rows(clt, ["stderr_clt", "stderr_clustered"])]
    tasks = s.select("task").distinct().withColumn("alias", F.upper("task"))
    paired = compare_to_baseline(spark, d)
    return rounded(K.results_long(values, stats, tasks, paired), 8)


@query(
    "results_flat",
    ", r AS (SELECT task, avg(score) AS v FROM scores GROUP BY task) SELECT task || '/acc' AS key, round(v, 6) AS value, CAST(NULL AS VARCHAR) AS text FROM r "
    "UNION ALL SELECT task || '/alias', NULL, 'name of ' || task FROM r",
    ["scores"],
)
def results_flat(spark, d):
    r = V.scores(spark, d).groupBy("task").agg(F.avg("score").alias("v"))
    rows = r.select("task", F.lit("acc,none").alias("name"), F.round("v", 6).cast("string").alias("value")).unionByName(
        r.select("task", F.lit("alias").alias("name"), F.concat(F.lit("name of "), "task").alias("value"))
    )
    return K.results_flat(rows)
