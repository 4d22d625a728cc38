"""Aggregations of score tables. All are algebraic: partial sums first, one shuffle of group totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..ordering import value_at

VALUE, GOLD, PRED, WEIGHT = "value", "gold", "pred", "weight"


def mean(value: str = VALUE) -> Column:
    return F.avg(value)


def perplexity(value: str = VALUE) -> Column:
    return F.exp(-F.avg(value))


def weighted_perplexity(value: str = VALUE, weight: str = WEIGHT) -> Column:
    return F.exp(-F.try_divide(F.sum(value), F.sum(weight)))


def bits_per_byte(value: str = VALUE, weight: str = WEIGHT) -> Column:
    return -F.try_divide(F.sum(value), F.sum(weight)) / F.log(F.lit(2.0))


def count_words(c: Column) -> Column:
    return F.size(F.split(c, r"(?U)\s+"))


def count_bytes(c: Column) -> Column:
    return F.octet_length(c)


def f1(gold: str = GOLD, pred: str = PRED) -> Column:
    """Binary F1 of class 1; 0 when there is neither a gold nor a predicted positive."""
    tp = F.count_if((F.col(gold) == 1) & (F.col(pred) == 1))
    wrong = F.count_if((F.col(gold) == 1) != (F.col(pred) == 1))
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + wrong), F.lit(0.0))


def brier(gold: str = GOLD, probs: str = "probs") -> Column:
    diff = F.transform(probs, lambda p, i: F.pow(p - F.when(i == F.col(gold), 1.0).otherwise(0.0), F.lit(2)))
    return F.avg(F.aggregate(diff, F.lit(0.0), lambda a, b: a + b))


def by_key(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def _middle() -> Column:
    return F.floor(F.col("total") / 2) + 1


def median(df: DataFrame, keys: list[str], value: str = VALUE, name: str = "median") -> DataFrame:
    """Upper median of the sorted values, exact at any size: the value at rank n div 2 + 1."""
    return value_at(df, keys, value, 0.5, _middle()).select(*keys, F.col(value).alias(name))


def middle_row(df: DataFrame, keys: list[str], order: str, value: str = VALUE, name: str = "median") -> DataFrame:
    """The value of row n div 2 in input order; order must be unique per key."""
    return value_at(df, keys, order, 0.5, _middle(), carry=value).select(*keys, F.col(value).alias(name))


def mcc(df: DataFrame, keys: list[str], gold: str = GOLD, pred: str = PRED, name: str = "mcc") -> DataFrame:
    """Matthews correlation over any number of classes, 0 when undefined."""
    cells = df.groupBy(*keys, gold, pred).agg(F.count(F.lit(1)).cast("double").alias("n"))
    zero = F.lit(0.0)
    sides = F.array(
        F.struct(
            F.col(gold).alias("c"),
            F.col("n").alias("t"),
            zero.alias("p"),
            F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(zero).alias("ok"),
        ),
        F.struct(F.col(pred).alias("c"), zero.alias("t"), F.col("n").alias("p"), zero.alias("ok")),
    )
    per_class = (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.c")
        .agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.ok").alias("ok"))
    )
    s = per_class.groupBy(*keys).agg(
        F.sum("ok").alias("c"),
        F.sum("t").alias("s"),
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
    )
    n2 = F.col("s") * F.col("s")
    below = F.sqrt((n2 - F.col("pp")) * (n2 - F.col("tt")))
    value = F.when(below == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("tp")) / F.nullif(below, F.lit(0.0)))
    return s.select(*keys, value.alias(name))


def all_right(df: DataFrame, group: list[str], right: Column) -> DataFrame:
    return df.groupBy(*group).agg(F.bool_and(right).cast("double").alias("all_right"))


def acc_all(df: DataFrame, keys: list[str], group: list[str], right: Column, name: str = "acc_all") -> DataFrame:
    """Share of groups (paragraph, question) with every answer right."""
    return all_right(df, keys + group, right).groupBy(*keys).agg(F.avg("all_right").alias(name))


def stability_report(
    df: DataFrame, keys: list[str], question: list[str], score: str, questions: DataFrame | None = None
) -> DataFrame:
    """Expected accuracy, consensus, internal variance and consistency over k samples per question.

    questions: all questions (keys + question); those without a sample stay in the denominators of consensus and
    consistency. NaN where nothing can be computed.
    """
    s = F.col(score).cast("double")
    per = (
        df.where(s.isNotNull())
        .groupBy(*keys, *question)
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum(s).alias("total"),
            F.var_samp(s).alias("var"),
            F.min(s).alias("lo"),
            F.max(s).alias("hi"),
        )
    )
    if questions is not None:
        per = questions.select(*keys, *question).distinct().join(per, keys + question, "left")
    nan = F.lit(float("nan"))
    return per.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("total"), F.sum("k")), nan).alias("expected_accuracy"),
        F.avg(F.coalesce(F.col("total") > F.col("k") / 2, F.lit(False)).cast("double")).alias("consensus_accuracy"),
        F.coalesce(F.avg("var"), nan).alias("internal_variance"),
        F.avg(F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)).cast("double")).alias("consistency_rate"),
    )


def expected_accuracy(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.col(score).cast("double")), F.lit(float("nan"))).alias("expected_accuracy"))


def consensus_accuracy(df, keys, question, score, questions=None) -> DataFrame:
    return stability_report(df, keys, question, score, questions).select(*keys, "consensus_accuracy")


def internal_variance(df, keys, question, score) -> DataFrame:
    return stability_report(df, keys, question, score).select(*keys, "internal_variance")


def consistency_rate(df, keys, question, score, questions=None) -> DataFrame:
    return stability_report(df, keys, question, score, questions).select(*keys, "consistency_rate")


# Named aggregations: a factory of one aggregate expression, or a function of (df, keys, name) for those that need
# more than one grouping.
AGGREGATIONS: dict[str, Callable[[], Column]] = {
    "mean": mean,
    "perplexity": perplexity,
    "weighted_perplexity": weighted_perplexity,
    "bits_per_byte": bits_per_byte,
    "f1": f1,
}
TABLE_AGGREGATIONS: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {
    "median": lambda df, keys, name: median(df, keys, name=name),
    "mcc": lambda df, keys, name: mcc(df, keys, name=name),
}
METRICS: dict[str, dict] = {
    "acc": {"aggregation": "mean", "higher_is_better": True, "output_types": ["loglikelihood", "multiple_choice"]},
    "acc_norm": {"aggregation": "mean", "higher_is_better": True, "output_types": ["multiple_choice"]},
    "acc_mutual_info": {"aggregation": "mean", "higher_is_better": True, "output_types": ["multiple_choice"]},
    "exact_match": {"aggregation": "mean", "higher_is_better": True, "output_types": ["generate_until"]},
    "anls": {"aggregation": "mean", "higher_is_better": True, "output_types": ["generate_until"]},
    "perplexity": {"aggregation": "perplexity", "higher_is_better": False, "output_types": ["loglikelihood"]},
    "word_perplexity": {"aggregation": "weighted_perplexity", "higher_is_better": False, "output_types": ["loglikelihood_rolling"]},
    "byte_perplexity": {"aggregation": "weighted_perplexity", "higher_is_better": False, "output_types": ["loglikelihood_rolling"]},
    "bits_per_byte": {"aggregation": "bits_per_byte", "higher_is_better": False, "output_types": ["loglikelihood_rolling"]},
    "f1": {"aggregation": "f1", "higher_is_better": True, "output_types": ["multiple_choice"]},
    "mcc": {"aggregation": "mcc", "higher_is_better": True, "output_types": ["multiple_choice"]},
    "bleu": {"aggregation": "bleu", "higher_is_better": True, "output_types": ["generate_until"]},
    "chrf": {"aggregation": "chrf", "higher_is_better": True, "output_types": ["generate_until"]},
    "ter": {"aggregation": "ter", "higher_is_better": False, "output_types": ["generate_until"]},
}
#: Metrics of a task that names none.
DEFAULT_METRICS = {
    "loglikelihood": ["perplexity", "acc"],
    "multiple_choice": ["acc", "acc_norm"],
    "generate_until": ["exact_match"],
    "generate_until_multi_round": ["exact_match"],
    "generate_until_agentic": ["exact_match"],
}


def register_aggregation(name: str, fn, by_table: bool = False, sufficient_stats=None) -> None:
    """fn: () -> aggregate Column, or with by_table (df, keys, name) -> DataFrame. A grouped-agg pandas UDF call is a
    Column too. sufficient_stats = (columns, statistic) makes it bootstrappable: statistic is an expression over those
    columns, read as sums over a replicate, see statistics.bootstrap_sums."""
    table = TABLE_AGGREGATIONS if by_table else AGGREGATIONS
    if name in AGGREGATIONS or name in TABLE_AGGREGATIONS:
        raise ValueError(f"aggregation {name!r} is already registered")
    table[name] = fn
    if sufficient_stats:
        SUFFICIENT_STATS[name] = sufficient_stats


def register_metric(name: str, fn=None, higher_is_better: bool | None = None, output_types=(), aggregation="mean") -> None:
    if name in METRICS:
        raise ValueError(f"metric {name!r} is already registered")
    METRICS[name] = {
        "fn": fn,
        "aggregation": aggregation,
        "higher_is_better": higher_is_better,
        "output_types": list(output_types),
    }


SUFFICIENT_STATS: dict[str, tuple] = {}
SCORE_KEYS = ["task", "metric", "filter"]


def aggregate_metrics(
    scores: DataFrame,
    aggregation: dict[str, str] | None = None,
    output_type: str | None = None,
    mean_errors: bool = False,
) -> DataFrame:
    """(task, metric, filter, value, samples) from a long score table; with mean_errors also stderr of the means.

    aggregation: metric -> aggregation name; without it, the defaults of the metrics of output_type. All one-expression
    aggregations share one grouping: each metric picks its expression.
    """
    if aggregation is None:
        names = DEFAULT_METRICS[output_type] if output_type else list(METRICS)
        aggregation = {m: METRICS[m]["aggregation"] for m in names}
    simple = {m: a for m, a in aggregation.items() if a in AGGREGATIONS}
    used = sorted(set(simple.values()))
    parts = []
    if simple:
        error = F.stddev_samp(VALUE) / F.sqrt(F.count(VALUE))
        grouped = scores.where(F.col("metric").isin(*simple)).groupBy(*SCORE_KEYS).agg(
            F.count(F.lit(1)).alias("samples"), error.alias("_error"), *[AGGREGATIONS[a]().alias(f"_{a}") for a in used]
        )
        chosen = F.coalesce(*[F.when(F.col("metric") == m, F.col(f"_{a}")) for m, a in simple.items()])
        means = F.col("metric").isin(*[m for m, a in simple.items() if a == "mean"])
        shown = [F.when(means & (F.col("samples") > 1), F.col("_error")).alias("stderr")] if mean_errors else []
        parts.append(grouped.select(*SCORE_KEYS, chosen.alias("value"), "samples", *shown))
    for m, a in aggregation.items():
        if a in TABLE_AGGREGATIONS:
            rows = scores.where(F.col("metric") == m)
            counts = rows.groupBy(*SCORE_KEYS).agg(F.count(F.lit(1)).alias("samples"))
            part = TABLE_AGGREGATIONS[a](rows, SCORE_KEYS, "value").join(counts, SCORE_KEYS)
            none = [F.lit(None).cast("double").alias("stderr")] if mean_errors else []
            parts.append(part.select(*SCORE_KEYS, F.col("value").cast("double").alias("value"), "samples", *none))
        elif a not in AGGREGATIONS:
            raise KeyError(f"aggregation {a!r} is not registered")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: name -> fn(value, size, weighted) giving an aggregate Column over the subtasks of a group.
GROUP_AGGREGATIONS: dict[str, object] = {}


def register_group_aggregation(name: str, fn) -> None:
    """fn(value, size, weighted): Columns of a subtask's value, its number of samples and whether the group weighs by
    size, to an aggregate Column over a group's subtasks. Spark merges its partial states like those of any aggregate."""
    if name in GROUP_AGGREGATIONS or name == "mean":
        raise ValueError(f"group aggregation {name!r} is already registered")
    GROUP_AGGREGATIONS[name] = fn


def _weighted_mean(value: Column, size: Column, weighted: Column) -> Column:
    w = F.when(weighted, size).otherwise(F.lit(1.0))
    return F.try_divide(F.sum(value * w), F.sum(w))


def group_report(results: DataFrame, membership: DataFrame, metrics: DataFrame, aggregations: dict | None = None) -> DataFrame:
    """Group rows from task results (task, metric, filter, value, stderr, samples).

    membership: (group, task), nested groups already flattened; metrics: (group, metric, filter, weight_by_size) and, if
    wanted, `aggregation`: mean (also for null), the name of a registered group aggregation or of one in `aggregations`
    (name -> function). An unknown name is an error. The error is pooled unless any subtask has none.
    """
    n, se = F.col("samples").cast("double"), F.col("stderr")
    joined = results.join(membership, "task").join(metrics, ["group", "metric", "filter"])
    value = _weighted_mean(F.col("value"), n, F.col("weight_by_size"))
    if "aggregation" in metrics.columns:
        asked = F.coalesce(F.max("aggregation"), F.lit("mean"))
        chosen = F.when(asked == "mean", value)
        for name, fn in (GROUP_AGGREGATIONS | (aggregations or {})).items():
            chosen = chosen.when(asked == name, fn(F.col("value"), n, F.col("weight_by_size")).cast("double"))
        unknown = F.raise_error(F.concat(F.lit("group aggregation is not registered: "), asked)).cast("double")
        value = chosen.otherwise(unknown)
    return joined.groupBy("group", "metric", "filter").agg(
        value.alias("value"),
        F.when(F.count_if(se.isNull()) == 0, F.sqrt(F.try_divide(F.try_divide(F.sum((n - 1) * se * se * n), F.sum(n) - F.count(F.lit(1))), F.sum(n)))).alias("stderr"),
        F.sum("samples").alias("samples"),
    )


#: A group tree of so many edges is walked on the driver; a larger one by joins.
SMALL_TREE = 10_000


def _leaves_below(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    children: dict[str, set[str]] = {}
    for parent, child in edges:
        children.setdefault(parent, set()).add(child)
    out = []
    for group in children:
        seen, todo = set(), list(children[group])
        while todo:
            at = todo.pop()
            if at == group:
                raise ValueError("the groups contain a cycle")
            if at not in seen:
                seen.add(at)
                todo += children.get(at, ())
        out += [(group, task) for task in seen if task not in children]
    return out


def flatten_membership(edges: DataFrame) -> DataFrame:
    """(group, task) for all tasks below a group, from (parent, child) edges of the group tree, however deep it is.

    The tree is configuration: up to `SMALL_TREE` edges are looked through on the driver. In a larger one every round
    doubles the reach by joining the pairs found with themselves, until a round finds nothing new; each round is stored, so
    plans do not grow. A cycle is an error.
    """
    few = edges.select("parent", "child").distinct().limit(SMALL_TREE + 1).collect()
    if len(few) <= SMALL_TREE:
        return edges.sparkSession.createDataFrame(_leaves_below([(r["parent"], r["child"]) for r in few]), "`group` string, task string")
    parents = edges.select(F.col("parent").alias("task")).distinct()
    found = stored(edges.select(F.col("parent").alias("group"), F.col("child").alias("task")).distinct(), "groups")
    while True:
        if found.where(F.col("group") == F.col("task")).head(1):
            raise ValueError("the groups contain a cycle")
        below = found.select(F.col("group").alias("task"), F.col("task").alias("below"))
        new = found.join(below, "task").select("group", F.col("below").alias("task")).distinct().join(found, ["group", "task"], "left_anti")
        wider = stored(found.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), "groups")
        if not wider.where("_new").head(1):
            break
        found = wider.drop("_new")
    return found.join(parents, "task", "left_anti").select("group", "task")


def metric_direction(directions: DataFrame, membership: DataFrame) -> DataFrame:
    """(group, metric, higher_is_better); null when the subtasks disagree or one has none."""
    h = F.col("higher_is_better").cast("int")
    agree = (F.min(h) == F.max(h)) & (F.count(h) == F.count(F.lit(1)))
    return (
        directions.join(membership, "task")
        .groupBy("group", "metric")
        .agg(F.when(agree, F.min(h)).cast("boolean").alias("higher_is_better"))
    )
