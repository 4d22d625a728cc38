"""Token usage, throughput and efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordering import first_reaching

TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens"]


def usage_report(usage: DataFrame) -> DataFrame:
    """(level, name, tokens, calls) for the total, per task and per source.

    Grouping sets over the totals per (task, source), so the rows themselves are read and reduced once.
    """
    rows = usage.select(F.coalesce("task_name", F.lit("_unknown")).alias("task_name"), "source", *TOKENS)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TOKENS]
    cell = rows.groupBy("task_name", "source").agg(*sums, F.count(F.lit(1)).alias("n_api_calls"))
    out = cell.groupingSets([[], ["task_name"], ["source"]], "task_name", "source").agg(
        F.grouping_id().alias("_g"), *sums, F.sum("n_api_calls").alias("n_api_calls")
    )
    g = F.col("_g")
    return out.where("n_api_calls > 0").select(
        F.when(g == 3, "total").when(g == 1, "task").otherwise("source").alias("level"),
        F.when(g == 1, F.col("task_name")).when(g == 2, F.col("source")).alias("name"),
        *TOKENS,
        (F.col(TOKENS[0]) + F.col(TOKENS[1]) + F.col(TOKENS[2])).alias("total_tokens"),
        "n_api_calls",
    )


def budget_cutoff(usage: DataFrame, order: str, budget: int) -> DataFrame:
    """One row: budget, total, whether it was reached, the first call (order value) that reached it, the total there.

    order is numeric and unique. Only the range of calls in which the budget runs out is put in order.
    """
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in TOKENS), F.lit(0))
    rows = usage.select(F.col(order).alias("at"), tokens.alias("tokens"))
    sums = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    target = F.lit(budget).cast("bigint")
    first = first_reaching(rows, "at", "tokens", target)
    # two one-row tables at most, put side by side
    both = sums.unionByName(first, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("total_tokens", "at", "reached")]
    )
    return both.select(
        target.alias("budget"),
        "total_tokens",
        (F.col("total_tokens") >= target).alias("budget_exceeded"),
        F.col("at").alias("first_call"),
        F.col("reached").alias("tokens_then"),
    )


def space_tokens(text: Column) -> Column:
    """Rough token count: pieces between single blanks, times 1.5."""
    return F.size(F.split(text, " ")) * 1.5


def token_throughput(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(tokens / F.nullif(seconds, F.lit(0).cast("double")))


def throughput_report(log: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Sums over a log of (total_gen_tokens, total_elapsed_time, avg_speed, total_requests) and means of other fields.

    Speed is tokens over seconds, or the mean of the logged speeds when no time was logged.
    """
    requests = [c for c in ("total_requests", "request_count", "num_requests") if c in log.columns]
    n = F.coalesce(*[F.col(c) for c in requests]) if requests else F.lit(None)
    out = log.agg(
        F.coalesce(F.sum("total_gen_tokens"), F.lit(0)).cast("double").alias("total_gen_tokens"),
        F.coalesce(F.sum("total_elapsed_time"), F.lit(0.0)).alias("total_elapsed_time"),
        F.avg("avg_speed").alias("_speed"),
        F.sum(n.cast("double")).alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(c).alias(f"avg_{c}") for c in extra or []],
    ).where("_rows > 0")
    t = F.col("total_elapsed_time")
    return out.select(
        "total_gen_tokens",
        "total_elapsed_time",
        F.when(t > 0, F.try_divide(F.col("total_gen_tokens"), t)).otherwise(F.coalesce("_speed", F.lit(0.0))).alias("avg_speed"),
        F.when(F.col("_n") > 0, F.try_divide(t, F.col("_n"))).alias("avg_latency"),
        *[f"avg_{c}" for c in extra or []],
    )


def sample_score(df: DataFrame, score_key: str = "score") -> Column:
    """First numeric of: score_key, score, acc, accuracy, exact_match, any *_score; structs give their `score`."""
    types = dict(df.dtypes)

    def number(name: str) -> Column | None:
        t = types.get(name)
        if t in ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean") or (t or "").startswith("decimal"):
            return F.col(name).cast("double")
        if t and t.startswith("struct<") and "score" in df.select(f"{name}.*").columns:
            return F.col(name)["score"].try_cast("double")
        return None

    names = [score_key, "score", "acc", "accuracy", "exact_match"] + [c for c in df.columns if c.endswith("_score")]
    found = [c for c in (number(n) for n in names) if c is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def efficiency_report(samples: DataFrame, score_key: str = "score") -> DataFrame:
    """Per task and overall: documents, tokens, positive score, output tokens per document and per correct answer.

    samples: one row per document with `task`, `token_counts` array<struct<input_tokens, output_tokens>> and scores.
    """
    known = F.filter("token_counts", lambda t: t.isNotNull())
    has = F.coalesce(F.size(known), F.lit(0)) > 0

    def side(field: str) -> Column:
        parts = F.transform(known, lambda t: F.coalesce(t[field], F.lit(0)).cast("double"))
        return F.when(has, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))

    score = sample_score(samples, score_key)
    rows = samples.select(
        "task",
        has.cast("int").alias("has"),
        side("input_tokens").alias("i"),
        side("output_tokens").alias("o"),
        F.when(score > 0, score).alias("s"),
    )
    cell = rows.groupBy("task").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("has").alias("has"), F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("s").alias("s")
    )
    out = cell.groupingSets([[], ["task"]], "task").agg(
        F.grouping_id().alias("_g"),
        F.sum("docs").cast("double").alias("docs"),
        F.coalesce(F.sum("has"), F.lit(0)).cast("double").alias("docs_with_token_counts"),
        F.coalesce(F.sum("i"), F.lit(0.0)).alias("total_input_tokens"),
        F.coalesce(F.sum("o"), F.lit(0.0)).alias("total_output_tokens"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_correct_score"),
    )
    o = F.col("total_output_tokens")
    return out.where("docs > 0").select(
        F.when(F.col("_g") == 1, "overall").otherwise("task").alias("level"),
        "task",
        "docs",
        "docs_with_token_counts",
        "total_input_tokens",
        "total_output_tokens",
        (F.col("total_input_tokens") + o).alias("total_tokens"),
        "total_correct_score",
        F.coalesce(F.try_divide(o, F.col("docs_with_token_counts")), F.lit(0.0)).alias("avg_output_tokens_per_sample"),
        F.try_divide(o, F.col("total_correct_score")).alias("tokens_per_correct_answer"),
    )
