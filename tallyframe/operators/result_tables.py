"""Long result tables and flat sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KEYS = ["task", "filter", "metric"]
STATISTICS = [
    "stderr",
    "stderr_clt",
    "stderr_clustered",
    "expected_accuracy",
    "consensus_accuracy",
    "internal_variance",
    "consistency_rate",
]
PAIRED = ["paired_baseline", "paired_baseline_score", "paired_diff", "paired_ci_lower", "paired_ci_upper", "paired_pvalue"]


def results_long(
    values: DataFrame,
    statistics: list[DataFrame] | None = None,
    tasks: DataFrame | None = None,
    baseline: DataFrame | None = None,
    directions: DataFrame | None = None,
) -> DataFrame:
    """One row per (task, filter, metric): value, samples, every statistic, task fields and baseline fields.

    statistics: long tables (task, filter, metric, statistic, value), pivoted over the fixed list. tasks: (task, alias,
    version, n_shot). All difference columns are in percent points.
    """
    out = values
    if statistics:
        long = reduce(DataFrame.unionByName, [s.select(*KEYS, "statistic", "value") for s in statistics])
        wide = long.groupBy(*KEYS).pivot("statistic", STATISTICS).agg(F.max("value"))
        out = out.join(wide, KEYS, "left")
    if tasks is not None:
        out = out.join(tasks, "task", "left")
    if directions is not None:
        out = out.join(directions, ["task", "metric"], "left")
    if baseline is not None:
        out = out.join(baseline.select("task", *[c for c in PAIRED if c in baseline.columns]), "task", "left")
    return out


def statistic_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Wide statistics (one column each) as long rows."""
    parts = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*KEYS, F.explode(parts).alias("s")).select(*KEYS, "s.statistic", "s.value")


def results_flat(results: DataFrame) -> DataFrame:
    """(key, value, text): `task/metric` keys without the `,none` suffix, numbers and texts apart.

    results: (task, name, value as string), name like "acc,none".
    """
    name = F.regexp_replace("name", r",none$", "")
    number = F.col("value").try_cast("double")
    return results.select(
        F.concat("task", F.lit("/"), name).alias("key"),
        number.alias("value"),
        F.when(number.isNull(), F.col("value")).alias("text"),
    )


def assemble_samples(requests: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row per (task, doc_id): responses, filtered responses and token counts ordered by (idx, repeat).

    A question holds its choices times its repeats, both given by the task configuration. Requests with a column
    `conditional` (mutual information asks twice) have the conditional ones first; no request is merged with another.
    """
    told = [(~F.col("conditional")).alias("unconditional")] if "conditional" in requests.columns else []
    item = F.struct(*told, "idx", "repeat", "response", "filtered", "token_counts")
    rows = requests.groupBy("task", "doc_id").agg(
        F.array_sort(F.collect_list(item)).alias("_r"), F.first("target", ignorenulls=True).alias("target")
    )
    out = rows.select(
        "task",
        "doc_id",
        "target",
        F.transform("_r", lambda r: r["response"]).alias("resps"),
        F.transform("_r", lambda r: r["filtered"]).alias("filtered_resps"),
        F.transform("_r", lambda r: r["token_counts"]).alias("token_counts"),
    )
    return out if scores is None else out.join(scores, ["task", "doc_id"], "left")


def samples_flat(samples: DataFrame, output_type: str, metrics: list[str], membership: DataFrame | None = None) -> DataFrame:
    """Flat sample table: id, data, input_len, labels, output_type, raw and filtered predictions, metrics.

    multiple_choice rows need `losses`, `filtered_losses` and `choices` arrays; the smallest loss is the predicted choice
    (as in the scores). loglikelihood rows need `ll`, `is_greedy` and `continuation`.
    """
    data = F.col("input")
    cols = {"id": F.col("doc_id"), "data": data, "input_len": F.length(data), "labels": F.col("target").cast("string")}
    cols["output_type"] = F.lit(output_type)
    if output_type == "multiple_choice":

        def at_min(a: str) -> Column:
            return (F.array_position(a, F.array_min(a)) - 1).cast("string")

        cols["choices"] = F.array_join(
            F.transform("choices", lambda c, i: F.concat(i.cast("string"), F.lit(". "), c)), "\n"
        )
        cols["raw_predictions"], cols["filtered_predictions"] = at_min("losses"), at_min("filtered_losses")
    elif output_type == "loglikelihood":
        said = F.concat(
            F.lit("log probability of continuation is "),
            F.col("ll").cast("string"),
            F.when(F.col("is_greedy"), " \n\ncontinuation will be generated with greedy sampling").otherwise(
                " \n\ncontinuation will not be generated with greedy sampling"
            ),
        )
        cols["labels"] = F.col("continuation")
        cols["raw_predictions"] = cols["filtered_predictions"] = said
    else:
        cols["raw_predictions"] = F.get("resps", F.lit(0)).cast("string")
        cols["filtered_predictions"] = F.get("filtered_resps", F.lit(0)).cast("string")
    out = samples.select("task", *[c.alias(n) for n, c in cols.items()], *metrics)
    return out if membership is None else out.join(membership, "task", "left")


def sample_record(samples: DataFrame) -> DataFrame:
    """The form in which samples are written: `input` is the first argument, lists of one are unwrapped, resps are left
    out where they equal the filtered ones, the target is text; arguments and doc are dropped."""

    def unwrapped(c: str) -> Column:
        return F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.to_json(c))

    raw, kept = unwrapped("resps"), unwrapped("filtered_resps")
    out = samples
    if "arguments" in samples.columns:
        out = out.withColumn("input", F.get("arguments", F.lit(0)))
    inner = F.get(F.from_json(raw, "array<string>"), F.lit(0))
    single = F.size(F.from_json(raw, "array<string>")) == 1
    same = raw.eqNullSafe(kept) | F.coalesce(single & (inner == kept), F.lit(False))
    return out.withColumns(
        {
            "resps": F.when(~same, raw),
            "filtered_resps": kept,
            "target": F.col("target").cast("string"),
        }
    ).drop("arguments", "doc")


# <model folder>/<date>_results.json and <model folder>/<date>_samples_<task>.jsonl; the date may hold underscores
RESULT_NAME = r"([^/]+)/([^/]+)_results\.json$"
SAMPLE_NAME = r"([^/]+)/([^/]+?)_samples_([^/]+)\.jsonl$"


def latest_runs(listing: DataFrame, path: str = "path") -> DataFrame:
    """(model, kind, task, date, path, latest) of result and sample files; dates compare as text.

    A results file is the latest when its date is the newest sample date of its model.
    """
    p = F.col(path)
    is_sample = F.rlike(p, F.lit(SAMPLE_NAME))
    rows = listing.where(is_sample | F.rlike(p, F.lit(RESULT_NAME))).select(
        F.when(is_sample, F.regexp_extract(p, SAMPLE_NAME, 1)).otherwise(F.regexp_extract(p, RESULT_NAME, 1)).alias("model"),
        F.when(is_sample, "samples").otherwise("results").alias("kind"),
        F.when(is_sample, F.regexp_replace(F.regexp_extract(p, SAMPLE_NAME, 3), r"(?U)\W", "_")).otherwise("results").alias("task"),
        F.when(is_sample, F.regexp_extract(p, SAMPLE_NAME, 2)).otherwise(F.regexp_extract(p, RESULT_NAME, 2)).alias("date"),
        p.alias("path"),
    )
    samples = rows.where("kind = 'samples'")
    per_task = samples.groupBy("model", "task").agg(F.max("date").alias("newest"))
    per_model = samples.groupBy("model").agg(F.max("date").alias("newest")).withColumn("task", F.lit("results"))
    newest = per_task.unionByName(per_model)
    return rows.join(newest, ["model", "task"], "left").withColumn(
        "latest", F.coalesce(F.col("date") == F.col("newest"), F.lit(False))
    ).drop("newest")
