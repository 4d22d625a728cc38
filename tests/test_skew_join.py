"""The runtime skew join must really split a hot key: nothing after the join may pin its partitioning."""

import pytest
from pyspark.sql import functions as F

from tallyframe import ordering
from tallyframe.operators import reports as R
from tallyframe.operators import reuse as J
from tallyframe.operators import scoring as S

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def splits(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=60_000):
    """A third of all rows under one key."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 5000).cast("string")))
    return spark.range(0, n, 1, 8).select(key.alias("trajectory_id"), i.cast("string").alias("step"), i)


def test_trajectories(spark, small_limits):
    df = hot(spark).select(
        "*", F.lit("multi_turn").alias("mode"), F.lit(True).alias("scorable"), (F.xxhash64("id") % 10 != 0).cast("double").alias("accuracy")
    )
    assert splits(R.trajectory_rows(df))


def test_order_statistics(spark, small_limits):
    assert splits(ordering.global_rank(hot(spark), ["trajectory_id"], "id"))


def test_lookup(spark, small_limits):
    asked = hot(spark).select(F.col("id").alias("request_id"), F.col("trajectory_id").alias("cache_key"), F.lit(True).alias("deterministic"))
    log = asked.select(
        "cache_key", "deterministic", F.lit("r").alias("response"), F.lit("generate_until").alias("request_type"), F.lit("t").alias("task_name"),
        F.lit("d").alias("doc_id"), F.lit(0).alias("idx"), F.lit("{}").alias("gen_kwargs"), F.col("request_id").cast("double").alias("created_at"),
    )
    table = J.store_responses(log.where("false"), log)
    assert splits(J.reuse_responses(asked, table))


def test_scoring(spark, small_limits, tmp_path):
    r = hot(spark).select(F.lit("t").alias("task"), F.col("trajectory_id").alias("doc_id"), F.concat(F.lit("A "), F.sha2("step", 256)).alias("prediction"))
    meta = "struct<sampled_last_visible_time_sec:double,last_placement_time_sec:double,normalized_projected_pixel:array<double>,acceptable_answer_metadata:array<struct<time_sec:double,normalized_projected_pixel:array<double>,reference_source:string>>>"
    q = r.select("task", "doc_id").distinct().select(
        "*",
        F.lit("c").alias("step_question_class"),
        F.array(F.lit("x"), F.lit("y")).alias("choices"),
        F.lit(0).alias("answer_idx"),
        F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("array<string>").alias("acceptable_answers"),
        F.lit(None).cast("array<int>").alias("acceptable_answer_idxs"),
        F.lit(None).cast(meta).alias("answer_metadata"),
    )
    q.write.parquet(str(tmp_path / "q"))
    q = spark.read.parquet(str(tmp_path / "q"))
    assert splits(S.score_responses(q, r).select("accuracy"))


def test_contamination_with_boilerplate(spark, small_limits):
    from tallyframe.operators import contamination as C

    same = " ".join(f"w{i}" for i in range(13))
    q = hot(spark, 30_000).select("id", F.when(F.col("id") % 10 > 0, same).otherwise(F.concat_ws(" ", F.lit("own"), "step")).alias("query"))
    docs = spark.range(50).select(F.lit(same + " end").alias("text"))
    out = C.split_contamination(q, docs, ["id"])
    assert splits(out)
    assert out.where("subset = 'only_contamination'").count() == 27_000
