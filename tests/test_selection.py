"""Exact ranks by a sketch and a bracket: large, hot, tied and tiny keys, and how much work the plan does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import aggregates as A
from tallyframe.ordering import first_reaching, value_at


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    n = 400_000
    i = F.col("id")
    key = F.when(i % 10 < 7, "hot").when(i % 10 < 9, "tied").when(i % 1000 == 9, F.concat(F.lit("k"), (i % 7000).cast("string"))).otherwise("cold")
    value = F.when(key == "tied", F.floor(F.rand(3) * 5)).otherwise(F.pow(F.rand(5) * 2 - 1, F.lit(3.0)) * 1e6)
    folder = str(tmp_path_factory.mktemp("selection"))
    spark.range(0, n, 1, 16).select(key.alias("k"), value.cast("double").alias("x"), i.alias("o")).write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


def by_key(df):
    table = df.toPandas()
    return {k: g for k, g in table.groupby("k")}


def test_medians_are_exact(spark, rows):
    want = {k: np.sort(g.x.to_numpy())[len(g) // 2] for k, g in by_key(rows).items()}
    assert {r.k: r.median for r in A.median(rows, ["k"], "x").collect()} == want
    every = np.sort(rows.toPandas().x.to_numpy())
    assert A.median(rows, [], "x").first()["median"] == every[len(every) // 2]


def test_middle_rows_are_exact(spark, rows):
    want = {k: g.sort_values("o").x.to_numpy()[len(g) // 2] for k, g in by_key(rows).items()}
    assert {r.k: r.median for r in A.middle_row(rows, ["k"], "o", "x").collect()} == want


def test_other_ranks(spark, rows):
    for share in (0.0, 0.01, 0.9, 1.0):
        rank = F.greatest(F.lit(1), F.ceil(F.col("total") * share))
        want = {k: np.sort(g.x.to_numpy())[max(1, int(np.ceil(len(g) * share))) - 1] for k, g in by_key(rows).items()}
        assert {r.k: r.x for r in value_at(rows, ["k"], "x", share, rank).collect()} == want


def test_two_scans_and_four_exchanges(spark, rows):
    plan = A.median(rows, ["k"], "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2 and plan.count("Exchange ") <= 5 and plan.count("Window ") == 1


def test_running_weight(spark, rows):
    table = rows.toPandas().sort_values("o")
    weights = rows.withColumn("w", F.col("o") % 5)
    run = (table.o % 5).cumsum().to_numpy()
    for target in (1, 777, 400_000, int(run[-1])):
        at = int(np.argmax(run >= target))
        r = first_reaching(weights, "o", "w", F.lit(target)).first()
        assert (r.o, r.reached) == (table.o.iloc[at], run[at])
    assert first_reaching(weights, "o", "w", F.lit(int(run[-1]) + 1)).count() == 0
    assert first_reaching(weights.where("false"), "o", "w", F.lit(1)).count() == 0
