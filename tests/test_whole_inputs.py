"""Deep groups, shifted scores, broken lines, missing options, single turns: cases that once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import filters
from tallyframe.operators import aggregates, questions, reports, result_tables, scoring, statistics
from tallyframe.sources import records


def test_groups_of_any_depth(spark):
    chain = [(f"g{i}", f"g{i + 1}") for i in range(12)] + [("g12", "leaf"), ("g0", "top")]
    got = aggregates.flatten_membership(spark.createDataFrame(chain, "parent string, child string")).collect()
    assert {(r.group, r.task) for r in got} == {(f"g{i}", "leaf") for i in range(13)} | {("g0", "top")}
    with pytest.raises(ValueError, match="cycle"):
        aggregates.flatten_membership(spark.createDataFrame([*chain, ("leaf", "g0")], "parent string, child string"))


def test_errors_do_not_cancel(spark):
    rows = [("t", float(i % 10) / 10, i % 50) for i in range(1000)]
    for shift in (0.0, 1e9):
        df = spark.createDataFrame([(t, x + shift, c) for t, x, c in rows], "task string, value double, c long")
        r = statistics.clustered_stderr(df, ["task"], "value", "c").first()
        if not shift:
            want = (r.stderr_clt, r.stderr_clustered)
        assert (r.stderr_clt, r.stderr_clustered) == pytest.approx(want, rel=1e-4) and r.mean == pytest.approx(shift + 0.45)
    assert want[0] == pytest.approx(0.0090875, rel=1e-4)


def test_t_distribution_is_continuous():
    below, above = (statistics.t_two_sided(2.5, d) for d in (9.9e6, 1.01e7))
    assert above == pytest.approx(below, rel=1e-6) and statistics.t_quantile(0.975, 2e7) == pytest.approx(1.959964, abs=1e-5)


def test_rows_of_a_log_do_not_depend_on_columns(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"cache_key": "a", "idx": 1}\n{"cache_key": "b", "idx": "text"}\n\nbroken\n')
    df = records.read_response_log(spark, str(tmp_path / "log.jsonl"))
    assert len(df.collect()) == df.select("cache_key").count() == df.count() == 1


def test_broken_lines_are_no_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "a", "mode": "single_turn", "question": "x"}\n{"id": \n')
    assert questions.prepare_questions(records.read_questions(spark, str(tmp_path / "q.jsonl"))).count() == 1


def test_filters_without_options(spark):
    df = spark.createDataFrame([(["it is: B"], []), (["it is: B"], ["x", "y"])], "r array<string>, o array<string>")
    got = [r[0] for r in df.select(filters.multi_choice_regex(F.col("r"), F.col("o"))).collect()]
    assert got[1] == ["(B)"] and got[0] != ["(B)"]


def test_requests_are_not_merged(spark):
    rows = [("t", 1, i, 0, "same", "same", 1, c, "x") for i in (0, 1) for c in (True, False)]
    df = spark.createDataFrame(rows, "task string, doc_id long, idx long, repeat long, response string, filtered string, token_counts long, conditional boolean, target string")
    assert result_tables.assemble_samples(df).first().resps == ["same"] * 4


def test_single_turns_have_no_trajectories(spark):
    rows = [("a", "single_turn", "c", True, 1.0, None, None, "v"), ("b", "single_turn", "c", True, 0.0, None, None, "v")]
    df = spark.createDataFrame(rows, "id string, mode string, question_class string, scorable boolean, accuracy double, step string, trajectory_id string, source_video_id string")
    assert reports.trajectory_report(df).count() == 0 and reports.step_report(df).count() == 0
    none = df.withColumn("scorable", F.lit(False))
    assert reports.trajectory_report(none).count() > 0 and reports.step_report(none).count() > 0


def test_moved_media(spark):
    df = spark.createDataFrame([("a", "/old/place/v 1.mp4"), ("b", None), ("c", "v2.mp4")], "id string, video_path string")
    got = {r.id: r.video_path for r in questions.moved_media(df, "/new/").collect()}
    assert got == {"a": "/new/v 1.mp4", "b": None, "c": "/new/v2.mp4"}


def test_generation_with_positions_as_targets(spark):
    df = spark.createDataFrame([("b", [1], ["a", "b"]), ("b", [0, 9], ["a", "b"])], "response string, gold array<long>, options array<string>")
    same = {"same": lambda p, t: (p == t).cast("double")}
    assert [r.same for r in scoring.score_generation(df, same, targets="gold", choices="options").collect()] == [1.0, 0.0]


def test_comparison_finds_the_score(spark):
    now = spark.createDataFrame([("t", i, (float(i % 2),)) for i in range(10)], "task string, doc_id long, score struct<score: double>")
    base = spark.createDataFrame([("t", i, 0.0) for i in range(10)], "task string, doc_id long, base double")
    r = statistics.compare_to_baseline(now, base, ["task"], None, "base", "old").first()
    assert r.paired_n == 10 and r.paired_diff == pytest.approx(50.0)


def test_large_group_trees_are_walked_by_joins(spark, monkeypatch):
    chain = [(f"g{i}", f"g{i + 1}") for i in range(5)] + [("g5", "leaf"), ("g2", "other")]
    small = sorted(map(tuple, aggregates.flatten_membership(spark.createDataFrame(chain, "parent string, child string")).collect()))
    monkeypatch.setattr(aggregates, "SMALL_TREE", 3)
    assert sorted(map(tuple, aggregates.flatten_membership(spark.createDataFrame(chain, "parent string, child string")).collect())) == small


def test_own_group_aggregations(spark):
    import pytest
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("a", "acc", "none", 0.2, 0.1, 10), ("b", "acc", "none", 0.8, 0.1, 30)], "task string, metric string, filter string, value double, stderr double, samples long")
    m = spark.createDataFrame([("g", "a"), ("g", "b")], "`group` string, task string")
    config = lambda name: spark.createDataFrame([("g", "acc", "none", True, name)], "`group` string, metric string, filter string, weight_by_size boolean, aggregation string")
    assert aggregates.group_report(r, m, config(None)).first()["value"] == pytest.approx(0.65)
    try:
        aggregates.register_group_aggregation("spread", lambda v, n, w: F.max(v) - F.min(v))
        assert aggregates.group_report(r, m, config("spread")).first()["value"] == pytest.approx(0.6)
        with pytest.raises(ValueError):
            aggregates.register_group_aggregation("spread", None)
    finally:
        aggregates.GROUP_AGGREGATIONS.pop("spread")
    with pytest.raises(Exception, match="not registered"):
        aggregates.group_report(r, m, config("spread")).collect()
