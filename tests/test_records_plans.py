"""Hand-worked cases of records, requests, validation, media plans and sources."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import media as D
from tallyframe.operators import questions as Q
from tallyframe.operators import validation as B
from tallyframe.schemas import QUESTION
from tallyframe.sources import records as A


def record(**over):
    base = {
        "doc_id": "d1",
        "trajectory_id": "t1",
        "mode": "multi_turn",
        "video_id": "P01-20240202-110250",
        "video_path": "P01-20240202-110250.mp4",
        "query_time_sec": 23.0,
        "steps": [
            {"step": 1, "step_question_class": "a", "question": "q1", "choices": ["x", "y"], "correct_idx": 0},
            {"step": 2, "branch_group": "branch", "question": "q2", "choices": ["x", "y"], "correct_idx": 0, "acceptable_idxs": []},
        ],
    }
    return {**base, **over}


def load(spark, tmp_path, rows, **kw):
    p = tmp_path / "q.jsonl"
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return A.read_questions(spark, str(p), **kw)


def errors(spark, tmp_path, *rows, listing=None):
    df = load(spark, tmp_path, rows, keep_raw=True)
    df = df.withColumn("record", F.coalesce("doc_id", "video_path"))
    return sorted(r.error for r in B.validate_questions(df, listing).collect())


def test_validation(spark, tmp_path):
    assert errors(spark, tmp_path, record()) == []
    bad = record()
    bad["steps"][0]["correct_idx"] = 2
    assert errors(spark, tmp_path, bad) == ["steps[0]: correct_idx must index choices (zero-based)"]
    twice = record()
    twice["steps"][1]["step"] = " 1"
    assert errors(spark, tmp_path, twice) == ["steps[1]: missing or duplicate step identifier"]
    skipped = record()
    skipped["steps"][1].update(step=1, skipped=True, question=None)
    assert errors(spark, tmp_path, skipped) == []
    again = record()
    again["steps"][0].update(skipped=True)
    again["steps"][1].update(step=1)
    assert errors(spark, tmp_path, again) == []
    one = {"id": "s", "video_path": "v.mp4", "query_time_sec": 0, "question": "q", "answer": "a"}
    assert errors(spark, tmp_path, one) == []
    assert errors(spark, tmp_path, {**one, "answer": ""}) == ["question: missing target_text or answer"]
    assert errors(spark, tmp_path, {**one, "choices": ["a", 2], "correct_idx": 0}) == ["question: choices must be a list of strings"]
    assert errors(spark, tmp_path, {**one, "choices": ["a"], "correct_idx": 0.5})[-1].startswith("record is not readable")
    listing = spark.createDataFrame([("w.mp4",)], "path string")
    assert errors(spark, tmp_path, one, listing=listing) == ["video does not exist: v.mp4"]
    (tmp_path / "e").mkdir()
    assert errors(spark, tmp_path / "e") == ["Dataset contains no records."]


def test_expand(spark, tmp_path):
    rows = Q.prepare_questions(load(spark, tmp_path, [record(), {"id": "s", "question": "q", "video_path": "v", "correct_idx": 1}])).collect()
    by = {r.id: r for r in rows}
    assert sorted(by) == ["d1__step_1", "d1__step_2", "s"]
    two = by["d1__step_2"]
    assert (two.branch_group, two.trajectory_id, two.step, two.question_class) == ("branch", "t1", "2", "unknown")
    assert (by["s"].mode, by["s"].question_class, by["s"].answer_idx) == ("single_turn", "unknown", 1)


def test_corrupt_lines_stay(spark, tmp_path):
    df = load(spark, tmp_path, [record(), '{"doc_id": '])
    assert df.where("_corrupt_record is not null").select("split").collect()[0][0] == "test"


def test_paths(monkeypatch):
    monkeypatch.setenv("SOME_ROOT", "/x")
    assert A.expand_path("$SOME_ROOT/a") == "/x/a"
    with pytest.raises(ValueError, match="NOT_SET_ANYWHERE"):
        A.expand_path("${NOT_SET_ANYWHERE}/a")


def test_video_ids(spark):
    a = spark.createDataFrame([("P01-20240202-110250", None), ("P01-20240202-110250", "P01-20240202-110250.mp4")], "video_id string, video_path string")
    b = spark.createDataFrame([("P02-20240209-184316",), ("P01-20240202-110250",)], "video_id string")
    assert [r[0] for r in B.select_video_ids([a, b]).collect()] == ["P01-20240202-110250", "P02-20240209-184316"]
    c = spark.createDataFrame([("P01-20240202-110250", "../outside.mp4")], "video_id string, video_path string")
    with pytest.raises(Exception, match="expected flat"):
        B.select_video_ids([c]).collect()
    with pytest.raises(Exception, match="none"):
        B.require_rows(b.where("false"), "none").collect()


def test_prompt(spark):
    df = spark.createDataFrame(
        [("When was the cup last visible?", ["00:00:01", "00:00:02"], None), ("Where?", [], "oos_step2_last_visible"), ("Who?", None, "x")],
        "question string, choices array<string>, step_question_class string",
    )
    a, b, c = [r[0] for r in df.select(Q.question_block()).collect()]
    assert a == "Question: When was the cup last visible?\nOptions:\nA. 00:00:01\nB. 00:00:02\nSelect the best option and output only its letter."
    assert b.startswith("Question: Where?\nEstimate the requested event time") and b.endswith("Point=(0.45, 0.62)")
    assert c == "Question: Who?\nAnswer briefly and directly."


def test_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    pick = lambda **k: sorted(r.i for r in Q.slice_docs(df, "i", **k).collect())
    assert pick(offset=2, limit=5, shard=1, n_shards=2) == [3, 5]
    assert pick(limit=0.25) == [0, 1, 2]
    assert pick(limit=-1, n_shards=4) == [0, 4, 8]
    with pytest.raises(ValueError):
        Q.slice_docs(df, "i", limit=-2)


def test_windows(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([9],)], "t array<int>")
    got = [(r.input, r.target) for r in Q.rolling_windows(df, "t", 3, 1, 0).collect()]
    assert got == [([0, 1, 2], [1, 2, 3]), ([2, 3, 4], [4, 5]), ([0], [9])]
    got = [(r.input, r.target) for r in Q.rolling_windows(df, "t", 3, 1, 0, disjoint=True).collect()]
    assert got == [([0], [1, 2, 3]), ([2, 3], [4, 5]), ([0], [9])]


def rolling_by_loop(tokens, prefix, max_len, context):
    """Restatement: the first window predicts everything it holds, each later one max_len - context + 1 more tokens."""
    out, done = [], 0
    while done < len(tokens):
        size = max_len if not done else max_len - context + 1
        end = min(done + size, len(tokens))
        source = ([prefix] + tokens)[max(end - max_len, 1 if done else 0) : end] if done else ([prefix] + tokens)[:end]
        out.append((source, tokens[done:end]))
        done = end
    return out


def test_windows_against_a_loop(spark):
    rows = [(list(range(1, n + 1)), m, c) for n in (1, 2, 5, 9, 17) for m in (1, 2, 4, 7) for c in range(1, m + 1)]
    for m, c in {(m, c) for _, m, c in rows}:
        df = spark.createDataFrame([(t,) for t, mm, cc in rows if (mm, cc) == (m, c)], "t array<int>")
        got = {}
        for r in Q.rolling_windows(df, "t", m, c, 0).collect():
            got.setdefault(tuple(r.t), []).append((r.window, r.input, r.target))
        for t, ws in got.items():
            assert [(a, b) for _, a, b in sorted(ws)] == rolling_by_loop(list(t), 0, m, c), (t, m, c)


def test_fewshot(spark):
    pool = spark.createDataFrame([(str(i), i, f"s{i}") for i in range(6)], "id string, order int, shot string")
    rows = pool.select("id")
    got = {r.id: r.context for r in Q.fewshot_context(rows, pool, 2, "first", delimiter=";", same_split=True).collect()}
    assert got["0"] == "s1;s2;" and got["5"] == "s0;s1;"
    with pytest.raises(Exception, match="fewer are available"):
        Q.fewshot_context(rows, pool, 9, "first").collect()
    for k in (1, 3, 5):
        out = Q.fewshot_context(rows, pool, k, seed=3, delimiter=";", same_split=True).collect()
        again = {r.id: r.context for r in Q.fewshot_context(rows.repartition(3), pool, k, seed=3, delimiter=";", same_split=True).collect()}
        for r in out:
            shots = r.context.split(";")[:-1]
            assert len(set(shots)) == k and f"s{r.id}" not in shots and again[r.id] == r.context


VISUAL = (
    "id string, step string, video_path string, query_time_sec double, step_question_class string, target_reference_image_path string, "
    "target_reference_steps array<string>, answer_metadata struct<object_y_normalized_projected_pixel:array<double>>"
)


def test_visuals(spark):
    rows = [
        ("a", "2", "v.mp4", 23.0, "x", "ref.png", ["2"], None),
        ("b", "3", "v.mp4", 23.0, "x", "ref.png", ["2"], None),
        ("c", "3", "v.mp4", 23.0, "oos_branch_object_object_distance", None, None, ([0.25, 0.75],)),
        ("d", "3", "v.mp4", 23.0, "oos_branch_object_object_distance", None, None, ([0.25, 1.75],)),
    ]
    df = spark.createDataFrame(rows, VISUAL)

    def plan(**k):
        return {r.id: [(v.kind, v.path) for v in r.visuals] for r in D.visual_plan(df, **k).collect()}

    assert plan()["a"] == [("clip", "v.mp4"), ("image", "ref.png")]
    assert plan(position="before")["a"] == [("image", "ref.png"), ("clip", "v.mp4")]
    assert plan()["b"] == [("clip", "v.mp4")]
    with pytest.raises(ValueError):
        D.visual_plan(df, position="middle")
    last = {r.id: r.visuals[0] for r in D.visual_plan(df, "last_frame").collect()}
    assert (last["c"].end_time, last["c"].marker_x, last["c"].marker_y) == (23.0, 0.25, 0.75)
    assert last["d"].marker_x is None and last["a"].end_time == 23.0
    clip = {r.id: r.visuals[0] for r in D.visual_plan(df).collect()}
    assert (clip["c"].end_time, clip["c"].marker_time) == (24.0, 23.0)


def test_manifest(spark):
    paths = ["Videos/P01/a.mp4", "Videos/P02/b.MP4", "Videos/P03/c.mp4", "VRS/P01/a.vrs", "Videos/P01/a.txt", "readme.mp4"]
    text = spark.createDataFrame([(f"m{i}  ./{p}",) for i, p in enumerate(paths)] + [("  ",)], "value string")
    ok, bad = A.parse_manifest(text)
    assert bad.count() == 0 and ok.count() == 6
    people = spark.createDataFrame([("P01",), ("P02",), ("P09",)], "participant string")
    chosen, missing = D.select_manifest(ok, people)
    assert sorted(r.rel_path for r in chosen.collect()) == paths[:2]
    assert [r.participant for r in missing.collect()] == ["P09"]
    assert A.parse_manifest(spark.createDataFrame([("abc",), ("m /x",)], "value string"))[1].count() == 2


def frames_by_loop(n, src, fps, end=None):
    out, nxt = [], 0.0
    for i in range(n):
        if end is not None and i / src > end + 1e-6:
            break
        if i / src + 1e-6 >= nxt:
            out.append(i)
            nxt += 1.0 / fps
    return out


def test_rate_frames_against_a_loop(spark):
    cases = [(n, float(src), end) for n in (1, 7, 100, 301) for src in (1, 7, 24, 30, 60) for end in (None, 1.5, 3.0)]
    df = spark.createDataFrame(cases, "frames bigint, fps double, end_time double")
    for fps in (0.5, 1.0, 2.0, 100.0):
        for r in D.sample_frames(df, "rate", fps=fps, explode=False).collect():
            assert r.frame_indices == frames_by_loop(r.frames, r.fps, fps, r.end_time), (r, fps)


def test_other_frames(spark):
    df = spark.createDataFrame([(10, 3.0), (1, 30.0), (0, 30.0)], "frames bigint, fps double")
    got = [r.frame_indices for r in D.sample_frames(df, "uniform", n=4, explode=False).collect()]
    assert got == [[0, 3, 6, 9], [0, 0, 0, 0], []]
    assert D.sample_frames(df, "uniform", n=1, explode=False).first().frame_indices == [0]
    got = [r.frame_indices for r in D.sample_frames(df, "every", cap=2, explode=False).collect()]
    assert got == [[0, 9], [0], []]
    ts = spark.createDataFrame([([0, 3, 6], 3.0)], "i array<int>, f double").select(D.frame_timestamps(F.col("i"), F.col("f")))
    assert ts.first()[0] == [0.0, 1.0, 2.0, 2.0]


def test_marker_box(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0), (0.5, 0.503, -1.0)], "x double, y double, t double")
    a, b = D.marker_box(df, "x", "y", "t", 448, 448).collect()
    assert (a.left, a.top, a.start_time, a.stop_time) == (0, 440, 5.0, 6.0)
    assert (b.left, b.top, b.start_time) == (220, 221, 0.0)


def test_baseline_scores(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    lines = [
        {"doc_id": 1, "a_Score": 0.5},
        {"doc_id": 1, "a_Score": 0.25},
        {"doc_id": 2, "b_score": {"pred": " a", "target": "A"}},
        {"doc_id": None, "a_Score": 1},
        {"doc_id": 3, "target": "x", "filtered_resps": [["X"]]},
        {"doc_id": 4},
    ]
    p.write_text("\n".join(json.dumps(x) for x in lines))
    got = {r.doc_id: r.score for r in A.read_baseline_scores(spark, str(p)).collect()}
    assert got == {"1": 0.25, "2": 1.0, "3": 1.0}


def test_calibration_files(spark, tmp_path):
    good = {"cameras": {"camera-rgb": {"image_size": [4, 4], "projection_params": [1.0, 2.0, 3.0], "valid_radius": 2.0}}}
    for vid, body in (("P01-a", good), ("P02-b", {"cameras": {"camera-rgb": {**good["cameras"]["camera-rgb"], "valid_radius": None}}})):
        folder = tmp_path / vid[:3] / vid
        folder.mkdir(parents=True)
        (folder / "device_calibration.json").write_text(json.dumps(body, indent=1))
    ids = spark.createDataFrame([("P01-a",), ("P02-b",), ("P03-c",)], "video_id string")
    got = {r.video_id: r.error for r in B.validate_calibration(spark, str(tmp_path), ids).collect()}
    assert got == {"P02-b": "invalid camera-rgb geometry", "P03-c": "missing camera calibration"}


def test_many_small_files_are_written_and_listed_by_many_folders_per_task(spark, tmp_path, monkeypatch):
    """Files and folders are dealt over tasks: not all files in one task, not a task for each folder."""
    import re

    from tallyframe.plans import QUERIES, source_queries

    root = tmp_path / "scratch"
    monkeypatch.setattr(source_queries, "scratch_path", lambda _, label: f"{root}/{label}-1")
    spark.range(1000, numPartitions=1).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    context = spark.sparkContext
    context.setJobGroup("calibration", "calibration")
    try:
        df = QUERIES["validate_calibration"](spark, str(tmp_path))
        jobs = context.statusTracker().getJobIdsForGroup("calibration")
        got = df.groupBy("error").count().collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r["error"]: r["count"] for r in got} == {"missing camera calibration": 200, "invalid camera-rgb geometry": 400}
    files = [f.name for f in root.glob("calibration-*/*/*/part-*.txt")]
    assert len(files) == 800
    assert len({re.match(r"part-(\d+)", f).group(1) for f in files}) > 1
    stages = [s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
    assert max(context.statusTracker().getStageInfo(s).numTasks for s in stages) <= A.LISTING_TASKS


def test_schema_is_complete():
    assert {"steps", "_corrupt_record", "answer_metadata"} <= set(QUESTION.fieldNames())
