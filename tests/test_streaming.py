"""Live results: files that arrive while the stream runs."""

import json

from pyspark.sql import functions as F

from tallyframe.session import scratch_path
from tallyframe.sources import records as A
from tallyframe.streaming import live as L


def line(seq, doc, acc, cls="c", task="t"):
    return json.dumps({"sequence": seq, "task_name": task, "doc_id": doc, "prediction": "p", "metrics": {"oos_score": {"question_class": cls, "accuracy": acc, "parsed": True}}})


def newest(spark, out):
    df = spark.read.parquet(out)
    top = df.agg(F.max("batch")).first()[0]
    return {(r.task_name, r.question_class): (r.n, r.accuracy) for r in df.where(F.col("batch") == top).collect()}


def test_counts_follow_new_files(spark, tmp_path):
    src, out, state = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "rank0.jsonl").write_text(line(0, "a", 1.0) + "\n" + line(1, "b", 0.0) + "\n")

    def run():
        L.write_versions(L.live_accuracy(A.stream_live_results(spark, str(src))), out, state, once=True).awaitTermination()
        return newest(spark, out)

    assert run() == {("t", "c"): (2, 0.5)}
    (src / "rank1.jsonl").write_text(line(0, "c", 1.0) + "\nnot json\n" + line(1, "d", 1.0, "e") + "\n")
    assert run() == {("t", "c"): (3, 2 / 3), ("t", "e"): (1, 1.0)}


def test_repeats_count_once(spark, tmp_path):
    src, out = tmp_path / "live", str(tmp_path / "out")
    src.mkdir()
    for rank in range(3):
        (src / f"rank{rank}.jsonl").write_text("".join(line(i, d, 1.0) + "\n" for i, d in enumerate("aab")))
    stream = L.dedupe_live(A.stream_live_results(spark, str(src), files_per_trigger=1))
    L.write_versions(stream, out, str(tmp_path / "state"), mode="append", once=True).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_repeats_within_a_delay(spark, tmp_path):
    src, out = tmp_path / "live", str(tmp_path / "out")
    src.mkdir()
    (src / "a.jsonl").write_text(line(0, "a", 1.0) + "\n" + line(1, "a", 1.0) + "\n" + line(2, "b", 1.0) + "\n")
    stream = A.stream_live_results(spark, str(src)).withColumn("ts", F.timestamp_seconds("sequence"))
    stream = L.dedupe_live(stream, "ts", "1 hour")
    L.write_versions(stream, out, str(tmp_path / "state"), mode="append", once=True).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_scratch_folder_follows_the_session(spark):
    first = scratch_path(spark, "x")
    assert first.startswith(spark.conf.get("spark.checkpoint.dir")) and first != scratch_path(spark, "x")


def test_appended_lines_arrive_once(spark, tmp_path, monkeypatch):
    """Lines appended between triggers, a half-written one, a restart from the checkpoint, ranges inside a file."""
    from tallyframe.sources import growing

    monkeypatch.setattr(growing, "RANGE", 500)
    src, out, state = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def run(closed=False):
        stream = A.stream_live_results(spark, str(src), closed=closed)
        L.write_versions(stream, out, state, mode="append", once=True).awaitTermination()
        return sorted(r.doc_id for r in spark.read.parquet(out).collect())

    def append(name, text):
        with open(src / name, "a") as f:
            f.write(text)

    first = [f"a{i:03d}" for i in range(40)]
    append("rank0.jsonl", "".join(line(0, d, 1.0) + "\n" for d in first))
    append("rank1.jsonl", line(0, "b", 1.0)[:20])
    assert run() == first
    append("rank1.jsonl", line(0, "b", 1.0)[20:] + "\r\n\nbroken\n" + line(1, "c", 1.0))
    append("rank0.jsonl", line(9, "d", 1.0) + "\n")
    append("_hidden", line(9, "x", 1.0) + "\n")
    assert run() == sorted([*first, "b", "d"])
    assert run() == sorted([*first, "b", "d"])
    append("rank2.jsonl", line(0, "é" * 300, 1.0) + "\n" + line(1, "e", 1.0))
    assert run(closed=True) == sorted([*first, "b", "c", "d", "e", "é" * 300])
    whole = spark.read.text([str(p) for p in src.glob("rank*")]).where("value like '{%'").count()
    assert spark.read.parquet(out).count() == whole


def test_cut_files_are_an_error(spark, tmp_path):
    import pytest

    src, out, state = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.jsonl").write_text(line(0, "a", 1.0) + "\n" + line(1, "b", 1.0) + "\n")
    run = lambda: L.write_versions(A.stream_live_results(spark, str(src)), out, state, mode="append", once=True).awaitTermination()
    run()
    (src / "a.jsonl").write_text(line(0, "a", 1.0) + "\n")
    with pytest.raises(Exception, match="cut or removed"):
        run()


def test_state_shrinks_after_its_time(spark, tmp_path):
    import time

    src, out, state = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:

        def run(docs):
            with open(src / "rank0.jsonl", "a") as f:
                f.write("".join(line(0, d, 1.0) + "\n" for d in docs))
            query = L.write_versions(L.dedupe_live(A.stream_live_results(spark, str(src)), ttl_seconds=3), out, state, mode="append", once=True)
            query.awaitTermination()
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            return sorted(r.doc_id for r in spark.read.parquet(out).collect()), held[-1]

        first = [f"d{i:02d}" for i in range(30)]
        got, held = run(first + first[:5])
        assert got == first and held >= 30
        time.sleep(4)
        got, held = run(["new", "new", "d00"])
        assert got == sorted([*first, "d00", "new"]) and held <= 5
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
