"""Stored responses that grow by batches."""

import os

from pyspark.sql import functions as F

from tallyframe.operators import reuse as J
from tallyframe.schemas import AUDIT
from tallyframe.sources.response_store import ResponseStore


def rows(spark, keys, made, response="r", **other):
    values = {"request_type": "generate_until", "task_name": "t", "doc_id": "d", "idx": 0, "gen_kwargs": "{}", "deterministic": True} | other
    data = [{"cache_key": k, "response": f"{response}{k}" if k != "blank" else " ", "created_at": made} | values for k in keys]
    return spark.createDataFrame([tuple(r.get(f.name) for f in AUDIT.fields) for r in data], AUDIT)


def content(df):
    return sorted((r.cache_key, r.response, r.created_at) for r in df.collect())


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names}


def test_only_touched_parts_are_written(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    first, late = rows(spark, [f"k{i}" for i in range(3000)], 1.0), rows(spark, [f"k{i}" for i in range(0, 90, 9)] + ["new", "blank", None], 2.0, "s")
    assert len(store.add(first)) == 256
    before = files(tmp_path / "s" / "data")
    parts = {r[0] for r in late.where("cache_key <> 'blank'").select(F.substring(F.md5(F.col("cache_key").cast("binary")), 1, 2)).collect()}
    assert set(store.add(late)) == parts and len(parts) <= 11
    after = files(tmp_path / "s" / "data")
    assert before.items() <= after.items()  # nothing that was there is written again
    made = {p.split("part=")[1][:2] for p in after.keys() - before.keys() if "part=" in p}
    assert made == parts
    want = J.store_responses(J.store_responses(first.where("false"), first), late.where("cache_key is not null"))
    assert content(store.read()) == content(want)
    assert store.add(rows(spark, ["blank"], 3.0)) == [] and store.add(first.where("false")) == []
    assert store.vacuum() == len(parts) and content(store.read()) == content(want)
    assert content(ResponseStore(spark, str(tmp_path / "s")).read()) == content(want)


def test_failed_batch_leaves_the_table(spark, tmp_path, monkeypatch):
    store = ResponseStore(spark, str(tmp_path / "s"), digits=1)
    store.add(rows(spark, ["a", "b"], 1.0))
    with monkeypatch.context() as m:
        m.setattr(store, "_write_state", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            store.add(rows(spark, ["a", "c"], 2.0, "x"))
        except RuntimeError:
            pass
    assert content(store.read()) == [("a", "ra", 1.0), ("b", "rb", 1.0)]
    store.add(rows(spark, ["a", "c"], 2.0, "x"))
    assert content(store.read()) == [("a", "xa", 2.0), ("b", "rb", 1.0), ("c", "xc", 2.0)]


def test_stored_rows_stay_in_a_replay(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "s"), digits=1)
    store.add(rows(spark, ["a"], 5.0))
    log = rows(spark, ["a", "b"], 7.0, "late").unionByName(rows(spark, ["b", "", None], 6.0, "early")).unionByName(rows(spark, ["c"], 1.0, deterministic=False))
    store.replay(log)
    assert content(store.read()) == [("a", "ra", 5.0), ("b", "earlyb", 6.0)]
    assert content(store.read()) == content(J.replay_audit(rows(spark, ["a"], 5.0), log))
