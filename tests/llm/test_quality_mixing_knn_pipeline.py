import re
from collections import defaultdict

import pytest
from odd_inputs import CLASHES, TEXTS, documents, odd_documents, words
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import knn_join, mixing, quality
from tallyframe.llm.common import stored, table
from tallyframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = QUERIES["op2_quality_machine"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id")
    r = scored.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).head()
    assert r.n > 80 and r.right > 0.96


def test_linear_time_score_is_the_pairwise_sum():
    import numpy as np

    rng = np.random.default_rng(0)
    w, v = rng.normal(size=20), rng.normal(size=(20, 4))
    slots, x = np.array([1, 5, 7, 19]), rng.normal(size=4)
    z = 0.3 + (w[slots] * x).sum() + sum(x[i] * x[j] * v[slots[i]] @ v[slots[j]] for i in range(4) for j in range(i))
    assert np.isclose(quality.Machine(0.3, w, v).score(slots, x, np.array([0]))[0], 1 / (1 + np.exp(-z)))


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1), (6, 0), (8, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.train(quality.labelled_sample(docs, labels))
    out = quality.score_quality(docs, model)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5,)}) == 1
    one_class = quality.train(quality.labelled_sample(docs, labels.where("quality = 1")))
    assert {r.predicted for r in quality.score_quality(docs, one_class).collect()} == {1}
    none = quality.train(quality.labelled_sample(docs, labels.limit(0)))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0


def water_level(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_mix(spark, make):
    docs = make(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    target = water_level({s: n for s, n in sizes.items() if n or True})
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert all(taken[s] == round(target[s]) for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    if make is documents:
        assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_have_the_words(spark):
    docs = documents(spark)
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(words(r.text))
    assert {i: n for i, n in want.items() if n} == dict(got)


def test_better_documents_come_first(spark):
    """Over many ids, heavier documents are chosen more often."""
    rows = [(i, ("abc " if i % 2 else "$$$ ") * 5, "s" if i < 2000 else "t") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = {r.odd: r.n for r in mixing.mix(df).where("source = 't'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()}
    assert share[1] > 2 * share[0]


def test_mix_is_native(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_top(vectors, asked, k):
    out = {}
    for q in asked:
        score = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(score)]
    return out


def test_knn_with_ties_common_vectors_and_odd_rows(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(knn_join, "CHUNK", 40)
    monkeypatch.setattr(knn_join, "GROUP", 6)
    monkeypatch.setattr(knn_join, "BLOCK", 4)
    monkeypatch.setattr(knn_join, "PIVOTS", 7)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 5)) * 3
    rows = [(i, (centre[i % 4] + rng.normal(size=5) * 0.2).tolist()) for i in range(300)] + [(i, [0.5] * 5) for i in range(300, 380)]
    bad = [(400, None), (410, [1.0, None, 0.0, 0.0, 0.0]), (420, [float("nan")] * 5), (430, [float("inf")] * 5), (440, []), (450, [1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").repartition(4)
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows}
    got = defaultdict(list)
    for r in knn_join.top_k(df, F.col("id") % 10 == 0, 10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_top(whole, [i for i in whole if i % 10 == 0], 10)
    assert {q: sorted(x) for q, x in got.items()} == want
    few = knn_join.top_k(df.where("vec_id < 4"), F.col("id") == 0, 10).collect()
    assert len(few) == 3
    assert knn_join.top_k(df.limit(0), F.col("id") == 0).count() == 0


def test_knn_of_large_vectors_and_of_each_length(spark):
    long = {i: [float(i), 1.0, -float(i)] for i in range(30)} | {i: [2.2e6 + i, 1.0, 1e5] for i in range(30, 40)}
    short = {i: [float(i % 7), 2.0] for i in range(100, 112)}
    df = spark.createDataFrame(list((long | short).items()), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in knn_join.top_k(df, F.col("id") % 10 == 0, 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = {}
    for part in (long, short):
        whole = {i: [int(1024 * x) for x in v] for i, v in part.items()}
        want |= brute_top(whole, [i for i in whole if i % 10 == 0], 5)
    assert {q: sorted(x) for q, x in got.items()} == want


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    good = stored(corpus_pipeline.keep_good(spark, docs, FOLDER), "t")
    kept = {r.doc_id for r in QUERIES["op2_quality_machine"](spark, FOLDER).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    first = stored(corpus_pipeline.keep_first_of_group(spark, good, FOLDER), "t")
    from test_ngram_join import brute

    groups = brute([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    safe = stored(corpus_pipeline.protect(spark, first, FOLDER), "t")
    from test_pii import base

    texts = {r.doc_id: r.text for r in first.collect()}
    for r in safe.collect():
        assert not base(r.text) and (base(texts[r.doc_id]) or r.text == texts[r.doc_id]) and r.n_chars == len(r.text)
    mixed = stored(corpus_pipeline.mix_sources(spark, safe, FOLDER), "t")
    assert all(x.columns == columns for x in (good, first, safe, mixed))
    packed = corpus_pipeline.pack_sequences(spark, mixed, FOLDER)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_pipeline_with_odd_rows(spark):
    docs = odd_documents(spark)
    first = corpus_pipeline.keep_first_of_group(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in first.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9] and first.where("doc_id is null").count() == 1
    out = corpus_pipeline.mix_sources(spark, stored(corpus_pipeline.protect(spark, first, FOLDER), "t"), FOLDER)
    assert out.columns == docs.columns and len(CLASHES) + 5 == len(docs.columns)




def test_all_stages_with_odd_rows_and_names(spark, tmp_path):
    docs = odd_documents(spark).withColumn("a.b", F.lit("dot")).withColumn("a`c", F.lit("tick"))
    again = [(20, "first text of an id that comes twice"), (20, "an unlinked second text under the same id here"), (21, "first text of an id that comes twice")]
    docs = docs.unionByName(spark.createDataFrame(again, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1), (6, 1), (20, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = corpus_pipeline.keep_good(spark, rows, str(tmp_path))
    assert good.columns == rows.columns and good.schema == rows.schema and good.count() == rows.count()  # all labels are good
    assert {r["score"] for r in good.collect()} == {"x", None} and {r["a.b"] for r in good.collect()} == {"dot", None}
    first = corpus_pipeline.keep_first_of_group(spark, good, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in first.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 20, 20] and first.columns == rows.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= {None, 4, 5, 6, 8, 9, 20} and len(packed) > 6


def test_all_stages_without_rows(spark, tmp_path):
    odd_documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
