"""Statistics against plain restatements, and shapes that must hold when one key has a large part of all rows."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe import ordering, registry
from tallyframe.operators import aggregates as A
from tallyframe.operators import contamination
from tallyframe.operators import reports as R
from tallyframe.operators import reuse as J
from tallyframe.operators import statistics as H
from tallyframe.operators import telemetry as I
from tallyframe.operators import text_corpus as C


def hot_rows(n=3000, seed=5):
    """(key, x, w): one key with most rows, many ties."""
    r = random.Random(seed)
    return [(("hot" if r.random() < 0.6 else f"k{r.randint(0, 30)}"), r.choice([r.randint(0, 40), r.random() * 40]), r.randint(0, 5)) for _ in range(n)]


def test_ranks_and_picks(spark):
    rows = [(k, float(x), w, i) for i, (k, x, w) in enumerate(hot_rows())]
    df = spark.createDataFrame(rows, "k string, x double, w int, i int")
    want, by = {}, {}
    for k, x, w, i in rows:
        by.setdefault(k, []).append((x, i, w))
    for k, v in by.items():
        for n, (_, i, _) in enumerate(sorted(v), 1):
            want[i] = n
    got = {r.i: r.rank for r in ordering.global_rank(df, ["k"], "x", ["i"]).collect()}
    assert got == want
    med = {r.k: r.median for r in A.median(df, ["k"], "x").collect()}
    assert med == {k: sorted(v)[len(v) // 2][0] for k, v in by.items()}
    mid = {r.k: r.median for r in A.middle_row(df, ["k"], "i", "x").collect()}
    assert mid == {k: sorted(v, key=lambda t: t[1])[len(v) // 2][0] for k, v in by.items()}
    for share in (0.001, 0.3, 1.0):
        got = {r.k: r.x for r in ordering.pick_at(df, ["k"], "x", F.ceil(F.col("total") * share), weight="w").collect()}
        for k, v in by.items():
            goal, run = math.ceil(sum(w for *_, w in v) * share), 0
            for x, _, w in sorted(v):
                run += w
                if run >= goal > 0:
                    break
            if goal > 0:
                assert got[k] == x, (k, share)


def test_literal_middle(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, 9), (4, 3)], "o int, v int").withColumn("k", F.lit(1))
    assert A.middle_row(df, ["k"], "o", "v").first()["median"] == 9
    assert A.median(df, ["k"], "v").first()["median"] == 5


def trajectory_loop(groups):
    success, firsts, prop, later_rates = [], [], [], []
    for steps in groups:
        accs = [a for _, a in sorted(steps)]
        nums = [n for n, _ in sorted(steps)]
        success.append(all(a == 1.0 for a in accs))
        bad = [i for i, a in enumerate(accs) if a != 1.0]
        if bad:
            firsts.append(nums[bad[0]])
            later = accs[bad[0] + 1 :]
            if later:
                prop.append(any(a != 1.0 for a in later))
                later_rates.append(sum(a != 1.0 for a in later) / len(later))
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return mean(success), mean(firsts), statistics.median(firsts) if firsts else 0.0, mean(prop), mean(later_rates)


def scored(spark, rows):
    df = spark.createDataFrame(rows, "trajectory_id string, step string, accuracy double")
    return df.select("*", F.lit("multi_turn").alias("mode"), F.lit(True).alias("scorable"), F.lit(True).alias("parsed"),
                     F.col("step").alias("id"), F.lit("c").alias("question_class"), F.lit("v").alias("source_video_id"))


def values(df):
    return {r.metric: r.value for r in df.collect() if r.key is None}


def test_trajectories(spark):
    t = {"t1": [1, 0, 1, 0], "t2": [1, 1], "t3": [0]}
    v = values(R.trajectory_report(scored(spark, [(k, str(i), float(a)) for k, s in t.items() for i, a in enumerate(s, 1)])))
    assert v["trajectory_success_rate"] == pytest.approx(1 / 3)
    assert (v["avg_first_mistake_step"], v["median_first_mistake_step"]) == (1.5, 1.5)
    assert (v["error_propagation_rate"], v["post_error_failure_rate"]) == (1.0, 0.5)


def test_trajectories_with_a_hot_one(spark):
    r = random.Random(2)
    groups = {"hot": [(i, float(r.random() < 0.99)) for i in range(1, 2001)]}
    groups.update({f"t{j}": [(i, float(r.random() < 0.7)) for i in range(1, r.randint(2, 9))] for j in range(300)})
    v = values(R.trajectory_report(scored(spark, [(k, str(n), a) for k, s in groups.items() for n, a in s])))
    want = trajectory_loop(groups.values())
    got = [v[m] for m in ("trajectory_success_rate", "avg_first_mistake_step", "median_first_mistake_step", "error_propagation_rate", "post_error_failure_rate")]
    assert got == pytest.approx(want)


def test_trajectory_rows_are_hashed_and_their_orders_not_broadcast(spark):
    """Only the first wrong positions are aggregated by sorting, and no task holds the keys of all orders."""
    from tallyframe.plans import fixtures as V

    t = {"a": [1, 0, 1, 0], "b": [1, 1], "c": [0], "d": [0, 0, 1]}
    df = R.trajectory_rows(scored(spark, [(k, str(i), float(a)) for k, s in t.items() for i, a in enumerate(s, 1)]))
    got = {r.trajectory_id: (r.rows, r.wrong, r.first_wrong_step, r.later, r.later_wrong) for r in df.collect()}
    assert got == {"a": (4, 2, "2", 2, 1), "b": (2, 0, None, None, None), "c": (1, 1, "1", 0, 0), "d": (3, 2, "1", 2, 1)}
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 2 and plan.count("HashAggregate") >= 2, plan
    plan = V.line_steps(spark, "/root/testdata/sf0.01")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_empty_report(spark):
    none = scored(spark, [("t", "1", 1.0)]).where("false")
    v = values(R.score_report(none))
    counts = ["total_count", "scorable_count", "unscorable_count", "parse_rate", "micro_avg", "macro_avg", "overall", "step_macro_avg", "multi_turn_step_count"]
    assert sorted(v) == sorted(counts + R.TRAJECTORY_RESULTS) and not any(v.values())
    parts = R.accuracy_report(none).unionByName(R.step_report(none)).unionByName(R.trajectory_report(none))
    assert values(parts) == v
    v = values(R.score_report(scored(spark, [("t", "1", 1.0)]).withColumn("scorable", F.lit(False))))
    assert (v["total_count"], v["macro_avg"], v["overall"], v["parse_rate"]) == (1.0, 0.0, 0.0, 1.0)


def test_report_is_its_parts(spark):
    s = [(f"t{i % 5}", str(i % 4) if i % 7 else "intro", float(i % 3 > 0)) for i in range(60)]
    df = scored(spark, s).withColumn("question_class", F.when(F.col("step") != "2", F.concat(F.lit("c"), "step"))).withColumn("source_video_id", F.when(F.col("step") != "1", F.col("trajectory_id")))
    df = df.withColumn("scorable", (F.col("step") != "3") | (F.col("trajectory_id") == "t1")).withColumn("accuracy", F.when(F.col("step") != "0", F.col("accuracy")))
    parts = R.accuracy_report(df).unionByName(R.step_report(df)).unionByName(R.trajectory_report(df))
    row = lambda r: (r.metric, r.key or "", None if r.value is None else round(r.value, 12))
    assert sorted(map(row, R.score_report(df).collect()), key=str) == sorted(map(row, parts.collect()), key=str)


def test_step_order(spark):
    s = [("t", x, 1.0) for x in ("10", "2", "2b", "intro", "2a")]
    got = [r.step for r in R.step_means(scored(spark, s)).orderBy("step_num", "step_suffix").collect()]
    assert got == ["2", "2a", "2b", "10", "intro"]


def test_stability(spark):
    df = spark.createDataFrame([("q1", 1.0), ("q1", 1.0), ("q1", 0.0), ("q2", 1.0), ("q2", 0.0)], "q string, s double").withColumn("t", F.lit("t"))
    assert A.stability_report(df, ["t"], ["q"], "s").first()["consensus_accuracy"] == 0.5
    every = df.select("t", "q").unionByName(spark.createDataFrame([("t", "q3")], "t string, q string"))
    r = A.stability_report(df, ["t"], ["q"], "s", every).first()
    assert r.consensus_accuracy == pytest.approx(1 / 3) and r.consistency_rate == 0.0
    one = A.stability_report(df.where("q = 'q1'").limit(1), ["t"], ["q"], "s").first()
    assert math.isnan(one.internal_variance)


def test_clustered(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (0.0, "b"), (0.0, "b")], "s double, c string").withColumn("k", F.lit(1))
    assert H.clustered_stderr(df, ["k"], "s", "c").first()["stderr_clustered"] == pytest.approx(0.3818813, abs=1e-7)
    assert math.isnan(H.clustered_stderr(df.limit(1), ["k"], "s", "c").first()["stderr_clustered"])
    assert H.clt_stderr(df.where("c = 'a'"), ["k"], "s", "c").first()["stderr_clustered"] is None


def test_t_distribution():
    assert H.t_two_sided(2.0, 10) == pytest.approx(0.073388034770, abs=1e-9)
    assert H.t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert H.t_quantile(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-9)
    assert H.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, abs=1e-7)
    assert H.t_quantile(0.975, 500) == pytest.approx(1.964719837, abs=1e-7)


def test_paired(spark):
    rows = [("a", 1.0, 0.0), ("a", 1.0, 1.0), ("a", 0.0, 0.0), ("a", 1.0, 0.0), ("same", 1.0, 0.5), ("same", 1.5, 1.0), ("one", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "task string, c double, b double")
    got = {r.task: r for r in H.paired_ttest(df, ["task"], "c", "b").collect()}
    a = got["a"]
    # differences 1, 0, 0, 1: mean 0.5, sd 0.57735, t = 1.7320508 on 3 degrees of freedom
    assert (a.n, a.mean_diff) == (4, 0.5) and a.t_stat == pytest.approx(1.7320508)
    assert a.p_value == pytest.approx(0.1816901, abs=1e-6)
    assert a.ci_lower == pytest.approx(0.5 - 3.182446305 * 0.288675135, abs=1e-6)
    assert (got["same"].t_stat, got["same"].p_value) == (math.inf, 0.0)
    assert math.isnan(got["one"].p_value) and got["one"].n == 1


def test_power(spark):
    sizes = spark.createDataFrame([("t", 2181), ("u", 100)], "task string, n int")
    t, u = H.power_from_sizes(sizes, 0.03).orderBy("task").collect()
    assert (t.min_n, t.sufficient, u.sufficient) == (2181, True, False)
    assert t.current_power == pytest.approx(0.8, abs=1e-3) and u.min_detectable_effect == pytest.approx(0.1401, abs=1e-4)


def test_bootstrap_agrees_with_resampling_rows(spark):
    rng = np.random.default_rng(1)
    n = 400
    gold, value = rng.integers(0, 2, n), rng.normal(2, 1, n)
    pred = np.where(rng.random(n) < 0.8, gold, 1 - gold)
    rows = [("t", str(i), float(value[i]), int(gold[i]), int(pred[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "task string, doc_id string, value double, gold int, pred int").repartition(4)

    def plain(fn, iters=2000):
        return np.std([fn(rng.integers(0, n, n)) for _ in range(iters)], ddof=1)

    def f1(i):
        tp = ((gold[i] == 1) & (pred[i] == 1)).sum()
        return 2 * tp / (2 * tp + (gold[i] != pred[i]).sum())

    want = {
        "f1": plain(f1),
        "mcc": plain(lambda i: np.corrcoef(gold[i], pred[i])[0, 1]),
        "median": plain(lambda i: np.sort(value[i])[n // 2]),
        "perplexity": plain(lambda i: math.exp(-value[i].mean())),
    }
    for metric, se in want.items():
        got = H.bootstrap_stderr(df, ["task"], metric, 2000 if metric != "perplexity" else 500).first()["bootstrap_stderr"]
        assert got == pytest.approx(se, rel=0.12), metric
    a, b = (H.bootstrap_stderr(df.repartition(p), ["task"], "perplexity", 100).first()[1] for p in (2, 5))
    assert a == pytest.approx(b)
    assert H.effective_iters(2500) == 2000 and H.effective_iters(150) == 150


def test_text_corpus():
    assert C.bleu_counts("the cat sat", ["the cat ran", "a cat sat down here"])[:4] == [3.0, 2.0, 0.0, 0.0]
    assert C.bleu_counts("a a a", ["a b", "a a"])[0] == 2.0
    assert C.words_13a('He said &quot;no, 3.5-4%"') == ["He", "said", '"', "no", ",", "3.5", "-", "4", "%", '"']
    s = C.chrf_counts("ab c", ["abd"])
    assert s[:3] == [3.0, 2.0, 1.0] and s[12:15] == [2.0, 1.0, 0.0]
    assert C.chrf_value(C.chrf_counts("same text", ["same text"])) == pytest.approx(100)
    assert C.ter_counts("b c a", ["a b c"]) == [1.0, 3.0]
    assert C.ter_counts("a b c", ["a b c", "x"]) == [0.0, 2.0]
    assert C.ter_counts("x y z", ["a b c d"]) == [4.0, 4.0]


def plain_shifted(words, ref):
    """(shifts, edits) by whole tables: every move of a run is tried, the first of the best ones is taken."""

    def table(a):
        rows = [list(range(len(ref) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(ref):
                rows[i].append(min(rows[i - 1][j] + (x != y), rows[i - 1][j + 1] + 1, rows[i][j] + 1))
        return rows

    done = 0
    while True:
        rows, wrong, missed, at = table(words), [True] * len(words), [True] * len(ref), [0] * len(ref)
        i, j = len(words), len(ref)
        while j:
            if i and rows[i][j] == rows[i - 1][j - 1] + (words[i - 1] != ref[j - 1]):
                i, j = i - 1, j - 1
                wrong[i] = missed[j] = words[i] != ref[j]
                at[j] = i
            elif i and rows[i][j] == rows[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
                at[j] = i - 1
        tried = []
        for i in range(len(words)):
            for j in range(max(0, i - 50), min(len(ref), i + 51)):
                for k in range(1, 11):
                    if i + k > len(words) or j + k > len(ref) or words[i : i + k] != ref[j : j + k]:
                        break
                    if any(wrong[i : i + k]) and any(missed[j : j + k]) and not i <= at[j] < i + k:
                        rest = words[:i] + words[i + k :]
                        for to in {at[j + t] + 1 if j + t >= 0 else 0 for t in range(-1, k)}:
                            if to < i or to > i + k:
                                cut = to if to < i else to - k
                                tried.append(rest[:cut] + words[i : i + k] + rest[cut:])
        costs = [table(c)[-1][-1] for c in tried]
        if not costs or min(costs) + 1 >= rows[-1][-1]:
            return done, rows[-1][-1]
        words, done = tried[costs.index(min(costs))], done + 1


def test_ter_of_moved_runs_agrees_with_whole_tables_in_a_fraction_of_the_steps(monkeypatch):
    r = random.Random(4)
    cases = [([r.choice("abcdefgh"[:n]) for _ in range(r.randint(0, 14))], [r.choice("abcdefgh"[:n]) for _ in range(r.randint(0, 14))]) for n in (1, 2, 5, 8) * 25]
    for _ in range(15):
        ref = [str(r.randint(0, 60)) for _ in range(r.randint(20, 80))]
        words = ref[:]
        for _ in range(3):
            i, k = r.randrange(len(words)), r.randint(1, 8)
            run = words[i : i + k]
            del words[i : i + k]
            j = r.randint(0, len(words))
            words[j:j] = run
        cases.append((words, ref))
    for words, ref in cases:
        shifts, edits = plain_shifted(words, ref)
        assert C.ter_counts(" ".join(words), [" ".join(ref)]) == [shifts + edits, len(ref)], (words, ref)
    steps, step = [], C._step
    monkeypatch.setattr(C, "_step", lambda *a: steps.append(1) or step(*a))
    ref = [f"w{i}" for i in range(400)]
    # one run moved at the end: the columns before it are not made again for every move tried
    C.ter_counts(" ".join(ref[:380] + ref[390:] + ref[380:390]), [" ".join(ref)])
    assert len(steps) < 6 * len(ref)


def test_rows_with_much_work_are_not_joined_into_few_parts(spark):
    from tallyframe.plans.catalog import spread

    parts = spread(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3 * spark.sparkContext.defaultParallelism


def test_corpus_scores(spark):
    df = spark.createDataFrame([("the cat sat on the mat", ["the cat sat on the mat"]), ("a b", ["c d"])], "prediction string, references array<string>")
    df = df.withColumn("task", F.lit("t"))
    bleu = C.corpus_metric(df, ["task"], "bleu").first()["bleu"]
    assert bleu == pytest.approx(100 * (6 / 8 * 5 / 6 * 4 / 4 * 3 / 3) ** 0.25)
    assert C.corpus_metric(df.where("prediction = 'a b'"), ["task"], "bleu").first()["bleu"] == 0.0
    assert C.corpus_metric(df, ["task"], "ter").first()["ter"] == pytest.approx(100 * 2 / 8)


def test_contamination(spark):
    words = [f"w{i}" for i in range(40)]
    corpus = spark.createDataFrame([(" ".join(words),), ("short text",)], "text string")
    q = spark.createDataFrame([("hit", "x " + " ".join(words[5:18])), ("near", " ".join(words[5:17] + ["z"])), ("tiny", "Short  text"), ("none", "")], "id string, query string")
    got = {r.id: r.subset for r in contamination.split_contamination(q, corpus, ["id"]).collect()}
    assert got == {"hit": "only_contamination", "near": "no_contamination", "tiny": "only_contamination", "none": "no_contamination"}


def test_budget(spark):
    rows = [(i, 1, 2, 0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "seq int, input_tokens int, output_tokens int, reasoning_tokens int")
    r = I.budget_cutoff(df, "seq", 30).first()
    assert (r.first_call, r.tokens_then, r.budget_exceeded, r.total_tokens) == (10, 30, True, 300)
    r = I.budget_cutoff(df, "seq", 301).first()
    assert (r.first_call, r.budget_exceeded) == (None, False)


def test_reuse_rules(spark):
    rows = [("generate_until", {"temperature": "0"}), ("generate_until", {"temperature": "0.7"}), ("generate_until", {"n": "2"}), ("loglikelihood", {"n": "2"}), ("generate_until", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k map<string,string>").orderBy("i")
    assert [r[0] for r in df.select(J.is_deterministic(F.col("t"), F.col("k"))).collect()] == [True, False, False, True, True]
    got = [r[0] for r in df.select(J.canonical_gen_kwargs(F.col("k"))).collect()]
    assert got == ['{"temperature":0}', '{"temperature":0.7}', '{"n":2}', '{"n":2}', "{}"]
    ok = spark.createDataFrame([("generate_until", " \t"), ("generate_until", "x"), ("loglikelihood", "[-1.5, true]"), ("loglikelihood", "[1]"), ("loglikelihood", None)], "t string, r string")
    assert [r[0] for r in ok.select(J.is_valid_response(F.col("r"), F.col("t"))).collect()] == [False, True, True, False, False]


def test_audit_merge(spark):
    rows = [("k", True, 0, 1.0), ("k", True, 1, 0.5), (None, False, 0, 2.0), ("n", False, 0, 3.0)]
    df = spark.createDataFrame(rows, "cache_key string, deterministic boolean, shard int, created_at double")
    out = J.merge_audit(df)
    assert out.count() == 3 and [r.shard for r in out.where("cache_key = 'k'").collect()] == [0]


def test_group_report_needs_all_errors(spark):
    r = spark.createDataFrame([("a", "m", "none", 1.0, 0.1, 10), ("b", "m", "none", 0.0, None, 30)], "task string, metric string, filter string, value double, stderr double, samples int")
    m = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, task string")
    c = spark.createDataFrame([("g", "m", "none", True)], "group string, metric string, filter string, weight_by_size boolean")
    out = A.group_report(r, m, c).first()
    assert (out.value, out.stderr, out.samples) == (0.25, None, 40)


def test_registry(spark):
    registry.register_aggregation("spread", lambda: F.max("value") - F.min("value"))
    registry.register_metric("range", higher_is_better=False, aggregation="spread")
    df = spark.createDataFrame([("t", "range", "none", 1.0), ("t", "range", "none", 4.0)], "task string, metric string, filter string, value double")
    assert A.aggregate_metrics(df, {"range": "spread"}).first()["value"] == 3.0
    with pytest.raises(ValueError):
        registry.register_metric("range")
    registry.register_aggregation("ratio", lambda: F.sum("value") / F.sum("weight"), sufficient_stats=(["value", "weight"], F.col("value") / F.col("weight")))
    rows = spark.range(400).select(
        F.lit("t").alias("task"), F.lit("r").alias("metric"), F.lit("none").alias("filter"), F.col("id").cast("string").alias("doc_id"),
        (F.xxhash64("id") % 100 / 10.0).alias("value"), F.lit(1.0).alias("weight"),
    )
    r = H.metrics_with_error(rows, {"r": "ratio"}, iters=300).first()
    assert r.stderr == pytest.approx(rows.agg(F.stddev_samp("value")).first()[0] / 20, rel=0.2)
    from tallyframe.operators import scoring as S

    registry.register_metric("same_length", fn=lambda p, t: (F.length(p) == F.length(t)).cast("double"))
    got = spark.createDataFrame([("abc ", ["xyz", "q"])], "response string, targets array<string>")
    r = S.score_generation(got, ["exact_match", "anls", "same_length"]).first()
    assert (r.exact_match, r.anls, r.same_length) == (0.0, 0.0, 1.0)
    from tallyframe.functions import filters as E

    registry.register_filter("twice", lambda c: F.transform(c, lambda x: F.concat(x, x)))
    rows = spark.createDataFrame([(["a"],)], "responses array<string>")
    assert E.apply_filters(rows, {"p": ["twice"]}).first()["response"] == "aa"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["score_report", "trajectory_report_lines", "clustered_stderr_lines", "aggregate_metrics", "score_responses", "usage_report", "median", "reuse_responses", "merge_audit"])
def test_plans_stay_on_the_engine(spark, name):
    """No Python in the core paths, no nested loops, no single-partition window."""
    from tallyframe.plans import QUERIES

    p = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for bad in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, p


def test_scans_are_pruned(spark):
    from tallyframe.plans import QUERIES

    p = plan_of(QUERIES["clustered_stderr_lines"](spark, "/root/testdata/sf0.001"))
    assert "l_discount" in p and "l_extendedprice" not in p
