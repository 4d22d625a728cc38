"""Standard errors, paired comparison and sample-size planning."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordering import pick_at
from .aggregates import SCORE_KEYS, SUFFICIENT_STATS, aggregate_metrics, all_right

NAN = float("nan")


def pop_stddev(c: str = "value") -> Column:
    return F.stddev_pop(c)


def sample_stddev(c: str = "value") -> Column:
    return F.stddev_samp(c)


def mean_stderr(c: str = "value") -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def acc_all_stderr(df: DataFrame, keys: list[str], group: list[str], right: Column) -> DataFrame:
    return all_right(df, keys + group, right).groupBy(*keys).agg(mean_stderr("all_right").alias("acc_all_stderr"))


def _beside(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """The rows with aggregates of their key; null keys are keys like others."""
    if not keys:
        one = df.agg(*aggs)
        return df.withColumn("_all", one.select(F.struct(*one.columns)).scalar()).select(*df.columns, "_all.*")
    per = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*aggs)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(per, same).drop(*[f"_key_{k}" for k in keys])


def clustered_stderr(df: DataFrame, keys: list[str], score: str, cluster: str) -> DataFrame:
    """n, mean, stderr_clt, clusters and stderr_clustered per key. Null clusters form one cluster.

    Clusters carry count, mean and squared deviations. Their means are taken relative to one of them (the key's smallest),
    so nothing large cancels. With S and n the totals of a cluster then, the sum over clusters of (S - n*mean)^2 is
    K * (var(S) - 2*mean*covar(S, n) + mean^2 * var(n)).
    """
    s = F.col(score).cast("double")
    per = (
        df.where(s.isNotNull())
        .groupBy(*keys, cluster)
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(s).alias("_mean"), F.var_pop(s).alias("_var"))
    )
    per = _beside(per, keys, F.min("_mean").alias("_from"))
    off = F.col("_mean") - F.col("_from")
    per = per.withColumns({"s": F.col("n") * off, "q": F.col("n") * (F.col("_var") + off * off)})
    m = per.groupBy(*keys).agg(
        F.first("_from").alias("_from"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.count(F.lit(1)).alias("groups"),
        F.count(cluster).alias("clusters"),
        F.var_pop("s").alias("vs"),
        F.var_pop("n").alias("vn"),
        F.covar_pop("s", "n").alias("vc"),
    )
    mean = F.col("s") / F.col("n")
    dd = F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0))
    between = F.col("groups") * (F.col("vs") - 2 * mean * F.col("vc") + mean * mean * F.col("vn"))
    clt2 = F.try_divide(dd, (F.col("n") - 1) * F.col("n"))
    inner = clt2 + (between - dd) / (F.col("n") * F.col("n"))
    enough = F.col("n") >= 2
    return m.select(
        *keys,
        F.col("n").cast("bigint").alias("n"),
        (F.col("_from") + mean).alias("mean"),
        F.when(enough, F.sqrt(clt2)).alias("stderr_clt"),
        F.col("clusters").cast("bigint").alias("clusters"),
        F.when(enough, F.when(inner >= 0, F.sqrt(inner)).otherwise(NAN)).otherwise(NAN).alias("stderr_clustered"),
    )


def clt_stderr(df: DataFrame, keys: list[str], score: str, cluster: str | None = None) -> DataFrame:
    """s/sqrt(n), and the clustered error only where more than one known cluster exists; null otherwise."""
    if cluster is None:
        return df.groupBy(*keys).agg(
            F.when(F.count(score) > 1, mean_stderr(score)).alias("stderr_clt"),
            F.lit(None).cast("double").alias("stderr_clustered"),
        )
    out = clustered_stderr(df, keys, score, cluster)
    gate = (F.col("clusters") > 1) & (F.col("n") > 1)
    return out.select(*keys, "stderr_clt", F.when(gate, F.col("stderr_clustered")).alias("stderr_clustered"))


def pooled_stderr(df: DataFrame, keys: list[str], stderr: str = "stderr", size: str = "samples") -> DataFrame:
    n, se = F.col(size).cast("double"), F.col(stderr)
    pooled = F.try_divide(F.sum((n - 1) * se * se * n), F.sum(n) - F.count(F.lit(1)))
    return df.groupBy(*keys).agg(F.sqrt(F.try_divide(pooled, F.sum(n))).alias("pooled_stderr"))


# --- t and normal distribution, used on one aggregated row per task ---


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta function of {a}, {b}, {x} did not converge")


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|). With many degrees of freedom by its expansion around the normal tail, good to 1 / df^2."""
    if df > 1e7:
        t = abs(t)
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(t / math.sqrt(2)) + density * (t**3 + t) / (2 * df)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection on the two-sided tail; p > 0.5."""
    tail, lo, hi = 2 * (1 - p), 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.StructType([T.StructField("p_value", T.DoubleType()), T.StructField("t_crit", T.DoubleType())]))
def _t_test(t: pd.Series, df: pd.Series) -> pd.DataFrame:
    p = [t_two_sided(a, b) if np.isfinite(a) and b >= 1 else NAN for a, b in zip(t, df)]
    crit = [t_quantile(0.975, b) if b >= 1 else NAN for b in df]
    return pd.DataFrame({"p_value": p, "t_crit": crit})


@F.pandas_udf(T.DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


def paired_moments(df: DataFrame, keys: list[str], current: str, baseline: str) -> DataFrame:
    d = F.col(current).cast("double") - F.col(baseline).cast("double")
    m = df.where(d.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_diff"),
        (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se_diff"),
        F.avg(F.col(baseline).cast("double")).alias("baseline_mean"),
    )
    sure = F.col("n") >= 2
    mean, se, nan = F.col("mean_diff"), F.col("se_diff"), F.lit(NAN)
    inf = F.when(mean > 0, float("inf")).when(mean < 0, float("-inf")).otherwise(0.0)
    t = F.when(se == 0, inf).otherwise(mean / F.nullif(se, F.lit(0.0)))
    return m.select(
        *keys,
        "n",
        F.when(sure, mean).otherwise(nan).alias("mean_diff"),
        F.when(sure, se).otherwise(nan).alias("se_diff"),
        F.when(sure, t).otherwise(nan).alias("t_stat"),
        "baseline_mean",
    )


def paired_ttest(df: DataFrame, keys: list[str], current: str, baseline: str) -> DataFrame:
    """Mean difference, its error, 95 % interval, t and two-sided p per key; NaN below two pairs."""
    m = paired_moments(df, keys, current, baseline).withColumn(
        "_t", _t_test(F.col("t_stat"), (F.col("n") - 1).cast("double"))
    )
    mean, se, nan = F.col("mean_diff"), F.col("se_diff"), F.lit(NAN)
    exact = F.when(mean == 0, 1.0).otherwise(0.0)
    # NaN comes back from the batch function as null
    crit, p = F.coalesce("_t.t_crit", nan), F.coalesce("_t.p_value", nan)
    return m.select(
        *keys,
        "n",
        "mean_diff",
        "se_diff",
        (mean - crit * se).alias("ci_lower"),
        (mean + crit * se).alias("ci_upper"),
        "t_stat",
        F.when(se == 0, exact).otherwise(p).alias("p_value"),
        "baseline_mean",
    )


def compare_to_baseline(
    current: DataFrame, baseline: DataFrame, keys: list[str], current_score: str | None, baseline_score: str, name: str, score_key: str = "score"
) -> DataFrame:
    """Current and baseline scores joined on (keys, doc_id); percent units in the paired_ columns.

    Without current_score, the score is what a sample has: the score key, a struct's score, else a column *_score.
    """
    if current_score is None:
        from .telemetry import sample_score

        current_score = "_current_score"
        current = current.select(*keys, "doc_id", sample_score(current, score_key).alias(current_score))
    pairs = current.join(baseline, keys + ["doc_id"])
    t = paired_ttest(pairs, keys, current_score, baseline_score)
    return t.select(
        *keys,
        F.lit(name).alias("paired_baseline"),
        (F.col("baseline_mean") * 100).alias("paired_baseline_score"),
        (F.col("mean_diff") * 100).alias("paired_diff"),
        (F.col("ci_lower") * 100).alias("paired_ci_lower"),
        (F.col("ci_upper") * 100).alias("paired_ci_upper"),
        F.col("p_value").alias("paired_pvalue"),
        F.col("n").alias("paired_n"),
    )


def power_columns(
    std_a: Column, std_b: Column, rho: Column, n: Column, effect_size: float, alpha: float = 0.05, power: float = 0.8
) -> dict[str, Column]:
    """Closed form: least n, power at n, smallest detectable effect at n."""
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    a, b = F.coalesce(std_a, std_b, F.lit(0.5)), F.coalesce(std_b, std_a, F.lit(0.5))
    sd = F.sqrt(a * a + b * b - 2 * rho * a * b)
    d = F.lit(effect_size) / F.nullif(sd, F.lit(0.0))
    root = F.sqrt(n.cast("double"))
    return {
        "min_n": F.ceil(F.pow(F.lit(za + zb) * sd / F.lit(effect_size), F.lit(2))).cast("bigint"),
        "current_power": F.bround(_normal_cdf(d * root - za), 4),
        "min_detectable_effect": F.bround(F.lit(za + zb) * sd / root, 4),
    }


def power_report(
    df: DataFrame, keys: list[str], current: str, baseline: str, effect_size: float, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Planning figures per task from a paired score table: spreads, correlation, sizes, sufficient or not."""
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp(current).alias("std_a"),
        F.stddev_samp(baseline).alias("std_b"),
        F.coalesce(
            # corr() itself fails on a constant column
            F.try_divide(F.covar_samp(current, baseline), F.stddev_samp(current) * F.stddev_samp(baseline)), F.lit(0.5)
        ).alias("correlation"),
    )
    cols = power_columns(F.col("std_a"), F.col("std_b"), F.col("correlation"), F.col("n"), effect_size, alpha, power)
    return m.withColumns(cols).withColumn("sufficient", F.col("n") >= F.col("min_n"))


def power_from_sizes(
    sizes: DataFrame,
    effect_size: float,
    std_a: float | None = None,
    std_b: float | None = None,
    correlation: float = 0.5,
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """Planning figures per task when only the sizes (task, n) are known."""
    lit = lambda v: F.lit(v).cast("double")
    cols = power_columns(lit(std_a), lit(std_b), lit(correlation), F.col("n"), effect_size, alpha, power)
    return sizes.withColumns(cols).withColumn("sufficient", F.col("n") >= F.col("min_n"))


# --- bootstrap ---

BLOCK = 20


def effective_iters(iters: int) -> int:
    chunk = min(1000, iters)
    return (iters // chunk) * chunk if chunk > 0 else 0


def _poisson1(u: Column) -> Column:
    """Poisson(1) weight from a uniform in [0, 1) by inversion; beyond 18 lies less than a double can tell from 1."""
    total, below = 0.0, []
    for k in range(19):
        total += math.exp(-1) / math.factorial(k)
        below.append(total)
    c = F.when(u < below[0], 0)
    for k, bound in enumerate(below[1:], 1):
        c = c.when(u < bound, k)
    return c.otherwise(19)


def bootstrap_sums(
    df: DataFrame, keys: list[str], stats: list[str], row_id: list[str], statistic: Column, iters: int, seed: int = 0
) -> DataFrame:
    """Bootstrap error of a statistic of sums (perplexity, corpus text metrics).

    Every row gets a Poisson(1) weight per replicate from a hash of (seed, row, replicate): the usual approximation of
    drawing n rows with replacement. Rows are expanded to blocks of replicates and reduced on the map side; what is
    shuffled is one row per key and block. statistic refers to the columns in `stats`, now sums over a replicate.
    """
    iters = effective_iters(iters)
    blocks = -(-iters // BLOCK)
    # the seed enters as text: int and bigint of one value hash differently
    base = F.xxhash64(F.lit(str(seed)), *row_id)
    rows = df.select(*keys, *[F.col(s).cast("double").alias(s) for s in stats], base.alias("_h")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    u = lambda j: F.pmod(F.xxhash64("_h", F.col("_block") * BLOCK + j), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("_w", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda j: _poisson1(u(j))))
    sums = [F.sum(F.get("_w", F.lit(j)) * F.col(s)).alias(f"_{j}_{s}") for j in range(BLOCK) for s in stats]
    agg = rows.groupBy(*keys, "_block").agg(*sums)
    per_rep = F.array(
        *[
            F.struct((F.col("_block") * BLOCK + j).alias("rep"), *[F.col(f"_{j}_{s}").alias(s) for s in stats])
            for j in range(BLOCK)
        ]
    )
    reps = agg.select(*keys, F.explode(per_rep).alias("r")).select(*keys, "r.*").where(F.col("rep") < iters)
    return reps.withColumn("_v", statistic).groupBy(*keys).agg(F.stddev_samp("_v").alias("bootstrap_stderr"))


def bootstrap_cells(df: DataFrame, keys: list[str], metric: str, iters: int, seed: int = 0) -> DataFrame:
    """Bootstrap error of f1 or mcc on gold/pred pairs.

    Drawing n rows with replacement and counting (gold, pred) cells is one multinomial draw over the cells, so the rows
    are reduced to cell counts first and only those, one small array per key, are resampled. Same distribution as
    resampling rows; the cost no longer depends on rows times iterations.
    """
    iters = effective_iters(iters)
    cells = df.groupBy(*keys, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    # number of cells = squared number of classes of the task
    arr = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gold", "pred", "n"))).alias("cells"))
    schema = T.StructType([f for f in arr.schema if f.name in keys] + [T.StructField("bootstrap_stderr", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                c = [(x["gold"], x["pred"], x["n"]) for x in row.cells]
                out.append(_resampled_std(c, metric, iters, seed))
            yield pdf[keys].assign(bootstrap_stderr=out)

    return arr.mapInPandas(run, schema)


def _resampled_std(cells: list[tuple], metric: str, iters: int, seed: int) -> float | None:
    counts = np.array([c[2] for c in cells], dtype=float)
    n = int(counts.sum())
    if n < 2:
        return None
    rng = np.random.default_rng([seed, n])
    draws = rng.multinomial(n, counts / counts.sum(), size=iters).astype(float)
    if metric == "f1":
        gold = np.array([c[0] == 1 for c in cells])
        pred = np.array([c[1] == 1 for c in cells])
        tp, wrong = draws[:, gold & pred].sum(1), draws[:, gold != pred].sum(1)
        below = 2 * tp + wrong
        values = np.divide(2 * tp, below, out=np.zeros(iters), where=below > 0)
    else:
        classes = sorted({c[0] for c in cells} | {c[1] for c in cells})
        t = np.stack([draws[:, [c[0] == k for c in cells]].sum(1) for k in classes])
        p = np.stack([draws[:, [c[1] == k for c in cells]].sum(1) for k in classes])
        ok = draws[:, [c[0] == c[1] for c in cells]].sum(1)
        below = np.sqrt((n * n - (p * p).sum(0)) * (n * n - (t * t).sum(0)))
        values = np.divide(ok * n - (t * p).sum(0), below, out=np.zeros(iters), where=below > 0)
    return float(values.std(ddof=1))


def bootstrap_median(df: DataFrame, keys: list[str], value: str, iters: int, seed: int = 0) -> DataFrame:
    """Bootstrap error of the upper median.

    The upper median of n draws with replacement sits at the rank ceil(n * U), where U, the (n div 2 + 1)-th smallest of
    n uniforms, is one Beta draw. So each key draws `iters` ranks, and only the values at those ranks are looked up.
    """
    iters = effective_iters(iters)
    rows = df.where(F.col(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    schema = T.StructType(
        [f for f in sizes.schema if f.name in keys]
        + [T.StructField("target", T.LongType()), T.StructField("times", T.LongType())]
    )

    def ranks(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = int(row["n"])
                k = n // 2 + 1
                u = np.random.default_rng([seed, n]).beta(k, n - k + 1, size=iters)
                r, times = np.unique(np.clip(np.ceil(n * u), 1, n).astype(np.int64), return_counts=True)
                yield pd.DataFrame({**{c: [row[c]] * len(r) for c in keys}, "target": r, "times": times})

    at = pick_at(rows, keys, value, targets=sizes.mapInPandas(ranks, schema))
    v, t = F.col(value).cast("double"), F.col("times")
    # relative to the mean, so that large values do not cancel
    centred = _beside(at, keys, (F.sum(v * t) / F.sum(t)).alias("_mean"))
    off = v - F.col("_mean")
    m = centred.groupBy(*keys).agg(F.sum(t).alias("k"), F.sum(off * t).alias("s"), F.sum(off * off * t).alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1)
    return m.select(*keys, F.sqrt(F.greatest(var, F.lit(0.0))).alias("bootstrap_stderr"))


TEXT_METRIC_ITERS = 100


def bootstrap_stderr(
    df: DataFrame, keys: list[str], metric: str, iters: int | None = None, seed: int = 0, row_id: list[str] | None = None
) -> DataFrame:
    """Error by resampling for median, f1, mcc, perplexity, bleu, chrf and ter, and for registered aggregations that are
    functions of sums; 100,000 times unless said otherwise, bleu, chrf and ter 100 times."""
    from . import text_corpus

    iters = iters or (TEXT_METRIC_ITERS if metric in text_corpus.STAT_COLUMNS else 100_000)

    if metric in ("f1", "mcc"):
        return bootstrap_cells(df, keys, metric, iters, seed)
    if metric == "median":
        return bootstrap_median(df, keys, "value", iters, seed)
    if metric == "perplexity":
        rows = df.withColumn("_one", F.lit(1.0))
        stat = F.exp(-F.try_divide(F.col("value"), F.col("_one")))
        return bootstrap_sums(rows, keys, ["value", "_one"], row_id or ["doc_id"], stat, iters, seed)
    if metric in SUFFICIENT_STATS:
        stats, value = SUFFICIENT_STATS[metric]
        return bootstrap_sums(df, keys, stats, row_id or ["doc_id"], value, iters, seed)
    rows = text_corpus.with_pair_stats(df, metric)
    stats, value = text_corpus.STAT_COLUMNS[metric], text_corpus.from_sums(metric)
    return bootstrap_sums(rows, keys, stats, row_id or ["doc_id"], value, iters, seed)


def metrics_with_error(scores: DataFrame, aggregation: dict[str, str], iters: int = 1000, seed: int = 0) -> DataFrame:
    """Values of aggregate_metrics with their error: s/sqrt(n) for means, resampling for its list, else null."""
    values = aggregate_metrics(scores, aggregation, mean_errors=True)
    if iters <= 0:
        return values.withColumn("stderr", F.lit(None).cast("double"))
    keys = SCORE_KEYS
    errors = None
    for m, a in aggregation.items():
        if a in ("median", "f1", "mcc", "perplexity") or a in SUFFICIENT_STATS:
            part = bootstrap_stderr(scores.where(F.col("metric") == m), keys, a, iters, seed)
            errors = part if errors is None else errors.unionByName(part)
    if errors is None:
        return values
    known = F.coalesce("stderr", F.when(F.col("samples") > 1, F.col("bootstrap_stderr")))
    return values.join(errors, keys, "left").withColumn("stderr", known).drop("bootstrap_stderr")
