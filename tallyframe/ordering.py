"""Ranks, running sums and order statistics per key without one task per key.

Values of a numeric order column are cut into up to 1,024 ranges per key at approximate quantiles (any cut gives exact
results; the quantiles only keep the ranges even). Range totals are added up first, then rows are ordered inside their
range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import loosely

COARSE, FINE = 32, 32


def _cuts(df: DataFrame, keys: list[str], x: str, extra: list[Column]) -> DataFrame:
    """One row per key: the cut values, the first of every 32 apart for a quick search, and the extra aggregates."""
    steps = COARSE * FINE
    probs = [i / steps for i in range(steps)]
    firsts = F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda i: F.get("_q", i * FINE))
    quantiles = F.percentile_approx(x, probs, 10_000).alias("_q")
    per_key = loosely(df, keys, quantiles, *extra) if keys else df.agg(quantiles, *extra)
    return per_key.withColumn("_coarse", firsts)


def _range_number(x: str) -> Column:
    """How many cuts lie at or below x, by two short scans."""
    c = F.greatest(F.size(F.filter("_coarse", lambda v: v <= F.col(x))) - 1, F.lit(0))
    within = F.size(F.filter(F.slice(F.col("_q"), c * FINE + 1, F.lit(FINE)), lambda v: v <= F.col(x)))
    return c * FINE + within


def with_ranges(df: DataFrame, keys: list[str], x: str, extra: list[Column] | None = None) -> DataFrame:
    """Adds `_range`, rising with x inside each key, and the extra per-key aggregates."""
    cuts = _cuts(df, keys, x, extra or [])
    if keys:
        joined = df.join(cuts, keys)
    else:
        one = cuts.select(F.struct(*cuts.columns).alias("_c")).scalar()
        joined = df.withColumn("_c", one).select(*df.columns, "_c.*")
    return joined.withColumn("_range", _range_number(x)).drop("_q", "_coarse")


def _offsets(ranged: DataFrame, keys: list[str], weight: Column, carry: list[str] | None = None) -> DataFrame:
    """Weight of each range and of all ranges before it: at most 1,025 rows per key, so the window stays small."""
    kept = [F.first(c).alias(c) for c in carry or []]
    tot = loosely(ranged, keys + ["_range"], F.sum(weight).alias("_sum"), *kept)
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tot.withColumn("_before", F.sum("_sum").over(w) - F.col("_sum"))


def global_rank(df: DataFrame, keys: list[str], x: str, ties: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based row number per key in the order of x, then ties. x should be near unique: equal values share a range."""
    ranged = with_ranges(df, keys, x)
    off = _offsets(ranged, keys, F.lit(1)).select(*keys, "_range", "_before")
    w = Window.partitionBy(*keys, "_range").orderBy(x, *(ties or []))
    return (
        ranged.join(off, keys + ["_range"])
        .withColumn(name, (F.col("_before") + F.row_number().over(w)).cast("bigint"))
        .drop("_range", "_before")
    )


#: Accuracy of the quantiles that bracket a rank; the bracket holds about 8 / ACCURACY of a key's rows.
ACCURACY = 10_000


def value_at(df: DataFrame, keys: list[str], x: str, share: float, rank: Column, carry: str | None = None) -> DataFrame:
    """(keys, x) and the carried column of the row of a rank per key, exact, in two passes.

    rank: an expression over `total`, the number of values of a key, at share * total give or take a row. The first pass
    makes a mergeable quantile sketch per key, whose error is a part of the rank, and takes values on both sides of the
    share; the second counts the rows below them and keeps only those between, of which equal ones are added up. With
    carry, x must be unique per key.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, x, *([carry] if carry else []))
    margin = 4 / ACCURACY
    around = F.percentile_approx(x, [max(0.0, share - margin), min(1.0, share + margin)], ACCURACY)
    sketch = rows.groupBy(*keys).agg(around.alias("_q"), F.count(F.lit(1)).alias("total"))
    if keys:
        near = rows.join(sketch, keys)
    else:
        near = rows.withColumn("_s", sketch.select(F.struct("_q", "total")).scalar()).select(*rows.columns, "_s.*")
    near = near.where(F.col(x) <= F.col("_q")[1]).withColumn("_at", F.when(F.col(x) >= F.col("_q")[0], F.col(x)))
    more = [F.first(carry).alias(carry)] if carry else []
    cells = loosely(near, [*keys, "_at"], F.count(F.lit(1)).alias("_n"), F.first("total").alias("total"), *more)
    run = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = cells.withColumn("_sum", F.sum("_n").over(run))
    hit = reached.where((F.col("_sum") >= rank) & (F.col("_sum") - F.col("_n") < rank))
    return hit.select(*keys, F.col("_at").alias(x), *([carry] if carry else []))


def first_reaching(df: DataFrame, x: str, weight: str, target: Column) -> DataFrame:
    """At most one row (x, reached): the smallest x at which the running weight reaches a target.

    Ranges of x are added up and looked through as one array; only the range in which the target lies is put in order.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(x), F.col(weight).alias("_w"))
    ranged = with_ranges(rows, [], x)
    sums = F.array_sort(F.collect_list(F.struct("_range", "_sum")))
    state = lambda r, before, done: F.struct(r.cast("bigint").alias("range"), before.cast("bigint").alias("before"), done.alias("done"))
    look = lambda a, r: F.when(a["done"], a).when(a["before"] + r["_sum"] >= target, state(r["_range"], a["before"], F.lit(True))).otherwise(state(r["_range"], a["before"] + r["_sum"], F.lit(False)))
    found = ranged.groupBy("_range").agg(F.sum("_w").cast("bigint").alias("_sum")).agg(F.aggregate(sums, state(F.lit(-1), F.lit(0), F.lit(False)), look).alias("_a")).scalar()
    inside = ranged.withColumn("_a", found).where(F.col("_a.done") & (F.col("_range") == F.col("_a.range")))
    cells = inside.groupBy(x).agg(F.sum("_w").alias("_w"), F.first("_a.before").alias("_before"))
    run = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("reached", F.col("_before") + F.sum("_w").over(run))
    return summed.where((F.col("reached") >= target) & (F.col("reached") - F.col("_w") < target)).select(x, "reached")


def pick_at(
    df: DataFrame,
    keys: list[str],
    x: str,
    target: Column | None = None,
    targets: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The smallest x at which the running weight reaches a target: one row (keys, target, x, reached, total) each.

    target: an expression over `total`, the weight per key; or, with keys, targets: a table (keys, target, ...) with any
    number of targets per key. Without weight every row counts 1. Targets beyond the total drop out.
    """
    amount = F.col(weight) if weight else F.lit(1)
    hist = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(amount).alias("_w"))
    ranged = with_ranges(hist, keys, x, [F.sum("_w").alias("total")])
    off = _offsets(ranged, keys, F.col("_w"), ["total"])
    if targets is None:
        aimed = off.withColumn("target", target)
    else:
        aimed = off.join(targets, keys)
    aimed = aimed.where((F.col("_before") < F.col("target")) & (F.col("target") <= F.col("_before") + F.col("_sum")))
    wanted = aimed.select(*keys, "_range", "_before").distinct()
    w = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = (
        ranged.drop("total")
        .join(wanted, keys + ["_range"])
        .withColumn("reached", F.col("_before") + F.sum("_w").over(w))
        .select(*keys, "_range", x, "_w", "reached")
    )
    out = aimed.drop("_sum", "_before").join(run, keys + ["_range"])
    hit = (F.col("target") <= F.col("reached")) & (F.col("target") > F.col("reached") - F.col("_w"))
    return out.where(hit).drop("_range", "_w")
