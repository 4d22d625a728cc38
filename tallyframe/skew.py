"""Grouping that stays balanced when one key holds a large part of all rows.

Joins of many rows with one row per key are left to the runtime skew join, which splits a hot partition by its map
outputs. It only acts on a join whose two sides are shuffled for that join and whose output partitioning nobody relies
on. A plain aggregate on the join keys breaks both rules: below the join it already has the right partitioning, above it
it reuses the join's. `loosely` groups by the keys wrapped into one struct, which has a partitioning of its own. The
price is one more shuffle of group totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loosely(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """groupBy(keys).agg(aggs) that does not pin the partitioning of a join below it."""
    out = df.groupBy(F.struct(*keys).alias("_k")).agg(*aggs)
    return out.select("_k.*", *[c for c in out.columns if c != "_k"])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key by an order; an aggregate, so copies of a key are thinned before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return loosely(df, keys, best).select(*keys, "_first.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return loosely(df, keys, best).select(*keys, "_last.*").select(*df.columns)
