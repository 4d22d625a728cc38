"""Registered queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: list[str] | None = None):
    """Registers a query; views are the named SQL views its check is written on."""

    def add(fn: Run) -> Run:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(views or [], sql)
        return fn

    return add


def with_views(views: list[str], sql: str) -> str:
    if not views:
        return sql
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by key before work that costs far more per row than moving it; the test tables are one file.

    The number of parts is given, as Spark would otherwise join parts by their bytes, which say nothing of the work: several
    parts per core, so that a slow one does not hold up the rest.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *[F.col(c) for c in by])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)
