"""Reading tables, storing intermediate tables and small shared expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import scratch_path

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch: texts are long, and a batch is held several times on its way to a worker and back.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Lets Spark remove the shuffle files of a query as soon as it has ended, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, label: str, *by: str, codec: str | None = None) -> DataFrame:
    """The same rows read back from a table in the shared scratch folder: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*by) if by else df.write
    with shuffles_removed(df.sparkSession):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number: which fold a document is in."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def words_in(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mapped(df: DataFrame, run: Callable, fields: list[tuple[str, DataType | str]]) -> DataFrame:
    """df.mapInArrow(run) for columns of any name: run sees batches with df's own names and yields the fields in order."""
    names = df.columns

    def inner(batches):
        import pyarrow as pa

        own = (pa.RecordBatch.from_arrays(list(b.columns), names=names) for b in batches)
        for made in run(own):
            yield pa.RecordBatch.from_arrays(list(made.columns), names=[f"c{i}" for i in range(len(fields))])

    types = [DataType.fromDDL(t) if isinstance(t, str) else t for _, t in fields]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = plain.mapInArrow(inner, StructType([StructField(f"c{i}", t) for i, t in enumerate(types)]))
    return out.toDF(*[n for n, _ in fields])


def named(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[named(c) for c in names])


def with_columns(df: DataFrame, fields: list[tuple[str, str]], compute, *args) -> DataFrame:
    """Adds columns that compute(batch, *args) gives as Arrow arrays; a column of the same name is replaced."""
    names = [n for n, _ in fields]
    old = [i for i, c in enumerate(df.columns) if c not in names]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = list(compute(batch, *args))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in old] + made, names=[str(i) for i in range(len(old) + len(made))])

    return mapped(df, run, [(df.schema[i].name, df.schema[i].dataType) for i in old] + list(fields))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column, block: int = 64) -> Column:
    """Sum of the elements before each one: sums inside blocks, and once per block the sum of all blocks before it."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    numbers = lambda a: F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / block), F.lit(0)).cast("int"))
    totals = lambda a: F.transform(numbers(a), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
    before = lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b)))
    at = lambda i: F.floor(i / block).cast("int")
    inside = lambda a, i: total(F.slice(a, at(i) * block + 1, i % block))
    return let(lengths, lambda a: let(let(totals(a), before), lambda b: F.transform(a, lambda _, i: F.get(b, at(i)) + inside(a, i))))
