"""Readers and writers. Schemas are declared; nothing is inferred except for foreign score files."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.result_tables import sample_record
from ..schemas import AUDIT, LIVE, QUESTION
from ..skew import last_by
from .growing import growing_lines


def expand_path(path: str) -> str:
    """$VAR, ${VAR} and ~ replaced; a variable that is not set is an error."""
    out = os.path.expanduser(os.path.expandvars(path))
    left = re.search(r"\$(\w+|\{[^}]*\})", out)
    if left:
        raise ValueError(f"unresolved variable {left.group(0)} in path {path!r}")
    return out


def read_questions(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = QUESTION, keep_raw: bool = False
) -> DataFrame:
    """JSONL question records as split `test`; unreadable lines stay, in _corrupt_record.

    Lines are parsed in full whatever columns a query uses, so that a broken line is always seen as broken.
    keep_raw adds the line as `_raw`, which validation uses to check types as written.
    """
    paths = [expand_path(p) for p in ([paths] if isinstance(paths, str) else paths)]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(paths).where(F.trim("value") != "")
    df = lines.select(F.col("value").alias("_raw"), F.from_json("value", schema, options).alias("r"))
    df = df.select(*(["_raw"] if keep_raw else []), "r.*")
    return df.withColumn("split", F.lit("test"))


def _score_of(df: DataFrame, names: list[str]) -> Column:
    """First usable score over the score columns in schema order, else target against the first filtered response."""

    def same(a: Column, b: Column) -> Column:
        ok = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
        return F.when(ok, (F.upper(F.trim(a)) == F.upper(F.trim(b))).cast("double"))

    found = []
    for n in names:
        t = df.schema[n].dataType
        if isinstance(t, (T.NumericType, T.BooleanType)):
            found.append(F.col(n).cast("double"))
        elif isinstance(t, T.StructType):
            have = set(t.fieldNames())

            def either(*fields: str) -> Column:
                parts = [F.nullif(F.col(n)[f].cast("string"), F.lit("")) for f in fields if f in have]
                return F.coalesce(*parts, F.lit(None).cast("string"))

            found.append(same(either("pred_answer", "pred"), either("answer", "target")))
    if {"target", "filtered_resps"} <= set(df.columns):
        t = df.schema["filtered_resps"].dataType
        r = F.col("filtered_resps")
        while isinstance(t, T.ArrayType):
            r, t = F.get(r, F.lit(0)), t.elementType
        found.append(same(r.cast("string"), F.col("target").cast("string")))
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def baseline_scores(df: DataFrame, order: list[str], score_columns: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of one run's samples; a later line overwrites an earlier one."""
    names = score_columns or [c for c in df.columns if "score" in c.lower()]
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), _score_of(df, names).alias("score"), *order)
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("score").isNotNull())
    return last_by(rows, ["doc_id"], [F.col(c) for c in order]).select("doc_id", "score")


def read_baseline_scores(
    spark: SparkSession, path: str, score_columns: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """Scores of a sample JSONL. Line order: the given columns, else file name and position within the file."""
    df = spark.read.json(expand_path(path))
    if order is None:
        df = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
        order = ["_file", "_at", "_line"]
    return baseline_scores(df, order, score_columns)


def _whole_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of the JSON lines that can be read as a whole; the choice does not depend on the columns used."""
    full = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.where(F.trim("value") != "").select(parsed.alias("r"))
    return rows.where(F.col("r").isNotNull() & F.col("r._broken").isNull()).select(*[F.col(f"r.{f.name}") for f in schema.fields])


def read_response_log(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses or audit rows, JSON lines or parquet.

    A line is parsed in full whatever columns are used, and counts only if all of it can be read.
    """
    path = expand_path(path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return _whole_lines(spark.read.text(path), AUDIT)


def write_response_log(df: DataFrame, path: str) -> None:
    """Parquet partitioned by task, so that a run on few tasks reads only those."""
    df.write.mode("overwrite").partitionBy("task_name").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Per-question results as JSON below task=/run_id= folders."""
    sample_record(samples).write.mode("append").partitionBy("task", "run_id").json(path)


def write_results(results: DataFrame, config: dict[str, str], path: str, task_hashes: DataFrame | None = None) -> None:
    """The result rows of one run with its configuration and task hashes, appended."""
    out = results if task_hashes is None else results.join(task_hashes, "task", "left")
    pairs = [F.lit(x) for kv in sorted(config.items()) for x in kv]
    out = out.withColumn("config", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    out.write.mode("append").parquet(path)


#: Files that one task writes, about, where every key has a file of its own: there the files are the work, not the rows.
FILES_PER_TASK = 250
#: Tasks of a listing of many folders; by default every folder is a task of its own.
LISTING_TASKS = 64


def write_file_per_key(df: DataFrame, keys: list[str], path: str) -> None:
    """The one other column as text in folders key=value/, a file per key; rows of one key are written by one task."""
    tasks = max(1, math.ceil(df.count() / FILES_PER_TASK))
    # tasks move their own files to the new folder; the default leaves that to the driver, one file after the other
    writer = df.repartition(tasks, *keys).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(*keys).text(path)


@contextmanager
def listed_in_parts(spark: SparkSession) -> Iterator[None]:
    """Readers that are made here list many folders in LISTING_TASKS tasks."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(LISTING_TASKS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """LISTING rows (path, size, modified) of a folder tree without reading the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(expand_path(path)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def parse_manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(md5, rel_path) rows and the bad lines of `md5  ./path` text (column value)."""
    line = F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    rows = lines.select(line.alias("line")).where("line != ''")
    good = F.rlike("line", F.lit(r"^\S+\s+\./"))
    ok = rows.where(good).select(
        F.regexp_extract("line", r"^(\S+)\s", 1).alias("md5"), F.regexp_extract("line", r"^\S+\s+\./(.*)$", 1).alias("rel_path")
    )
    return ok, rows.where(~good)


def read_md5_manifest(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """MANIFEST rows; with fail, a bad line or an empty manifest is an error when the table is read."""
    from ..operators.validation import require_rows

    ok, bad = parse_manifest(spark.read.text(expand_path(path)))
    if not fail:
        return ok
    broken = bad.select(
        F.raise_error(F.concat(F.lit("invalid manifest line: "), "line")).cast("string").alias("md5"),
        F.lit(None).cast("string").alias("rel_path"),
    )
    return require_rows(ok, "md5 manifest is empty").unionByName(broken)


def media_columns(schema: T.StructType) -> list[str]:
    """Binary columns, and structs that carry `bytes` or `array`."""

    def is_media(t: T.DataType) -> bool:
        return isinstance(t, T.BinaryType) or (isinstance(t, T.StructType) and bool({"bytes", "array"} & set(t.fieldNames())))

    return [f.name for f in schema.fields if is_media(f.dataType)]


def drop_media(df: DataFrame) -> DataFrame:
    return df.drop(*media_columns(df.schema))


def stream_live_results(spark: SparkSession, path: str, files_per_trigger: int | None = None, closed: bool = False) -> DataFrame:
    """The growing live results of a run as a stream: lines that are appended to a file are read when they are whole.

    closed: nothing more is written, so a last line without a line feed counts too. files_per_trigger is for folders of
    finished files, of which it takes so many at a time; lines appended to these later are not read.
    """
    if files_per_trigger:
        return _whole_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(expand_path(path)), LIVE)
    return _whole_lines(growing_lines(spark, expand_path(path), closed), LIVE)
