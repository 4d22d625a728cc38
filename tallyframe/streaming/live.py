"""Accuracy of a run while its results are still being written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through and remembers the key for a time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        if not self.seen.exists():
            first = next(rows)
            self.seen.update((timer_values.getCurrentProcessingTimeInMs(),))
            yield first

    def close(self) -> None:
        pass


def dedupe_live(stream: DataFrame, time_column: str | None = None, delay: str | None = None, ttl_seconds: float | None = None) -> DataFrame:
    """The same question counts once.

    The state is bounded by the question set; with a time column by the delay; without one, ttl_seconds bounds it: a key
    is forgotten so long after it was first seen, and counts again if it comes later. That form keeps its state in RocksDB,
    which it selects for the session; it needs the stream's own processing time and append or update mode.
    """
    keys = ["task_name", "doc_id"]
    if time_column:
        return stream.withWatermark(time_column, delay or "1 hour").dropDuplicatesWithinWatermark(keys)
    if ttl_seconds:
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        first = _FirstOfKey(int(ttl_seconds * 1000))
        return stream.groupBy(*keys).transformWithState(statefulProcessor=first, outputStructType=stream.schema, outputMode="append", timeMode="ProcessingTime")
    return stream.dropDuplicates(keys)


def live_accuracy(stream: DataFrame) -> DataFrame:
    """Count, parsed count and mean accuracy per task and question class. Works on streams and tables."""
    s = F.col("metrics.oos_score")
    rows = stream.select(
        "task_name",
        s["question_class"].alias("question_class"),
        s["accuracy"].alias("accuracy"),
        F.coalesce(s["parsed"], F.lit(False)).alias("parsed"),
    )
    return rows.groupBy("task_name", "question_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("parsed").cast("bigint")).alias("parsed"),
        F.avg("accuracy").alias("accuracy"),
    )


def write_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete", once: bool = False):
    """Starts the query: every trigger writes a full (complete) or partial (append) table below path/batch=N.

    Rewriting a batch folder after a restart gives the same content, so readers see each batch once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def on_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn).start()
