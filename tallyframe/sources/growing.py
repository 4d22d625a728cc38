"""Text files that grow while they are read: a stream whose offset is a byte position per file.

Spark's own file source reads a file once, when it first sees it. Results of a run are appended line by line, so here an
offset maps every file to the end of its last whole line. A trigger reads what lies between two offsets, in ranges of
`RANGE` bytes that begin and end at lines; a line that is still being written waits for its line feed; a restart goes on
from the checkpointed offset. Ranges are read where they are processed; the driver only lists files and looks for the last
line feed of those that grew.

Defined results: empty lines are lines; bytes that are no UTF-8 become U+FFFD; files whose names begin with a dot or an
underscore are not read; a file that is gone or shorter than what was read is an error, as its lines cannot be read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
BLOCK = 4 << 20
_LOOK = 1 << 16


def _store(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/*", "file:///", path)
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class _Range(InputPartition):
    """Bytes lo to hi of a file of which `end` are read in this trigger; `head`: lo is the beginning of a line."""

    def __init__(self, path: str, lo: int, hi: int, end: int, head: bool):
        super().__init__(path)
        self.path, self.lo, self.hi, self.end, self.head = path, lo, hi, end, head


def _after_line(source, at: int, end: int) -> int:
    """Where the first line that begins after `at` begins, or the end."""
    while at < end:
        source.seek(at)
        block = source.read(min(_LOOK, end - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return end


def _last_line_end(source, end: int) -> int:
    """The end of the last whole line before `end`."""
    while end > 0:
        start = max(0, end - _LOOK)
        source.seek(start)
        found = source.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, closed: bool):
        self.path, self.closed = path, closed
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of the last whole line of each file

    def initialOffset(self) -> dict:
        return {}

    def _files(self):
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return store, sorted((f.path, f.size) for f in found if f.is_file and f.base_name[:1] not in "._")

    def latestOffset(self) -> dict:
        store, files = self._files()
        for path, size in files:
            if self.seen.get(path, (-1, 0))[0] != size:
                end = size
                if not self.closed:
                    with store.open_input_file(path) as source:
                        end = _last_line_end(source, size)
                self.seen[path] = (size, end)
        return {path: end for path, (_, end) in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        lost = [p for p, at in start.items() if end.get(p, at) < at or p not in end]
        if lost:
            raise ValueError(f"files were cut or removed after they had been read: {', '.join(sorted(lost)[:5])}")
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            out += [_Range(path, lo, min(lo + RANGE, stop), stop, lo == first) for lo in range(first, stop, RANGE)]
        return out

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as source:
            lo = partition.lo if partition.head else _after_line(source, partition.lo - 1, partition.end)
            hi = partition.end if partition.hi == partition.end else _after_line(source, partition.hi - 1, partition.end)
            source.seek(lo)
            left = b""
            while lo < hi:
                block = source.read(min(BLOCK, hi - lo))
                if not block:
                    raise ValueError(f"{partition.path} became shorter while it was read")
                lo += len(block)
                whole, feed, left = (left + block).rpartition(b"\n") if lo < hi else (left + block, b"\n", b"")
                if feed:
                    lines = whole.removesuffix(b"\n").split(b"\n") if lo == hi else whole.split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines], pa.string())], names=["value"])


class GrowingLines(DataSource):
    """Format `growing_lines`: lines of the files in a folder, or of one file. Option closed: the last line needs no line feed."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(self.options["path"], self.options.get("closed", "false").lower() == "true")


def growing_lines(spark: SparkSession, path: str, closed: bool = False) -> DataFrame:
    """The lines (value) of growing files as a stream."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("closed", str(closed).lower()).load(path)
