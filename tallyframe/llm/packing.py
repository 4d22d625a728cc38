"""Packing token sequences: Martello-Toth dominance reduction, then best fit for the rest.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most `CAPACITY` counts, whatever the
number of documents. The plan is made on the histogram and says which ranks among the pieces of one length go to which
sequences and places; every piece finds its rank and place in Spark.

Reduction: a set of pieces that fits dominates another when the other's pieces can be placed under distinct pieces of the
first one. For a length L with room R = C - L left: if nothing fits into R, L stays alone; if a piece of exactly R exists,
or no two remaining pieces fit into R together, the longest piece that fits is the best partner; likewise if no three fit
and no two together beat the longest single one. Such sets are fixed for good and the instance shrinks, until nothing
changes. What remains is packed by best fit, longest first.

Ranks: a task numbers its own pieces of each length while it tokenizes, and the numbers of the tasks before are added from
counts, so no length has to meet in one task.

Defined results: null and empty texts are one piece, the end id alone; every document is cut into full pieces and a rest
only where it is longer than the capacity; repeated rows are packed each; no documents give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .kernel import runs
from .tokens import coder

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): rank counts the pieces of one length within a task."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        code = coder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in runs(batch):
                ids, begin = code.encode(data, offsets)
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(ids[begin[i] : begin[i + 1]].astype("<u4"), np.uint32(end_id))
                    raw = memoryview(own.tobytes())
                    for k, at in enumerate(range(0, len(own), capacity)):
                        n = min(capacity, len(own) - at)
                        row.append(lo + i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        rank.append(int(seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([task] * len(row), pa.int32()),
                        pa.array(rank, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Plan:
    """Rules (length, first rank, end rank, first sequence, pieces per sequence, offset of the first piece there)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.done = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.rules: list[tuple[int, int, int, int, int, int]] = []
        self.reduced = 0
        self._reduce()
        self._best_fit()

    def _put(self, length: int, n: int, first: int, per: int, offset: int) -> None:
        """n pieces of a length into sequences from `first` on, `per` to each."""
        at = int(self.done[length])
        self.rules.append((length, at, at + n, first, per, offset))
        self.done[length] += n
        self.left[length] -= n

    def _fix(self, lengths: list[int], n: int) -> None:
        """n new sequences of these lengths, closed for good."""
        offset = 0
        for length in lengths:
            self._put(length, n, self.sequences, 1, offset)
            offset += length
        self.sequences += n
        self.reduced += n

    def _longest(self, room: int, without: int = 0) -> int:
        """Longest remaining length that fits into the room; 0 if none. One piece of `without` is taken."""
        own = self.left.copy() if without else self.left
        if without:
            own[without] -= 1
        at = np.flatnonzero(own[: max(room, 0) + 1])
        return int(at[-1]) if len(at) else 0

    def _smallest(self, without: int) -> list[int]:
        """The three shortest remaining pieces besides one of `without`."""
        own = self.left.copy()
        own[without] -= 1
        out: list[int] = []
        for length in np.flatnonzero(own)[:3].tolist():
            out += [length] * min(3 - len(out), int(own[length]))
            if len(out) == 3:
                break
        return out

    def _best_pair(self, room: int, without: int) -> int:
        """Largest sum of two remaining pieces that fits into the room."""
        own = self.left.copy()
        own[without] -= 1
        at, best = np.flatnonzero(own), 0
        j = len(at) - 1
        for i in range(len(at)):
            while j >= i and at[i] + at[j] > room:
                j -= 1
            if j < i:
                break
            k = j
            if k == i and own[at[i]] < 2:
                continue
            best = max(best, int(at[i] + at[k]))
        return best

    def _reduce(self) -> None:
        full = self.capacity
        if self.left[full]:
            self._fix([full], int(self.left[full]))
        changed = True
        while changed:
            changed = False
            for length in range(full - 1, 0, -1):
                while self.left[length] > 0:
                    room = full - length
                    partner = self._longest(room, length)
                    if not partner:
                        self._fix([length], int(self.left[length]))
                        changed = True
                        continue
                    small = self._smallest(length)
                    single = partner == room or len(small) < 2 or small[0] + small[1] > room
                    if not single and not ((len(small) < 3 or sum(small) > room) and self._best_pair(room, length) <= partner):
                        break
                    # all this stays true while fewer pieces remain, so equal sets are fixed together
                    n = self.left[length] // 2 if partner == length else min(self.left[length], self.left[partner])
                    self._fix([length, partner], int(n))
                    changed = True

    def _best_fit(self) -> None:
        full = self.capacity
        open_: list[list[tuple[int, int]]] = [[] for _ in range(full + 1)]  # by room: (first sequence, how many)
        for length in range(full - 1, 0, -1):
            while (n := int(self.left[length])) > 0:
                room = next((r for r in range(length, full) if open_[r]), full)
                first, many = open_[room].pop() if room < full else (self.sequences, n)
                per = room // length
                whole = min(many, n // per)
                take, used = (whole * per, whole) if whole else (n, 1)
                per = per if whole else n
                self._put(length, take, first, per, full - room)
                if room == full:
                    self.sequences += used
                elif many > used:
                    open_[room].append((first + used, many - used))
                if room - per * length:
                    open_[room - per * length].append((first, used))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and overall rank within it."""
        rules = np.array(sorted(self.rules), np.int64).reshape(-1, 6)
        base = np.searchsorted(rules[:, 0], np.arange(self.capacity + 2))
        out = np.zeros(len(length), np.int64)
        for value in np.unique(length).tolist():
            mine = length == value
            starts = rules[base[value] : base[value + 1], 1]
            out[mine] = base[value] + np.searchsorted(starts, rank[mine], "right") - 1
        r = rules[out]
        k = rank - r[:, 1]
        return r[:, 3] + k // r[:, 4], r[:, 5] + k % r[:, 4] * length


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces. The histogram is all that the driver sees of them."""
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    numbered = stored(by_task.withColumn("before", before), "lengths")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = cut.join(numbered.select("task", "length", "before"), ["task", "length"]).select(*kept, (F.col("before") + F.col("rank")).alias("rank"))

    def run(batches):
        for batch in batches:
            seq, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(seq), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it is in its document and in its sequence."""
    return pack(stored(pieces(docs, tokenizer, end_id, capacity, id_col, text), "pieces"), capacity)
