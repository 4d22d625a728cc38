"""Token ids in files of length-delimited binary records, with a separate index for reads in any order.

A record is: length of the data (8 bytes, little-endian), masked CRC-32C of those 8 bytes, the data, masked CRC-32C of the
data; the mask is rotate-right by 15 plus 0xA282EAD8. Data are a flag (1: there is an id), the document id (8 bytes) and
the token ids, 2 bytes each where the vocabulary has up to 65,536 entries and else 4. The index file beside it has, per
record, its place in the file and its number of ids (8 bytes each).

Documents are put in order of their ids by range; a task writes one pair of files under a name of its own, and the
manifest, a table, says which files count. A task that is run again leaves files that no manifest names.

Defined results: null and empty texts are the end id alone; equal ids are in the order of a hash of their texts; a null id
comes first and is read back as null; no documents give no rows. A checksum that does not fit raises an error.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored
from .kernel import runs
from .tokens import coder

_HEAD = 9
_READ_BYTES = 4 << 20
#: UTF-8 bytes of text in a file, about.
SHARD_BYTES = 16 << 20


def _crc_tables() -> np.ndarray:
    """Four tables of CRC-32C (reflected polynomial 0x82F63B78), for four bytes at a time."""
    t = np.zeros((4, 256), np.uint32)
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0x82F63B78), r >> 1)
    t[0] = r
    for k in range(1, 4):
        t[k] = t[0][t[k - 1] & 255] ^ (t[k - 1] >> 8)
    return t


_T = _crc_tables()
_BLOCK = 256


def _zeros_operator(n: int) -> np.ndarray:
    """Tables that carry a register over n zero bytes."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        r = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(n):
            r = _T[0][r & 255] ^ (r >> 8)
        out[k] = r
    return out


def _apply(table: np.ndarray, r: np.ndarray) -> np.ndarray:
    return table[0][r & 255] ^ table[1][(r >> 8) & 255] ^ table[2][(r >> 16) & 255] ^ table[3][r >> 24]


_over_block = _zeros_operator(_BLOCK)
_over_power = [_zeros_operator(1)]


def _over(lengths: np.ndarray) -> np.ndarray:
    """The starting register 0xFFFFFFFF carried over so many zero bytes each, by powers of two."""
    r = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    k = 0
    while (lengths >> k).any():
        if k == len(_over_power):
            last = _over_power[-1]
            _over_power.append(np.stack([_apply(last, row) for row in last]))
        on = (lengths >> k) & 1 == 1
        r[on] = _apply(_over_power[k], r[on])
        k += 1
    return r


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of byte spans, all at once: spans are padded in front to whole blocks, which a zero register ignores."""
    n = end - start
    blocks = -(-n // _BLOCK)
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    to = (first + blocks) * _BLOCK - n
    padded[_spread(to, n)] = data[_spread(start, n)]
    words = padded.view("<u4").reshape(-1, _BLOCK // 4)
    r = np.zeros(len(words), np.uint32)
    for k in range(_BLOCK // 4):
        x = r ^ words[:, k]
        r = _T[3][x & 255] ^ _T[2][(x >> 8) & 255] ^ _T[1][(x >> 16) & 255] ^ _T[0][x >> 24]
    out, at, alive = np.zeros(len(n), np.uint32), 0, np.arange(len(n))
    while len(alive := alive[blocks[alive] > at]):
        out[alive] = _apply(_over_block, out[alive]) ^ r[first[alive] + at]
        at += 1
    return out ^ _over(n) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) for each span, one after the other."""
    total = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(start - total[:-1], n) + np.arange(total[-1])


def framed(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of the data between starts (n + 1 of them), as bytes, and where each record begins."""
    n = np.diff(start)
    at = np.concatenate([[0], np.cumsum(n + 16)])
    out = np.zeros(int(at[-1]), np.uint8)
    heads = n.astype("<u8").view(np.uint8)
    eight = np.full(len(n), 8)
    out[_spread(at[:-1], eight)] = heads
    put = lambda where, crc: out.__setitem__(_spread(where, np.full(len(n), 4)), masked(crc).astype("<u4").view(np.uint8))
    put(at[:-1] + 8, crc32c(heads, np.arange(len(n)) * 8, np.arange(len(n)) * 8 + 8))
    out[_spread(at[:-1] + 12, n)] = data[: start[-1]]
    put(at[1:] - 4, crc32c(data, start[:-1], start[1:]))
    return out, at


def checked(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the data of records begin and end; at: where the records do. Lengths and checksums must fit."""
    begin, end = at[:-1] + 12, at[1:] - 4
    word = lambda where, k: np.ascontiguousarray(raw[where[:, None] + np.arange(k)])
    length = word(at[:-1], 8).view("<u8").ravel().astype(np.int64)
    good = length == end - begin
    good &= word(at[:-1] + 8, 4).view("<u4").ravel() == masked(crc32c(raw, at[:-1], at[:-1] + 8))
    good &= word(end, 4).view("<u4").ravel() == masked(crc32c(raw, begin, end))
    if not good.all():
        raise ValueError(f"record {int(np.argmin(good))}: length or checksum does not fit")
    return begin, end


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files; the manifest (shard, path, width, documents, tokens), shards in order of ids."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        code, out, tokens, at, places, sizes = coder(tokenizer), None, 0, 0, [], []
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids_in = batch.column("doc_id")
            numbers = np.asarray(ids_in.fill_null(0).to_numpy(zero_copy_only=False), "<i8")
            flag = np.asarray(ids_in.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            for lo, hi, data, offsets in runs(batch):
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name.rpartition('/')[2]}.records")
                ids, begin = code.encode(data, offsets)
                n = np.diff(begin) + 1
                own = np.full(int(n.sum()), end_id, code.width)
                own[_spread(np.cumsum(n) - n, n - 1)] = ids
                width = code.width().itemsize
                start = np.concatenate([[0], np.cumsum(_HEAD + n * width)])
                body = np.zeros(int(start[-1]), np.uint8)
                body[start[:-1]] = flag[lo:hi]
                body[_spread(start[:-1] + 1, np.full(len(n), 8))] = numbers[lo:hi].view(np.uint8)
                body[_spread(start[:-1] + _HEAD, n * width)] = own.astype(f"<u{width}").view(np.uint8)
                raw, edge = framed(body, start)
                out.write(raw.tobytes())
                places.append(at + edge[:-1])
                sizes.append(n)
                at, tokens = at + len(raw), tokens + int(n.sum())
        if out is None:
            return
        out.close()
        index = np.stack([np.concatenate(places), np.concatenate(sizes)], 1).astype("<i8")
        with store.open_output_stream(f"{path}/{name.rpartition('/')[2]}.index") as f:
            f.write(index.tobytes())
        row = [[TaskContext.get().partitionId()], [name], [code.width().itemsize], [len(index)], [tokens], [at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["shard", "path", "width", "documents", "tokens", "size"])

    # rows beside the id and the text do not move; the hash orders and spreads rows of one id
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_hash"))
    ordered = source.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash")
    return stored(ordered.mapInArrow(run, "shard bigint, path string, width bigint, documents bigint, tokens bigint, size bigint"), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, in files' order; start counts the ids of all before it."""
    base = F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")  # one row per file
    files = stored(manifest.withColumn("base", base), "manifest")
    many = max(1, files.count())

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                folder, _, name = row["path"].rpartition("/")
                store, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
                with store.open_input_stream(f"{path}/{name}.index") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                edge, n = np.append(index[:, 0], row["size"]), index[:, 1]
                first = row["base"] + np.cumsum(n) - n
                with store.open_input_stream(f"{path}/{name}.records") as f:
                    lo = 0
                    while lo < len(n):
                        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + _READ_BYTES, "right")) - 1)
                        raw = np.frombuffer(f.read(int(edge[hi] - edge[lo])), np.uint8)
                        begin, end = checked(raw, edge[lo : hi + 1] - edge[lo])
                        number = np.ascontiguousarray(raw[begin[:, None] + np.arange(1, _HEAD)]).view("<i8").ravel()
                        crc = [zlib.crc32(raw[a + _HEAD : b].view(f"<u{row['width']}").astype("<u4").tobytes()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number, mask=raw[begin] == 0), pa.array(first[lo:hi]), pa.array(n[lo:hi].astype(np.int64)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        lo = hi

    return files.repartitionByRange(many, "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def record_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes documents as record files below the scratch folder, as many as their size asks for, and gives their manifest."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    return write_records(docs, tokenizer, end_id, scratch_path(spark, "records"), shards, id_col, text)
