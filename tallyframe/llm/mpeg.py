"""MPEG audio in binary columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

`parse` reads any stream of MPEG 1, 2 or 2.5 audio, layers I to III: it skips an ID3v2 tag and APE and Lyrics3 tags at the end
and keeps text fields of ID3v2 and ID3v1, finds frames by their headers, resynchronises after anything else, reads Xing,
Info and VBRI tables with their seek entries, verifies the CRC-16 of protected layer III frames (those of layers I and II
are counted as not verified), and gives the exact duration in samples and the byte offset of every audio frame.

A header stands when another of its family, or the end, is where its length says. Where it does not, its checksum vouches
for it, or the frame before it if that one ended just there, unless a frame that stands begins inside: so a whole frame
beside inserted bytes is kept and a cut one is not.

`store` keeps arbitrary bytes in silent layer III frames: 48 kHz, mono, 80 kbit/s, 240 bytes, protected, with no main data,
so that the 192 bytes after the side information are ancillary. An ID3v2 tag keeps the number of bytes before padding, a
first frame has a Xing table, an ID3v1 tag closes the stream.

Defined results: a null text is empty; an empty one is stored as 192 blanks; equal texts give equal streams; bytes without
any frame give 0 frames, no rate and no offsets; null bytes count as empty; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .kernel import runs

UNIT = 192
#: kbit/s by index, for MPEG 1 layers I, II, III and for MPEG 2 layers I and II/III.
RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame length, samples and rate by the 16 bits version(2) layer(2) protection(1) rate(4) hertz(2) padding(1), 12 in all."""
    length, samples, hertz = (np.zeros(1 << 12, np.int64) for _ in range(3))
    for version in (0, 2, 3):
        for bits in (1, 2, 3):
            layer = 4 - bits
            rates = RATES[(1, layer)] if version == 3 else RATES[(2, 1 if layer == 1 else 2)]
            per = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            for rate in range(1, 15):
                for hz in range(3):
                    for low in range(4):
                        protection, padding = low >> 1, low & 1
                        key = version << 10 | bits << 8 | protection << 7 | rate << 3 | hz << 1 | padding
                        f = HERTZ[version][hz]
                        size = (12000 * rates[rate] // f + padding) * 4 if layer == 1 else per // 8 * 1000 * rates[rate] // f + padding
                        length[key], samples[key], hertz[key] = size, per, f
    return length, samples, hertz


_LENGTH, _SAMPLES, _HERTZ = _tables()
_CRC = np.zeros(256, np.uint16)
for _i in range(256):
    _r = _i << 8
    for _ in range(8):
        _r = (_r << 1 ^ 0x8005 if _r & 0x8000 else _r << 1) & 0xFFFF
    _CRC[_i] = _r


def crc16(columns: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of the rows of a byte array."""
    r = np.full(len(columns), 0xFFFF, np.uint16)
    for k in range(columns.shape[1]):
        r = (r << np.uint16(8)) ^ _CRC[(r >> np.uint16(8)) ^ columns[:, k]]
    return r


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    hertz: int = 0
    samples: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    table: dict[str, int] = field(default_factory=dict)
    crc_good: int = 0
    crc_bad: int = 0
    unverified: int = 0
    seek: list[int] = field(default_factory=list)
    resyncs: int = 0
    end_tag: bool = False


def _id3v2(raw: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading tag and where the audio begins."""
    if raw[:3] != b"ID3" or len(raw) < 10 or max(raw[6:10]) > 127:
        return {}, 0
    size = raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9]
    body, at, tags = raw[10 : 10 + size], 0, {}
    while at + 10 <= len(body) and body[at] != 0:
        name = body[at : at + 4].decode("latin-1")
        n = (lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3])(body[at + 4 : at + 8]) if raw[3] >= 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        data = body[at + 10 : at + 10 + n]
        if name[0] == "T" and data:
            text = data[1:].decode(["latin-1", "utf-16", "utf-16-be", "utf-8"][min(data[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text.rstrip("\0"))
            tags[key] = value
        at += 10 + n
    return tags, min(len(raw), 10 + size + (10 if raw[5] & 16 else 0))


#: Fields of an ID3v1 tag: name in ID3v2, place and length.
_ID3V1 = [("TIT2", 3, 30), ("TPE1", 33, 30), ("TALB", 63, 30), ("TYER", 93, 4), ("COMM", 97, 30)]


def _end_tags(raw: bytes, at: int, tags: dict[str, str]) -> tuple[int, bool]:
    """Where the audio ends, before ID3v1, APE and Lyrics3 tags in any order, and whether there is an ID3v1 tag."""
    end, old = len(raw), False
    while True:
        if not old and end - at >= 128 and raw[end - 128 : end - 125] == b"TAG":
            for name, place, n in _ID3V1:
                text = raw[end - 128 + place : end - 128 + place + n].split(b"\0")[0].decode("latin-1").strip()
                if text:
                    tags.setdefault(name, text)
            end, old = end - 128, True
        elif end - at >= 32 and raw[end - 32 : end - 24] == b"APETAGEX":
            flags = int.from_bytes(raw[end - 12 : end - 8], "little")
            size = int.from_bytes(raw[end - 20 : end - 16], "little") + (32 if flags >> 31 else 0)
            if not 32 <= size <= end - at:
                return end, old
            end -= size
        elif end - at >= 15 and raw[end - 9 : end] == b"LYRICS200" and raw[end - 15 : end - 9].isdigit():
            size = int(raw[end - 15 : end - 9]) + 15
            if size > end - at:
                return end, old
            end -= size
        else:
            return end, old


def _vbr_seek(raw: bytes, at: int, version: int, mono: bool) -> list[int]:
    """Seek entries: the 100 places of a Xing table in 256ths of the stream, or the bytes per entry of a VBRI table."""
    place = at + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    if raw[place : place + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(raw[place + 4 : place + 8], "big")
        p = place + 8 + 4 * (flags & 1) + 4 * (flags >> 1 & 1)
        return list(raw[p : p + 100]) if flags & 4 else []
    if raw[at + 36 : at + 40] == b"VBRI":
        n, scale, width = (int.from_bytes(raw[at + k : at + k + 2], "big") for k in (54, 56, 58))
        body = raw[at + 62 : at + 62 + n * width]
        return [int.from_bytes(body[k : k + width], "big") * scale for k in range(0, len(body) - width + 1, width)] if width else []
    return []


def _sides(b: np.ndarray, sync: np.ndarray, key: np.ndarray, end: int):
    """Protected layer III frames, by the length of their side information: (which, whether the checksum is right)."""
    guarded = np.flatnonzero(((key >> 7 & 1) == 0) & ((key >> 8 & 3) == 1))
    mono, old = b[sync[guarded] + 3] >> 6 == 3, key[guarded] >> 10 != 3
    for is_mono, is_old, side in ((True, False, 17), (False, False, 32), (True, True, 9), (False, True, 17)):
        which = guarded[(mono == is_mono) & (old == is_old)]
        which = which[sync[which] + 6 + side <= end]
        if len(which):
            s = sync[which]
            want = b[s + 4].astype(np.uint16) << np.uint16(8) | b[s + 5]
            yield which, crc16(b[s[:, None] + np.array([2, 3, *range(6, 6 + side)])]) == want


def _vbr_table(raw: bytes, at: int, version: int, mono: bool) -> dict[str, int]:
    place = at + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    name = raw[place : place + 4]
    if name in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(raw[place + 4 : place + 8], "big"), place + 8, {"vbr": int(name == b"Xing")}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(raw[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc_crc32"] = zlib.crc32(raw[p : p + 100])
        return out
    if raw[at + 36 : at + 40] == b"VBRI":
        return {"vbr": 1, "bytes": int.from_bytes(raw[at + 46 : at + 50], "big"), "frames": int.from_bytes(raw[at + 50 : at + 54], "big")}
    return {}


def parse(raw: bytes) -> Stream:
    out = Stream()
    out.tags, at = _id3v2(raw)
    b = np.frombuffer(raw, np.uint8)
    end, out.end_tag = _end_tags(raw, at, out.tags)
    sync = np.flatnonzero((b[at : max(at, end - 3)] == 0xFF) & (b[at + 1 : max(at + 1, end - 2)] >= 0xE0)) + at
    key = ((b[sync + 1].astype(np.int64) >> 3 & 3) << 10) | ((b[sync + 1].astype(np.int64) >> 1 & 3) << 8) | ((b[sync + 1].astype(np.int64) & 1) << 7)
    key |= (b[sync + 2].astype(np.int64) >> 4 << 3) | ((b[sync + 2].astype(np.int64) >> 2 & 3) << 1) | (b[sync + 2].astype(np.int64) >> 1 & 1)
    size = _LENGTH[key]
    family = key >> 8 << 2 | (key >> 1 & 3)  # version, layer and sampling rate, which a stream keeps
    sync, key, size, family = sync[size > 0], key[size > 0], size[size > 0], family[size > 0]
    # a header stands when its frame ends where another of its family begins, or at the end
    after = np.searchsorted(sync, sync + size)
    follows = (after < len(sync)) & (sync[np.minimum(after, len(sync) - 1)] == sync + size) & (family[np.minimum(after, len(sync) - 1)] == family) if len(sync) else np.zeros(0, bool)
    stood = follows | (sync + size == end)
    checked, open_ = np.zeros(len(sync), bool), np.flatnonzero(~stood & (sync + size <= end))
    for which, good in _sides(b, sync[open_], key[open_], end):
        checked[open_[which[good]]] = True
    stands, upcoming = stood.tolist(), np.append(np.flatnonzero(stood), len(sync))
    nxt, frames, i, expected, n = after.tolist(), [], 0, at, sync.tolist()
    while i < len(n):
        whole = n[i] + int(size[i])
        keep = stands[i]
        if not keep and (checked[i] or (frames and n[i] == expected and family[i] == family[frames[-1]] and whole <= end)):
            # its checksum or the frame before vouches for it, unless one that stands begins inside
            later = int(upcoming[np.searchsorted(upcoming, i)])
            keep = later == len(n) or n[later] >= whole
        if keep:
            if n[i] != expected:
                out.resyncs += 1
            frames.append(i)
            expected = whole
            i = nxt[i]
        else:
            i += 1
    if frames and expected != end:
        out.resyncs += 1
    f = np.array(frames, np.int64)
    if len(f):
        first = int(f[0])
        out.table = _vbr_table(raw, n[first], int(key[first] >> 10), bool(b[n[first] + 3] >> 6 == 3))
        audio = f[1:] if out.table else f
        out.offsets, out.lengths = sync[audio], size[audio]
        out.hertz, out.samples = int(_HERTZ[key[first]]), int(_SAMPLES[key[audio]].sum())
        out.seek = _vbr_seek(raw, n[first], int(key[first] >> 10), bool(b[n[first] + 3] >> 6 == 3)) if out.table else []
        out.unverified = int((((key[f] >> 7 & 1) == 0) & ((key[f] >> 8 & 3) != 1)).sum())
        for which, good in _sides(b, sync[f], key[f], end):
            out.crc_good += int(good.sum())
            out.crc_bad += int((~good).sum())
    return out


_HEAD = bytes([0xFF, 0xFA, 6 << 4 | 1 << 2, 0xC0])
_SIDE = 17
_FRAME = 240
_BLANK = np.zeros(_FRAME, np.uint8)
_BLANK[:4] = list(_HEAD)
_BLANK[4:6] = list(int(crc16(_BLANK[None, [2, 3, *range(6, 6 + _SIDE)]])[0]).to_bytes(2, "big"))


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def store(payload: np.ndarray, n_bytes: int) -> bytes:
    """A stream that carries the payload, a multiple of UNIT bytes."""
    k = len(payload) // UNIT
    frames = np.tile(_BLANK, (k, 1))
    frames[:, 6 + _SIDE : 6 + _SIDE + UNIT] = payload.reshape(k, UNIT)
    text = b"\x03n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    total = 192 + k * _FRAME
    places = bytes(min(255, (192 + k * i // 100 * _FRAME) * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 15, k, total) + places + struct.pack(">I", 0)
    first = bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]) + bytes(_SIDE) + table
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + first.ljust(192, b"\0") + frames.tobytes() + b"TAG".ljust(128, b"\0")


def payload_of(raw: bytes, stream: Stream) -> np.ndarray:
    """The bytes that `store` put into the frames."""
    b = np.frombuffer(raw, np.uint8)
    return b[stream.offsets[:, None] + np.arange(6 + _SIDE, 6 + _SIDE + UNIT)].ravel()


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes, padded with blanks, as a stored stream."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in runs(batch):
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = np.full(max(UNIT, -(-(b - a) // UNIT) * UNIT), 32, np.uint8)
                    payload[: b - a] = data[a:b]
                    rows.append(store(payload, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["doc_id", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, media binary"), "media", codec="zstd")


INDEX = "hertz int, samples bigint, frames bigint, offsets array<bigint>, tags map<string,string>, vbr map<string,bigint>, crc_good bigint, crc_bad bigint, resyncs bigint, unverified bigint, seek array<bigint>"


def media_index(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """Per row of a media column: exact duration (samples at hertz), seek offsets, tags, VBR table, checksum results."""

    def run(batches):
        for batch in batches:
            s = [parse(x or b"") for x in batch.column("media").to_pylist()]
            cols = [
                pa.array([x.hertz for x in s], pa.int32()),
                pa.array([x.samples for x in s], pa.int64()),
                pa.array([len(x.offsets) for x in s], pa.int64()),
                pa.array([x.offsets for x in s], pa.list_(pa.int64())),
                pa.array([list(x.tags.items()) for x in s], pa.map_(pa.string(), pa.string())),
                pa.array([list(x.table.items()) for x in s], pa.map_(pa.string(), pa.int64())),
                pa.array([x.crc_good for x in s], pa.int64()),
                pa.array([x.crc_bad for x in s], pa.int64()),
                pa.array([x.resyncs for x in s], pa.int64()),
                pa.array([x.unverified for x in s], pa.int64()),
                pa.array([x.seek for x in s], pa.list_(pa.int64())),
            ]
            names = ["hertz", "samples", "frames", "offsets", "tags", "vbr", "crc_good", "crc_bad", "resyncs", "unverified", "seek"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("doc_id"), F.col(column).alias("media")).mapInArrow(run, f"doc_id {kind}, {INDEX}")


def read_back(media: DataFrame) -> DataFrame:
    """What the stored streams hold: sizes, digests, a line of features, the duration and the offset of every frame."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in (x.as_buffer().to_pybytes() for x in batch.column("media")):
                s = parse(raw)
                body = payload_of(raw, s).tobytes()
                feature = (
                    f"hz={s.hertz};frames={len(s.offsets)};samples={s.samples};us={s.samples * 1_000_000 // max(1, s.hertz)};vbr={s.table.get('vbr', 0)};"
                    f"table={s.table.get('frames', -1)}/{s.table.get('bytes', -1)}/{s.table.get('toc_crc32', 0)};crc={s.crc_good}/{s.crc_bad};resync={s.resyncs};"
                    f"seek={zlib.crc32(s.offsets.astype('<i8').tobytes())}"
                )
                digests = hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(raw), hashlib.sha256(raw).hexdigest()
                rows.append((int(s.tags["n_bytes"]), len(body), *digests, feature, s.hertz, s.samples, s.offsets))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hertz", "samples", "offsets"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, hertz int, samples bigint, offsets array<bigint>"
    return media.mapInArrow(run, schema)
