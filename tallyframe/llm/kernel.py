"""Words, hashes and n-grams of whole Arrow text columns at once, without a Python loop over words.

Everything works on the UTF-8 bytes of a column. Texts are taken in runs of a few MB, so memory follows the run (or the
longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_BACK = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
IN_WORD = np.ones(256, bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, RUN_BYTES)
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


class Words:
    """The words of some texts: byte positions, and for text d the words first[d] to first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = IN_WORD[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts that are not empty
        start[edges] |= inside[edges]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[lasts] |= inside[lasts]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """One 64-bit hash per word; with fold, A-Z count as a-z."""
        return span_hashes(self.data, self.start, self.end, fold)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of byte spans that are in order and do not overlap: differences of one running polynomial sum."""
    out = np.empty(len(start), np.uint64)
    letters, lo = (_FOLDED if fold else _LETTERS), 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + RUN_BYTES, "right")))
        size = int(end[hi - 1]) - base
        up, down = _power(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(letters[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
        lo = hi
    return mixed(out)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each position but the last n - 1, texts not told apart."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _PLACES[k]
    return mixed(out)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each text, one after the other, and where each text's begin.

    A text of 1 to n - 1 words has one shingle: the whole sequence. A text without words has none.
    """
    h = words.hashes()
    grams = ngrams(h, n)
    sets = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            sets.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            sets.append(mixed((h[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _U(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    starts = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), starts


def _give_back() -> None:
    """Returns memory of finished runs to the system: workers stay, and share their executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def runs(batch: pa.RecordBatch, text: str = "text", size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `size` bytes of text together."""
    _give_back()
    data, offsets = utf8(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
