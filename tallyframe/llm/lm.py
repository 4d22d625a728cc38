"""Language-model scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and read through memory maps.

With c the count of a word pair (v, w), N_k(v.) how many words follow v exactly k times (3: three times or more), and
N(.w) how many different words come before w,

    p(w | v) = (c(v, w) - D(c(v, w))) / c(v.) + (D1 N_1(v.) + D2 N_2(v.) + D3 N_3(v.)) / c(v.) * p(w)
    p(w)     = (N(.w) - E(N(.w))) / N(..) + (rest of the mass) / (V + 1)

with discounts D and E from the counts of counts, Y = n1 / (n1 + 2 n2), D_k = k - (k + 1) Y n_(k+1) / n_k. A context that was
never seen leaves p(w) alone; a text begins in a context of its own and ends with an end token.

With order 3, c(v, w) above is how many different words come before the pair (v, w), and on top of it, with c now the count
of a word triple, p(w | u, v) is the same formula over the contexts (u, v), with discounts F of its own and p(w | v) for p(w).
The first word of a text has two begin tokens before it.

Counting: tasks add up the triples (u, v, w) of a few MB of text and send them to the bucket of the middle word v. There the
contexts (u, v), the pairs (v, w) and the facts of v are complete, so triples are shuffled once. Middle words that are common
are spread, by the word before them and, if that is common too, by all three; their pairs, and contexts of two common words,
are brought together in a second, small exchange, and how many words come before w in a third. Triples travel as codes:
two bytes for the most frequent words (a code book of bounded size), six bytes for others. Buckets are counted in `PASSES`
rounds, and a round's shuffle files are removed when its tables are written, so only a part of the triples is on disk twice.

A bucket's files are sorted hash arrays behind a directory of their first bits: 40 bits of hash per entry. A context with a
single rare continuation keeps just that word and its count; only others keep their facts. Counts are one byte,
larger ones stand in arrays of their own. Scoring maps the files into memory and looks hashes up, so a worker holds no model
in its heap; files of a store that is not a local path are copied for the time of the task. Every distinct word, pair and triple
of a few MB of text is looked up once, in the order of the tables, so that these are read from front to back.

Words are compared by 48-bit hashes and table entries by at least 40 bits inside their part of the directory; chance equality
is neglected. base_score is the add-one unigram log probability over the same tokens.

Defined results: null and empty texts are just the end token; repeated rows count each time; an empty training table gives a
uniform model; no documents give no rows; other columns are kept, `n_tokens`, `n_known`, `base_score` and `score` replaced.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import columns, mapped, stored
from .kernel import Words, mixed, runs

BEGIN, END = np.uint64(0x0123456789AB), np.uint64(0xFEDCBA987654)
#: Tokens in a bucket, about.
BUCKET_PAIRS = 1_500_000
#: The share of all words, and the part of a bucket, from which a middle word is spread.
COMMON, PART = 1e-3, 0.25
#: Words with codes of two bytes, and how many of a run's words may apply.
BOOK, PER_RUN = 60_000, 20_000
#: Rounds of counting, each over a part of the buckets.
PASSES = 2
#: Entries behind one number of a directory, about.
_SLOT = 8
_RUN = 8 << 20
_U = np.uint64


def _sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous word, word, text) of every token of some texts, the end tokens included."""
    words = Words(data, offsets)
    h = words.hashes() >> _U(16)
    n = len(words.count)
    at = words.first[1:] + np.arange(n)  # where the end tokens go
    token = np.empty(len(h) + n, np.uint64)
    inner = np.ones(len(token), bool)
    inner[at] = False
    token[inner], token[~inner] = h, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[words.first[:-1] + np.arange(n)] = BEGIN
    return before, token, np.repeat(np.arange(n), words.count + 1)


def _previous(w: np.ndarray, of: np.ndarray, words: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens given as numbers of words: the word before each, the word before that one (with order 2 the same one for all), and all words."""
    begin, none = len(words), len(words) + 1
    first = np.ones(len(w), bool)
    first[1:] = of[1:] != of[:-1]
    first = np.flatnonzero(first)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first] = begin
    u = np.full_like(w, none)
    if order == 3:
        u[1:] = v[:-1]
        u[first] = begin
    return v, u, np.append(words, np.array([BEGIN, 0], np.uint64))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * _U(0x9E3779B97F4A7C15) + mixed(w + _U(0x7F4A7C15)))


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are among some sorted numbers."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _home(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(word + _U(1)) % _U(buckets)).astype(np.int64)


def _packed(key: np.ndarray, width: int = 64) -> np.ndarray:
    """Places of numbers below 2 ** width in ascending order of their first bits: these and the place are sorted as one number."""
    bits = len(key).bit_length()
    packed = (key >> _U(max(0, width + bits - 64))) << _U(bits) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & _U((1 << bits) - 1)).view(np.int64)


def _order(key: np.ndarray, width: int = 64) -> np.ndarray:
    """Places of numbers below 2 ** width in ascending order, equal ones in order of place."""
    by = _packed(key, width)
    drop = width + len(key).bit_length() - 64
    if drop > 0:  # numbers that are alike in their first bits
        ranked = key[by]
        wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
        if len(wrong) > 1_000:
            return np.argsort(key, kind="stable")
        top = ranked >> _U(drop) if len(wrong) else ranked
        for first in np.unique(top[wrong]):
            a, b = np.searchsorted(top, first), np.searchsorted(top, first, "right")
            by[a:b] = by[a:b][np.argsort(key[by[a:b]], kind="stable")]
    return by


def _distinct(key: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ascending order, and which of them each number is."""
    by = _order(key, width)
    ranked = key[by]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(key), np.int64)
    which[by] = np.cumsum(new) - 1
    return ranked[new], which


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x.astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)


def _parts(bucket: np.ndarray, arrays: list[np.ndarray], buckets: list[int]) -> list[pa.Array]:
    """For each array, in order of its bucket numbers, the part of each of some buckets in binary form."""
    lo, hi = np.searchsorted(bucket, buckets), np.searchsorted(bucket, buckets, "right")
    return [pa.array([a[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()) for a in arrays]


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _six(x: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _words_of(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


_ESCAPE = 65_535


class Book:
    """Two-byte codes of frequent words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.order = np.argsort(words)
        self.sorted = words[self.order]

    def codes(self, words: np.ndarray) -> np.ndarray:
        code = np.full(len(words), _ESCAPE, np.uint16)
        known = _among(words, self.sorted)
        code[known] = self.order[np.searchsorted(self.sorted, words[known])]
        return code

    @staticmethod
    def write(words: np.ndarray, codes: np.ndarray, which: np.ndarray, bucket: np.ndarray, buckets: list[int]) -> list[pa.Array]:
        """Codes of some of the words, and the words that have none, by bucket."""
        code = codes[which]
        rest = np.flatnonzero(code == _ESCAPE)
        return _parts(bucket, [code], buckets) + _parts(bucket[rest], [_six(words[which[rest]])], buckets)

    def read(self, table: pa.Table, name: str) -> np.ndarray:
        code = _joined(table, name, np.uint16)
        out = np.empty(len(code), np.uint64)
        known = code != _ESCAPE
        out[known] = self.words[code[known]]
        out[~known] = _words_of(_joined(table, f"{name}_rest", np.uint8))
        return out


def _frequent_words(docs: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """How many tokens and texts there are, and the words with codes, most frequent first, with their counts, about."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in runs(batch, size=_RUN):
                token = np.sort(_sequence(data, offsets)[1])
                start = _starts(token)
                n = np.diff(np.append(start, len(token)))
                top = np.argsort(-n, kind="stable")[:PER_RUN]
                top = top[n[top] > 2]
                word, n = np.append(token[start[top]].view(np.int64), [-1, -2]), np.append(n[top], [len(token), len(offsets) - 1])
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    counts = stored(docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = {r["word"]: r["n"] for r in counts.where("word < 0").collect()}  # two rows
    top = counts.where("word >= 0").orderBy(F.desc("n"), "word").limit(BOOK).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    return total.get(-1, 0), total.get(-2, 0), words, n


_PIECE = ["v", "v_rest", "u", "u_rest", "w", "w_rest", "nv", "nu", "n"]


def _pieces(docs: DataFrame, book: Book, common: np.ndarray, buckets: int, order: int, turn: int) -> DataFrame:
    """Counted triples of the buckets of one round: middle words, first words of each, third words of these and counts."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in runs(batch, size=_RUN):
                w, of = _sequence(data, offsets)[1:]
                words, w = _distinct(w, 48)
                v, u, words = _previous(w, of, words, order)
                codes, home, often = book.codes(words), _home(words, buckets), _among(words, common)
                bucket = home[v]
                much = np.flatnonzero(often[v])
                context = _pair(words[u[much]], words[v[much]])
                apart = np.where(True if order == 2 else often[u[much]], _pair(context, words[w[much]]), context)
                bucket[much] = (apart % _U(buckets)).astype(np.int64)
                mine = np.flatnonzero(bucket % PASSES == turn)
                u, v, w, bucket = u[mine], v[mine], w[mine], bucket[mine]
                # equal triples side by side but for a few, which their bucket adds up
                size = len(words).bit_length()
                left = 64 - len(mine).bit_length() - int(buckets).bit_length() - size
                if left > 1:
                    half = left // 2
                    key = (bucket << size | v).astype(np.uint64) << _U(left)
                    key |= mixed(u.astype(np.uint64)) >> _U(64 - left + half) << _U(half) | mixed(w.astype(np.uint64)) >> _U(64 - half)
                    by = _packed(key, 64 - len(mine).bit_length())
                else:
                    by = np.lexsort((w, u, v, bucket))
                u, v, w, bucket = u[by], v[by], w[by], bucket[by]
                first = _starts(bucket, v, u, w)
                n = np.diff(np.append(first, len(by)))
                u, v, w, bucket = u[first], v[first], w[first], bucket[first]
                a, b = _starts(bucket, v), _starts(bucket, v, u)
                nv, nu = np.diff(np.append(np.searchsorted(b, a), len(b))), np.diff(np.append(b, len(u)))
                full = np.unique(bucket).tolist()
                cols = book.write(words, codes, v[a], bucket[a], full) + book.write(words, codes, u[b], bucket[b], full) + book.write(words, codes, w, bucket, full)
                cols += _parts(bucket[a], [nv.astype(np.uint32)], full) + _parts(bucket[b], [nu.astype(np.uint32)], full) + _parts(bucket, [n.astype(np.uint32)], full)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *cols], names=["bucket", *_PIECE])

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in _PIECE))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """A file of named arrays; written under another name first, so that a repeated task does no harm."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode()
    own, final = f"{path}/.{name}-{uuid.uuid4().hex}", f"{path}/{name}"
    with store.open_output_stream(own) as out:
        head += b" " * (-(len(head) + 8) % 8)
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    try:
        store.move(own, final)
    except OSError:  # some stores do not replace: another attempt has written the same
        store.delete_file(own)


def _table(name: str, keys: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """A sorted hash array with its directory and values, as arrays of a file; the keys may be in any order."""
    by = slice(None) if (keys[1:] >= keys[:-1]).all() else _order(keys)
    keys = keys[by]
    bits = max(0, int(math.log2(len(keys) / _SLOT))) if len(keys) > _SLOT else 0
    slot = keys >> _U(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    low = (keys << _U(bits)) >> _U(24)
    made = {"dir": np.searchsorted(slot, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32), "hi": (low >> _U(8)).astype(np.uint32), "lo": low.astype(np.uint8)}
    return {f"{name}.{k}": a for k, a in (made | {k: a[by] for k, a in values.items()}).items()}


def _counts(name: str, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Keys with their counts: a byte, or for 255 and more an array of their own."""
    big = np.flatnonzero(n >= 255)
    big = big[np.argsort(keys[big], kind="stable")]
    return _table(name, keys, c=np.minimum(n, 255).astype(np.uint8)) | {f"{name}.key": keys[big], f"{name}.big": n[big].astype(np.uint64)}


def _bisect(hi: np.ndarray, lo: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where a 40-bit number stands in a sorted range a to b, or -1."""
    if not len(hi) or not len(low):
        return np.full(len(low), -1)
    first, second = (low >> _U(8)).astype(np.uint32), low.astype(np.uint8)
    at, width = a.copy(), b - a
    step = 1 << int(width.max()).bit_length() >> 1
    while step:  # at comes to the first number that is not below, or to the end
        if step > _SLOT and 2 * np.count_nonzero(long := width >= step) < len(at):
            some = np.flatnonzero(long)
            m = at[some] + (step - 1)
            at[some[(m < b[some]) & (hi.take(m, mode="clip") < first[some])]] += step
        else:
            m = at + (step - 1)
            less = hi.take(m, mode="clip") < first
            less &= m < b
            at += less * step
        step >>= 1
    like = at < b
    like &= hi.take(at, mode="clip") == first
    hit = lo.take(at, mode="clip") == second
    hit &= like
    out = np.where(hit, at, -1)
    more = np.flatnonzero(like & ~hit)
    while len(more):  # numbers that differ in their last byte alone
        at[more] += 1
        more = more[at[more] < b[more]]
        more = more[hi[at[more]] == first[more]]
        hit = lo[at[more]] == second[more]
        out[more[hit]] = at[more[hit]]
        more = more[~hit]
    return out


class Maps:
    """Files of one kind as memory maps, opened when first needed."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind
        self.open: dict[int, dict[str, np.ndarray]] = {}
        self.copies: list[str] = []

    def __getitem__(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.open:
            store, path = _store(self.folder)
            local = f"{path}/{self.kind}-{k:06d}"
            if store.get_file_info(local).type.name == "NotFound":  # nothing fell into this bucket
                self.open[k] = {}
                return {}
            if store.type_name != "local":
                source_path, (handle, local) = local, tempfile.mkstemp(prefix="model-")
                self.copies.append(local)
                with store.open_input_stream(source_path) as source, os.fdopen(handle, "wb") as out:
                    while block := source.read(1 << 22):
                        out.write(block)
            raw = np.memmap(local, np.uint8, "r")
            at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
            arrays = {}
            for name, (kind, n) in json.loads(raw[8:at].tobytes()).items():
                size = np.dtype(kind).itemsize * n
                arrays[name] = np.asarray(raw[at : at + size]).view(kind)
                at += size + -size % 8
            self.open[k] = arrays
        return self.open[k]

    def close(self) -> None:
        self.open.clear()
        for path in self.copies:
            os.remove(path)

    def each(self, bucket: np.ndarray, keys: np.ndarray):
        """(which, the file's arrays) for the keys of every bucket, in order of the keys: tables are then read from front to back."""
        bits = int(bucket.max()).bit_length() if len(bucket) else 0
        by = _packed(bucket.astype(np.uint64) << _U(64 - bits) | keys >> _U(bits)) if bits else _packed(keys)
        for mine in np.split(by, _starts(bucket[by])[1:]) if len(by) else []:
            arrays = self[int(bucket[mine[0]])]
            if arrays:
                yield mine, arrays

    @staticmethod
    def find(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
        """Places of keys in a table of a file, or -1."""
        directory = arrays[f"{name}.dir"]
        bits = (len(directory) - 1).bit_length() - 1
        slot = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        low = (keys << _U(bits)) >> _U(24)
        return _bisect(arrays[f"{name}.hi"], arrays[f"{name}.lo"], directory.take(slot).astype(np.int64), directory.take(slot + 1).astype(np.int64), low)

    @staticmethod
    def full(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts, those of 255 from the array of large ones."""
        c = c.astype(np.float64)
        much = np.flatnonzero(c == 255)
        if len(much):
            c[much] = arrays[f"{name}.big"][np.searchsorted(arrays[f"{name}.key"], keys[much])]
        return c

    def count(self, bucket: np.ndarray, keys: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(keys))
        for mine, arrays in self.each(bucket, keys):
            at = self.find(arrays, name, keys[mine])
            hit = at >= 0
            out[mine[hit]] = self.full(arrays, name, keys[mine[hit]], arrays[f"{name}.c"][at[hit]])
        return out


def _discounts(of: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the counts of counts 1 to 4; 0.5, 1 and 1.5 where these do not say."""
    n = [0, *map(int, of)]
    out = np.array([0, 0.5, 1.0, 1.5])
    if min(n[1:]) > 0:
        y = n[1] / (n[1] + 2 * n[2])
        d = np.array([0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)])
        if (d >= 0).all():
            out = np.minimum(d, np.arange(4))
    return out


def _few(n: np.ndarray) -> list[int]:
    """How many numbers are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist()


@dataclass
class Model:
    """Where the files are and the few numbers beside them."""

    folder: str
    order: int
    buckets: int
    common: np.ndarray
    f: np.ndarray
    d: np.ndarray
    e: np.ndarray
    kinds: int
    vocabulary: int
    tokens: int
    kept: float
    spread_files: int


#: Rows between the steps: counts of counts, parts of contexts, parts of pairs, facts of a word as context, words before a word.
OF, CONTEXT, PAIR, WORD, AHEAD = range(5)
_FACTS = ["k", "x1", "x2", "x3", "x4", "x5"]
_MADE = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _FACTS) + ", of array<bigint>, total bigint"
_LEVEL = {"contexts": ["following", "n1", "n2", "n3"], "words": ["count", "following", "n1", "n2", "n3", "before"]}
_KINDS = {"count": np.uint64, "following": np.uint64, "n1": np.uint32, "n2": np.uint32, "n3": np.uint32, "before": np.uint32}


class _Rows:
    """Collects the rows a step hands on."""

    def __init__(self):
        self.parts: list[list[pa.Array]] = []

    def add(self, kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> None:
        by = np.argsort(bucket, kind="stable")
        full = np.unique(bucket)
        cols = _parts(bucket[by], [a[by] for a in arrays], full.tolist())
        cols += [pa.nulls(len(full), pa.binary())] * (len(_FACTS) - len(cols))
        self._row(full, kind, cols, pa.nulls(len(full), pa.list_(pa.int64())), pa.nulls(len(full), pa.int64()))

    def number(self, level: int, of: list[int], total: int) -> None:
        self._row(np.array([level]), OF, [pa.nulls(1, pa.binary())] * len(_FACTS), pa.array([of], pa.list_(pa.int64())), pa.array([total], pa.int64()))

    def _row(self, bucket, kind, cols, of, total):
        self.parts.append([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), *cols, of, total])

    def table(self) -> pa.Table:
        cols = [pa.concat_arrays(c) for c in zip(*self.parts, strict=True)]
        return pa.Table.from_arrays(cols, names=["bucket", "kind", *_FACTS, "of", "total"])


def _facts_of(rows: _Rows, v: np.ndarray, w: np.ndarray, ahead: np.ndarray, buckets: int) -> None:
    """What complete pairs say of their first and second words."""
    by = _order(v, 48)
    s, a = _starts(v[by]), ahead[by]
    first = v[by][s]
    rows.add(WORD, _home(first, buckets), _six(first), np.zeros(len(s), np.uint64), _sums(a, s), *[_sums(x, s).astype(np.uint32) for x in (a == 1, a == 2, a >= 3)])
    second = np.sort(w)
    s = _starts(second)
    rows.add(AHEAD, _home(second[s], buckets), _six(second[s]), np.diff(np.append(s, len(w))).astype(np.uint32))


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts the model over all texts of docs and writes its files below the scratch folder."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    docs = columns(docs, [text]).toDF("text")
    tokens, texts, frequent, often = _frequent_words(docs)
    buckets = max(1, math.ceil(tokens / BUCKET_PAIRS))
    much = max(COMMON, PART / buckets) * tokens / 2
    common = np.sort(np.append(frequent[often > much], BEGIN))
    book = Book(frequent)
    folder = scratch_path(docs.sparkSession, "model")

    def count(table: pa.Table) -> pa.Table:
        """Writes a bucket's triples, contexts and complete pairs."""
        bucket, rows = table.column("bucket")[0].as_py(), _Rows()
        nv, nu, n = (_joined(table, c, np.uint32) for c in ("nv", "nu", "n"))
        v, u, w = np.repeat(book.read(table, "v"), nv), book.read(table, "u"), book.read(table, "w")
        context = _pair(u, v)
        triple = _pair(np.repeat(context, nu), w)
        by = _order(context)
        s = _starts(context[by])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(by))))
        u, v, context = (a[by[s]] for a in (u, v, context))
        rank = np.repeat(rank, nu)
        bits = len(context).bit_length()
        by = _order(rank.astype(np.uint64) << _U(64 - bits) | triple >> _U(bits))
        r, t = rank[by], triple[by]
        if ((r[1:] == r[:-1]) & (t[1:] < t[:-1])).any():  # alike in the bits that were compared
            by = np.lexsort((triple, rank))
            r, t = rank[by], triple[by]
        s = _starts(r, t)
        n, w, rank, triple = _sums(n[by], s), w[by[s]], r[s], t[s]
        if order == 3:
            s = _starts(rank)
            size = np.diff(np.append(s, len(rank)))
            facts = [_sums(x, s) for x in (n, n == 1, n == 2, n >= 3)]
            loose = _among(u, common) & _among(v, common)
            plain = ~loose & (size == 1) & (n[s] < 255)
            one, many = np.flatnonzero(plain), np.flatnonzero(~loose & ~plain)
            c = np.minimum(n, 255).astype(np.uint8)
            inside, apart = np.repeat(~loose & ~plain, size), np.repeat(loose, size)
            start = np.cumsum(size[many]) - size[many]
            big = np.flatnonzero(n >= 255)
            big = big[np.argsort(triple[big], kind="stable")]
            files = _table("one", context[one], w=(triple[s[one]] >> _U(32)).astype(np.uint32), c=c[s[one]])
            files |= _table("many", context[many], at=start.astype(np.uint32), size=size[many].astype(np.uint32), **{k: x[many].astype(_KINDS[k]) for k, x in zip(_LEVEL["contexts"], facts, strict=True)})
            low = triple[inside] >> _U(24)
            files |= {"next.hi": (low >> _U(8)).astype(np.uint32), "next.lo": low.astype(np.uint8), "next.c": c[inside], "triples.key": triple[big], "triples.big": n[big]}
            files |= _counts("loose", triple[apart], n[apart])
            _write(folder, f"triples-{bucket:06d}", files)
            rows.number(3, _few(n), int(loose.any()))
            if loose.any():
                key = context[loose]
                rows.add(CONTEXT, (key % _U(buckets)).astype(np.int64), key, facts[0][loose], *[x[loose].astype(np.uint32) for x in facts[1:]])
        v = v[rank]
        pair = _pair(v, w)
        by = _order(pair)
        s = _starts(pair[by])
        raw = _sums(n[by], s)
        ahead = np.diff(np.append(s, len(by))).astype(np.uint64) if order == 3 else raw
        v, w, pair = (a[by[s]] for a in (v, w, pair))
        part = _among(v, common)
        own = ~part
        _write(folder, f"pairs-{bucket:06d}", _counts("pairs", pair[own], ahead[own]))
        rows.number(2, _few(ahead[own]), int(own.sum()))
        _facts_of(rows, v[own], w[own], ahead[own], buckets)
        by = _order(v, 48)
        s = _starts(v[by])
        rows.add(WORD, _home(v[by][s], buckets), _six(v[by][s]), _sums(raw[by], s), np.zeros(len(s), np.uint64), *[np.zeros(len(s), np.uint32)] * 3)
        if part.any():
            which = np.searchsorted(common, v[part]).astype(np.uint16)
            rows.add(PAIR, (pair[part] % _U(buckets)).astype(np.int64), _six(w[part]), which, ahead[part].astype(np.uint32))
        return rows.table()

    rounds = [stored(_pieces(docs, book, common, buckets, order, turn).groupBy("bucket").applyInArrow(count, _MADE), "counted", codec="zstd") for turn in range(min(PASSES, buckets))]
    made = rounds[0]
    for more in rounds[1:]:
        made = made.unionByName(more)

    def gather(table: pa.Table) -> pa.Table:
        """Brings the parts of spread contexts and pairs together."""
        bucket, rows = table.column("bucket")[0].as_py(), _Rows()
        of = lambda kind: table.filter(pc.equal(table.column("kind"), kind))
        parts = of(CONTEXT)
        key = _joined(parts, "k", np.uint64)
        by = _order(key)
        s = _starts(key[by])
        facts = {k: _sums(_joined(parts, x, _KINDS[k])[by], s).astype(_KINDS[k]) for k, x in zip(_LEVEL["contexts"], _FACTS[1:], strict=False)}
        files = _table("contexts", key[by][s], **facts)
        parts = of(PAIR)
        w, v, ahead = _words_of(_joined(parts, "k", np.uint8)), common[_joined(parts, "x1", np.uint16)], _joined(parts, "x2", np.uint32)
        pair = _pair(v, w)
        by = _order(pair)
        s = _starts(pair[by])
        ahead, v, w = _sums(ahead[by], s), v[by][s], w[by][s]
        _write(folder, f"shared-{bucket:06d}", files | _counts("pairs", pair[by][s], ahead))
        rows.number(2, _few(ahead), len(ahead))
        _facts_of(rows, v, w, ahead, buckets)
        return rows.table()

    shared = stored(made.where(F.col("kind").isin(CONTEXT, PAIR)).groupBy("bucket").applyInArrow(gather, _MADE), "shared", codec="zstd")

    def words(table: pa.Table) -> pa.Table:
        """Writes what is known of the words of a bucket."""
        bucket, rows = table.column("bucket")[0].as_py(), _Rows()
        of = lambda kind: table.filter(pc.equal(table.column("kind"), kind))
        facts, ahead = of(WORD), of(AHEAD)
        word = np.concatenate([_words_of(_joined(facts, "k", np.uint8)), _words_of(_joined(ahead, "k", np.uint8))])
        by = _order(word, 48)
        s = _starts(word[by])
        own, cols = word[by][s], {}
        before = _joined(ahead, "x1", np.uint32)
        for name, x in zip(_LEVEL["words"][:5], _FACTS[1:], strict=True):
            value = _joined(facts, x, _KINDS[name])
            cols[name] = _sums(np.concatenate([value, np.zeros(len(before), _KINDS[name])])[by], s)
        cols["before"] = _sums(np.concatenate([np.zeros(len(word) - len(before), np.uint32), before])[by], s)
        cols["count"][own == END] = texts
        cols["count"][own == BEGIN] = 0
        big = np.zeros(len(own), bool)
        for x in cols.values():
            big |= x > 255
        files = {}
        for name, part, kinds in (("small", ~big, dict.fromkeys(_KINDS, np.uint8)), ("big", big, _KINDS)):
            files |= _table(name, mixed(own[part] + _U(1)), **{k: x[part].astype(kinds[k]) for k, x in cols.items()})
        _write(folder, f"words-{bucket:06d}", files)
        rows.number(1, _few(cols["before"]), int((cols["before"] >= 3).sum()))
        rows.number(0, [0, 0, 0, 0], int((cols["count"] > 0).sum()))
        return rows.table()

    facts = made.where(F.col("kind").isin(WORD, AHEAD)).unionByName(shared.where(F.col("kind").isin(WORD, AHEAD)))
    last = stored(facts.groupBy("bucket").applyInArrow(words, _MADE), "words")
    numbers = made.unionByName(shared).unionByName(last).where(F.col("kind") == OF)
    sums = numbers.groupBy("bucket").agg(F.sum("total").alias("total"), *[F.sum(F.col("of")[k]).alias(f"of{k}") for k in range(4)]).collect()  # a row per level
    of, total = {r["bucket"]: [r[f"of{k}"] for k in range(4)] for r in sums}, {r["bucket"]: r["total"] for r in sums}
    none = [0, 0, 0, 0]
    e, kinds = _discounts(of.get(1, none)), total.get(2, 0)
    n = of.get(1, none)
    kept = (e[1] * n[0] + e[2] * n[1] + e[3] * total.get(1, 0)) / kinds if kinds else 1.0
    return Model(folder, order, buckets, common, _discounts(of.get(3, none)), _discounts(of.get(2, none)), e, kinds, total.get(0, 0), tokens, kept, total.get(3, 0))


def _word_facts(model: Model, maps: Maps, word: np.ndarray) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(word)) for k in _LEVEL["words"]}
    key = mixed(word + _U(1))
    for mine, arrays in maps.each(_home(word, model.buckets), key):
        for name in ("small", "big"):
            at = maps.find(arrays, name, key[mine])
            hit = at >= 0
            for k, x in out.items():
                x[mine[hit]] = arrays[f"{name}.{k}"][at[hit]]
    return out


def _higher(model: Model, triples: Maps, shared: Maps, words: np.ndarray, context: tuple[np.ndarray, ...], of: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p(w | u, v) from p(w | v) for distinct triples in order of their contexts: context has u, v and the hash of each one, of says which it is."""
    u, v, key = context
    triple = _pair(key[of], words[w])
    c, facts = np.zeros(len(w)), {k: np.zeros(len(key)) for k in _LEVEL["contexts"]}
    only, times = np.zeros(len(key), np.uint32), np.zeros(len(key))
    size = np.bincount(of, minlength=len(key))
    first = np.cumsum(size) - size
    often, home = _among(words, model.common), _home(words, model.buckets)
    loose = often[u] & often[v]
    bucket = np.where(often[v], (key % _U(model.buckets)).astype(np.int64), home[v])
    part = np.flatnonzero(loose & (size > 0))
    for mine, arrays in shared.each(bucket[part], key[part]):
        at = shared.find(arrays, "contexts", key[part[mine]])
        hit = at >= 0
        for k, x in facts.items():
            x[part[mine[hit]]] = arrays[f"contexts.{k}"][at[hit]]
    part = np.flatnonzero(loose[of])
    c[part] = triples.count((triple[part] % _U(model.buckets)).astype(np.int64), triple[part], "loose")
    rest = np.flatnonzero(~loose & (size > 0))
    for mine, arrays in triples.each(bucket[rest], key[rest]):
        mine = rest[mine]
        at = triples.find(arrays, "one", key[mine])
        hit = np.flatnonzero(at >= 0)
        only[mine[hit]], times[mine[hit]] = arrays["one.w"][at[hit]], arrays["one.c"][at[hit]]
        mine = mine[at < 0]
        at = triples.find(arrays, "many", key[mine])
        hit = np.flatnonzero(at >= 0)
        mine, at = mine[hit], at[hit]
        for k, x in facts.items():
            x[mine] = arrays[f"many.{k}"][at]
        n = size[mine]
        inside = np.arange(n.sum()) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
        a, b = arrays["many.at"][at].astype(np.int64), arrays["many.size"][at]
        spot = _bisect(arrays["next.hi"], arrays["next.lo"], np.repeat(a, n), np.repeat(a + b, n), triple[inside] >> _U(24))
        inside, spot = inside[spot >= 0], spot[spot >= 0]
        c[inside] = triples.full(arrays, "triples", triple[inside], arrays["next.c"][spot])
    one = np.flatnonzero(times)
    n = times[one]
    for k, x in (("following", n), ("n1", n == 1), ("n2", n == 2), ("n3", n >= 3)):
        facts[k][one] = x
    one = np.flatnonzero(times[of])
    one = one[only[of[one]] == (triple[one] >> _U(32)).astype(np.uint32)]
    c[one] = times[of[one]]
    f = model.f
    top = c - f[np.minimum(c, 3).astype(np.int64)]
    weight = f[1] * facts["n1"] + f[2] * facts["n2"] + f[3] * facts["n3"]
    following = facts["following"][of]
    return np.where(following > 0, (top + weight[of] * p) / np.maximum(following, 1), p)


def _scores(model: Model, maps: dict[str, Maps], data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Every distinct word, pair and triple of some texts is looked up once."""
    w, of = _sequence(data, offsets)[1:]
    n = len(offsets) - 1
    words, w = _distinct(w, 48)
    v, _, words = _previous(w, of, words, 2)
    begin, size = len(words) - 2, len(words).bit_length()
    split = lambda x: ((x >> _U(size)).view(np.int64), (x & _U((1 << size) - 1)).view(np.int64))
    pairs, ip = _distinct((v << size | w).view(np.uint64), 2 * size)
    pv, pw = split(pairs)
    key, c, much = _pair(words[pv], words[pw]), np.zeros(len(pv)), _among(words, model.common)[pv]
    c[~much] = maps["pairs"].count(_home(words, model.buckets)[pv[~much]], key[~much], "pairs")
    c[much] = maps["shared"].count((key[much] % _U(model.buckets)).astype(np.int64), key[much], "pairs")
    facts = _word_facts(model, maps["words"], words)
    d, e = model.d, model.e
    low = (facts["before"] - e[np.minimum(facts["before"], 3).astype(np.int64)]) / max(1, model.kinds) + model.kept / (model.vocabulary + 1)
    top = c - d[np.minimum(c, 3).astype(np.int64)]
    weight = d[1] * facts["n1"] + d[2] * facts["n2"] + d[3] * facts["n3"]
    following = facts["following"][pv]
    p, which = np.where(following > 0, (top + weight[pv] * low[pw]) / np.maximum(following, 1), low[pw]), ip
    if model.order == 3:
        context = np.empty_like(ip)  # the pair that ends with the token before, or two begin tokens
        context[1:] = ip[:-1]
        context[v == begin] = len(pairs)
        del v
        context <<= size
        context |= w
        triples, which = _distinct(context.view(np.uint64), len(pairs).bit_length() + size)
        del context
        pair_of = np.empty(len(triples), np.int64)
        pair_of[which] = ip
        del ip
        contexts = np.append(pv, begin), np.append(pw, begin), np.append(key, _pair(words[begin : begin + 1], words[begin : begin + 1]))
        p = p[pair_of]
        del pairs, pv, pw, key, c, much, top, following, pair_of
        p = _higher(model, maps["triples"], maps["shared"], words, contexts, *split(triples), p)
    base = np.log10((facts["count"] + 1.0) / (model.tokens + model.vocabulary + 1.0))
    sums = lambda x: np.bincount(of, x, n)
    return [np.bincount(of, minlength=n).astype(np.int64), sums((facts["count"] > 0)[w]).astype(np.int64), sums(base[w]), sums(np.log10(p)[which])]


def _gathered(batches, place: int):
    """Batches put together until one more of the same size would pass a run: what is looked up more than once is then looked up less often."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        own = batch.column(place).nbytes
        size += own
        if size + own > _RUN:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents' columns with n_tokens, n_known, base_score and score (log10 probabilities)."""
    added = [("n_tokens", "bigint"), ("n_known", "bigint"), ("base_score", "double"), ("score", "double")]
    kept = [c for c in docs.columns if c not in dict(added)]
    rows = columns(docs, kept if text in kept else [*kept, text])
    place = rows.columns.index(text)

    def run(batches):
        maps = {k: Maps(model.folder, k) for k in ("triples", "pairs", "shared", "words")}
        try:
            for batch in _gathered(batches, place):
                texts = pa.RecordBatch.from_arrays([batch.column(place)], names=["text"])
                parts = [_scores(model, maps, data, offsets) for _, _, data, offsets in runs(texts, size=_RUN)]
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
                made = [batch.column(i) for i in range(len(kept))] + [pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays(made, names=[str(i) for i in range(len(made))])
        finally:
            for m in maps.values():
                m.close()

    return mapped(rows, run, [(f.name, f.dataType) for f in rows.schema[: len(kept)]] + added)


def perplexity(score_: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_ / n_tokens)
