"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): all pairwise interactions of the
active features in time linear in their number.

Features of a text: its distinct words, hashed into `WORD_BUCKETS` slots and scaled to length one together; one slot per
structure statistic and level (shares of upper case, digits, marks, bars and line breaks, word length, line length, share
of distinct words, of words ending in marks or upper case, of words like the one before, of repeated lines); and the level of its length as metadata. Labels, language,
source and id are never inputs.

Defined results: a null or empty text has no words and gets the score of its structure levels; equal texts get equal
scores; without any label, or with labels of one class only, the model is constant (0.5, or the class); repeated rows are
scored each; an input column named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns
from .kernel import Words, runs, span_hashes

WORD_BUCKETS = 1 << 15
LEVELS = 16
STATISTICS = 13
FACTORS = 8
#: At most this many labelled documents are fitted: those with the smallest hash of their id.
SAMPLE = 8_000

_CLASSES = np.zeros((5, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CLASSES[3, ord("|")] = True
_CLASSES[4, 10] = True


def _level(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 in levels that are finer near 0."""
    return np.minimum(LEVELS - 1, np.sqrt(np.clip(np.nan_to_num(x), 0, 1)) * LEVELS).astype(np.int64)


def _log_level(x: np.ndarray, step: float) -> np.ndarray:
    return np.minimum(LEVELS - 1, np.log2(1 + x) * step).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text its distinct word slots, and a (texts, STATISTICS) array of structure slots."""
    words = Words(data, offsets)
    hashes = words.hashes()
    slots = (hashes >> np.uint64(49)).astype(np.int32)
    sets = [np.unique(slots[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
    size = np.maximum(np.diff(offsets), 1)
    share = []
    for mask in _CLASSES:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        share.append(np.diff(total[offsets]) / size)
    n = np.maximum(words.count, 1)
    of = words.text_of_word()
    count = len(words.count)
    length = np.bincount(of, words.end - words.start, count)
    marked = np.bincount(of, _CLASSES[2][data[words.end - 1]] if len(of) else None, count)
    shouted = np.bincount(of, _CLASSES[0][data[words.end - 1]] if len(of) else None, count)
    distinct = np.array([len(s) for s in sets], float)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(of) else of
    repeated = np.bincount(of[again], minlength=count)
    lines = [_distinct_lines(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    levels = np.stack(
        [_level(s) for s in share]
        + [
            _log_level(length / n, 3.0),
            _log_level(size / np.maximum(share[4] * size + 1, 1), 1.2),
            _level(marked / n),
            _level(shouted / n),
            _level(1 - distinct / n),
            _level(np.array(lines)),
            _level(repeated / n),
        ]
        + [_log_level(np.diff(offsets).astype(float), 0.8)],
        axis=1,
    )
    return sets, WORD_BUCKETS + levels + np.arange(STATISTICS) * LEVELS


def _distinct_lines(data: np.ndarray) -> float:
    """Share of repeated lines."""
    breaks = np.flatnonzero(data == 10)
    if not len(breaks):
        return 0.0
    start = np.concatenate([[0], breaks + 1])
    h = span_hashes(data, start, np.concatenate([breaks, [len(data)]]), False)
    return 1 - len(np.unique(h)) / len(h)


def _packed(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    rows = []
    for _, _, data, offsets in runs(batch, text):
        sets, levels = features(data, offsets)
        rows += [np.concatenate([s, lv]).astype(np.int32).tobytes() for s, lv in zip(sets, levels, strict=True)]
    return [pa.array(rows, pa.binary())]


class Machine:
    """Weights of a fitted model, and its linear-time score."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def score(self, slots: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores of rows whose active slots and values lie one after the other; no row is without a slot."""
        lin = np.add.reduceat(self.w[slots] * x, start)
        vx = self.v[slots] * x[:, None]
        total = np.add.reduceat(vx, start, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), start)
        z = self.bias + lin + 0.5 * ((total * total).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _values(sizes: np.ndarray) -> np.ndarray:
    """Feature values of rows with so many word slots each: words at length one, then the structure slots."""
    per_row = np.stack([sizes, np.full(len(sizes), STATISTICS)], 1).ravel()
    value = np.stack([1 / np.sqrt(np.maximum(sizes, 1)), np.full(len(sizes), 1 / np.sqrt(STATISTICS))], 1).ravel()
    return np.repeat(value, per_row)


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Logistic loss, Adagrad steps on the slots of each small batch."""
    size = WORD_BUCKETS + STATISTICS * LEVELS
    rng = np.random.default_rng(7)
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
    if not len(y) or y.min() == y.max():
        return Machine(0.0 if not len(y) else 30.0 * (2 * float(y[0]) - 1), w, np.zeros_like(v))
    bias = float(np.log((y.mean()) / (1 - y.mean())))
    gw, gv = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    for _ in range(max(epochs, 40_000 // len(y))):  # small samples are seen more often
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            sizes = np.array([len(rows[i]) - STATISTICS for i in pick])
            slots, x = np.concatenate([rows[i] for i in pick]), _values(sizes)
            start = np.concatenate([[0], np.cumsum(sizes + STATISTICS)[:-1]])
            vx = v[slots] * x[:, None]
            total = np.add.reduceat(vx, start, axis=0)
            p = Machine(bias, w, v).score(slots, x, start)
            d = (p - y[pick]) / len(pick)
            bias -= 0.5 * float(d.sum())
            each = np.repeat(d, sizes + STATISTICS) * x
            by = np.argsort(slots, kind="stable")
            touched, first = np.unique(slots[by], return_index=True)
            g = np.add.reduceat(each[by], first) + decay * w[touched]
            gw[touched] += g * g
            w[touched] -= rate * g / np.sqrt(gw[touched])
            each_v = each[:, None] * (np.repeat(total, sizes + STATISTICS, axis=0) - vx)
            g = np.add.reduceat(each_v[by], first, axis=0) + decay * v[touched]
            gv[touched] += g * g
            v[touched] -= 0.5 * rate * g / np.sqrt(gv[touched])
    return Machine(bias, w, v)


def train(labelled: DataFrame, label: str = "label", text: str = "text", id_col: str = "doc_id") -> Machine:
    """Fits on a bounded sample (at most SAMPLE rows, one task); the rows' features are made where the rows are."""
    feats = with_columns(labelled.select(id_col, label, text), [("slots", "binary")], _packed, text).select(id_col, label, "slots")

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            model = fit([], np.zeros(0))
        else:
            table = pa.Table.from_batches(batches).sort_by([(id_col, "ascending"), ("slots", "ascending")])
            rows = [np.frombuffer(b, np.int32) for b in table.column("slots").to_pylist()]
            model = fit(rows, table.column(label).to_numpy().astype(float))
        parts = [np.array([model.bias], np.float32), model.w.astype(np.float32), model.v.astype(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts])], names=["part"])

    parts = [np.frombuffer(r[0], np.float32) for r in feats.repartition(1).mapInArrow(run, "part binary").collect()]
    if not parts:
        return fit([], np.zeros(0))
    bias, w, v = parts[:3]
    return Machine(float(bias[0]), w.astype(np.float64), v.reshape(-1, FACTORS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """At most `bound` labelled documents, those with the smallest hash of their id; ids, not texts, are ranked."""
    known = labels.select(id_col, F.col(label).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isNotNull())
    one = known.groupBy(id_col).agg(F.max("label").alias("label"))
    ids = one.orderBy(F.xxhash64(id_col), id_col).limit(bound)
    return docs.select(id_col, "text").join(F.broadcast(ids), id_col)  # at most `bound` ids


def _scores(batch: pa.RecordBatch, model: Machine, text: str) -> list[pa.Array]:
    out = []
    for _, _, data, offsets in runs(batch, text):
        sets, levels = features(data, offsets)
        sizes = np.array([len(s) for s in sets])
        slots = np.concatenate([part for pair in zip(sets, levels, strict=True) for part in pair]).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + STATISTICS)[:-1]])
        out.append(model.score(slots, _values(sizes), start))
    score = np.concatenate(out) if out else np.zeros(0)
    return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]


def score_quality(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """The documents with `score` (0 to 1, higher is better) and `predicted` (1 if score >= 0.5, else 0)."""
    return with_columns(docs, [("score", "double"), ("predicted", "int")], _scores, model, text)
