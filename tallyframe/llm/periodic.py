"""Periodic runs of words, found in an enhanced suffix array, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least `shortest` words and `times`
periods long and that neither neighbouring word extends. Every run ends with one branching square: q words twice, where
the word after them breaks the period. For each LCP interval of depth d, all suffixes outside its largest child are tested:
a suffix i whose partner i + d or i - d lies in the interval, but in another child, marks the branching square of root d at
the smaller of the two. Squares are rotated to the left as far as the period holds, by ranks of 1, 2, 4, ... words; squares
of multiples of a period, which end where its run ends, are merged into that run. Intervals are index ranges; no tree is
built.

All documents of a piece of a batch are handled together in arrays. A run of at least `shortest` words has two positions,
one period apart, with the same words for `shared` places, so documents in which no `shared` words repeat have no run and
skip the suffix array. Memory follows the piece (1 MB of text) or the longest single text, some 200 bytes per word there.
Words are compared by 64-bit hashes of their bytes; chance equality is neglected.

Defined results: null and empty texts have no runs and an empty collapsed text; repeated rows and ids give repeated rows;
ties cannot occur, as runs are told apart by start and period; an empty table gives no rows; columns called `runs` or
`collapsed` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns, let, mapped
from .kernel import Words, mixed, ngrams, runs

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _suffix_order(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffixes of every text in order, text after text, and the ranks by the first 1, 2, 4, ... words on the way there.

    Ranks are places in the order; two suffixes have the same rank at level k only if their first 2^k words are the same.
    The last level tells all suffixes apart.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    word = np.unique(ids, return_inverse=True)[1]
    key = text * n + word
    order = np.argsort(key, kind="stable")
    place = np.arange(n)

    def ranked(sorted_keys, places):
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return np.maximum.accumulate(np.where(new, places, 0)), new

    value, new = ranked(key[order], place)
    rank = np.empty(n, np.int64)
    rank[order] = value
    levels, width = [rank], 1
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]  # first of its group, and so is the next one
        open_places = place[~alone] if len(place) else place
        if not len(open_places):
            return order, levels, end
        members = order[open_places]
        after = members + width
        inside = after < end[members]
        follow = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        order[open_places] = members[by]
        value, new = ranked(key[by], open_places)
        rank = rank.copy()
        rank[members[by]] = value
        levels.append(rank)
        place, width = open_places, width * 2


def _shared_words(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b have in common from their beginning."""
    n, length = len(end), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        same = (x < end[a]) & (y < end[b])
        same &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        length += same.astype(np.int64) << k
    return length


def _nearest_smaller(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the nearest ones before and after it with a smaller value, by minima of 1, 2, 4, ... places.

    The first and the last value are smaller than all at the asked places.
    """
    minima = [values]
    while 2 << len(minima) - 1 <= len(values):
        low, step = minima[-1], 1 << len(minima) - 1
        minima.append(np.minimum(low[:-step], low[step:]))
    want, left, right = values[at], at.copy(), at + 1
    for k in range(len(minima) - 1, -1, -1):
        step, low = 1 << k, minima[k]
        start = left - step  # places start .. left - 1
        free = start >= 0
        free &= low[np.maximum(start, 0)] >= want
        left -= free * step
        free = right + step <= len(values)
        free &= low[np.minimum(right, len(low) - 1)] >= want
        right += free * step
    return left - 1, right


def _branching_squares(order, levels, end, first, times) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of squares that the next word breaks, from the LCP intervals of all texts."""
    n = len(order)
    start_of = np.repeat(first[:-1], np.diff(first))
    lcp = np.full(n + 1, -1, np.int64)
    inner = np.flatnonzero(start_of[order[1:]] == start_of[order[:-1]]) + 1
    lcp[inner] = _shared_words(order[inner - 1], order[inner], levels, end)
    whole = end[order[np.minimum(np.arange(n + 1), n - 1)]] - start_of[order[np.minimum(np.arange(n + 1), n - 1)]]
    borders = np.flatnonzero((lcp >= 1) & (times * lcp <= whole))
    if not len(borders):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = _nearest_smaller(lcp, borders)
    depth = lcp[borders]
    by = np.lexsort((borders, depth, left))  # borders of one interval together, in order
    borders, left, right, depth = borders[by], left[by], right[by], depth[by]
    opens = np.ones(len(by), bool)
    opens[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    heads = np.flatnonzero(opens)
    # children: one from the interval's left end to its first border, and one from every border to the next
    closes = np.append(heads[1:] - 1, len(by) - 1)
    until = np.append(borders[1:], 0)
    until[closes] = right[closes]
    begin = np.concatenate([left[heads], borders])
    stop = np.concatenate([borders[heads], until])
    interval = np.concatenate([np.arange(len(heads)), np.cumsum(opens) - 1])
    by = np.lexsort((begin, interval))
    begin, stop, interval = begin[by], stop[by], interval[by]
    size = stop - begin
    first_child = np.searchsorted(interval, np.arange(len(heads)))
    largest = np.maximum.reduceat(size, first_child)
    is_largest = np.flatnonzero(size == largest[interval])
    spared = is_largest[np.searchsorted(interval[is_largest], np.arange(len(heads)))]
    small = np.ones(len(size), bool)
    small[spared] = False
    begin, stop, interval, size = begin[small], stop[small], interval[small], size[small]
    lo, hi, root = left[heads][interval], right[heads][interval], depth[heads][interval]
    starts, roots = [], []
    isa, step = levels[-1], 1 << 20
    bounds = np.cumsum(size)
    a = 0
    while a < len(size):  # the tests of some children at a time
        b = max(a + 1, int(np.searchsorted(bounds, (bounds[a - 1] if a else 0) + step, "right")))
        child = np.repeat(np.arange(a, b), size[a:b])
        place = np.arange(len(child)) - np.repeat(bounds[a:b] - size[a:b] - (bounds[a - 1] if a else 0), size[a:b]) + begin[child]
        i, d = order[place], root[child]
        for j, square in ((i + d, i), (i - d, i - d)):
            ok = (j < end[i]) & (j >= start_of[i])
            y = isa[np.clip(j, 0, n - 1)]
            ok &= (y >= lo[child]) & (y < hi[child]) & ((y < begin[child]) | (y >= stop[child]))
            starts.append(square[ok])
            roots.append(d[ok])
        a = b
    both = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(roots))
    return both // (n + 1), both % (n + 1)


def periodic_runs(ids: np.ndarray, first: np.ndarray, shortest: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs; ids has one number per word, and first where each text's words begin.

    Runs come by text, start and period; starts count from the text's own first word.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(ids):
        return none
    order, levels, end = _suffix_order(ids, first)
    start_of = np.repeat(first[:-1], np.diff(first))
    at, period = _branching_squares(order, levels, end, first, times)
    begin = at.copy()
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left
        to = begin - (1 << k)
        same = to >= start_of[at]
        same &= levels[k][np.maximum(to, 0)] == levels[k][np.maximum(to, 0) + period]
        begin = np.where(same, to, begin)
    stop = at + 2 * period
    long = stop - begin >= np.maximum(shortest, times * period)
    begin, stop, period = begin[long], stop[long], period[long]
    by = np.lexsort((period, stop))
    begin, stop, period = begin[by], stop[by], period[by]
    found = []
    while len(stop):
        # the smallest period at each end is primitive; squares of its multiples inside its run belong to it
        head = np.ones(len(stop), bool)
        head[1:] = stop[1:] != stop[:-1]
        found.append((begin[head], stop[head], period[head]))
        of = np.cumsum(head) - 1
        p, s = period[head][of], begin[head][of]
        rest = ~head & ~((period % p == 0) & (stop - 2 * period >= s))
        begin, stop, period = begin[rest], stop[rest], period[rest]
    if not found:
        return none
    begin, stop, period = (np.concatenate(c) for c in zip(*found, strict=True))
    text = np.searchsorted(first, begin, "right") - 1
    by = np.lexsort((period, begin))
    text, begin, stop, period = text[by], begin[by], stop[by], period[by]
    return text, begin - first[text], stop - begin, period


def _may_repeat(hashes: np.ndarray, first: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Texts in which some words stand twice, as many as a run shares with itself one period on."""
    # a run of length m >= max(shortest, times * q) agrees with itself, q words on, over m - q words
    shared = min(max(shortest, times * q) - q for q in range(1, shortest + 1))
    count = np.diff(first)
    out = np.zeros(len(count), bool)
    grams = ngrams(hashes, min(shared, 64))
    if not len(grams):
        return out
    text = np.repeat(np.arange(len(count)), count)[: len(grams)]
    inside = np.flatnonzero(np.arange(len(grams)) + shared <= first[1:][text])
    own = mixed(grams[inside] + (text[inside].astype(np.uint64) << np.uint64(40)))
    sorted_own = np.sort(own)
    twice = sorted_own[1:][sorted_own[1:] == sorted_own[:-1]]
    if len(twice):
        out[text[inside][np.isin(own, twice)]] = True
    return out


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    kept = np.flatnonzero(keep)
    begin, stop = words.start[kept], words.end[kept]
    first = np.searchsorted(kept, words.first)
    size = stop - begin + 1
    last = first[1:][first[1:] > first[:-1]] - 1
    size[last] -= 1  # no space after a text's last word
    ends = np.cumsum(size)
    source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    out = np.full(len(source), 32, np.uint8)
    inside = source < np.repeat(stop, size)
    out[inside] = words.data[source[inside]]
    offsets = np.concatenate([[0], ends])[first].astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
    return text.cast(pa.string())


def runs_and_rest(data: np.ndarray, offsets: np.ndarray, shortest: int, times: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each of some texts."""
    words = Words(data, offsets)
    hashes = words.hashes(fold=False)
    some = np.flatnonzero(_may_repeat(hashes, words.first, shortest, times))
    keep = np.ones(len(hashes), bool)
    sizes = np.zeros(len(offsets) - 1, np.int64)
    cols = [np.zeros(0, np.int64)] * 3
    if len(some):
        count = words.count[some]
        first = np.concatenate([[0], np.cumsum(count)])
        pick = np.arange(first[-1]) + np.repeat(words.first[some] - first[:-1], count)
        text, start, length, period = periodic_runs(hashes[pick], first, shortest, times)
        sizes += np.bincount(some[text], minlength=len(sizes))
        cols = [start, length, period]
        edge = np.zeros(len(hashes) + 1, np.int64)
        base = words.first[some[text]] + start
        np.add.at(edge, base + period, 1)
        np.add.at(edge, base + length, -1)
        keep = np.cumsum(edge[:-1]) == 0
    rows = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows)
    return lists, _joined(words, keep)


def collapse_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shortest: int = 24, times: int = 3) -> DataFrame:
    """Adds `runs`, by start and period, and `collapsed`: the words outside of runs and each run's first period, joined by spaces.

    keep: the columns to carry along, all by default.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    rows = columns(docs, kept if text in kept else [*kept, text])
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for lo, hi, data, offsets in runs(texts):
                made = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + list(runs_and_rest(data, offsets, shortest, times))
                yield pa.RecordBatch.from_arrays(made, names=[str(i) for i in range(len(made))])

    return mapped(rows, run, [(f.name, f.dataType) for f in rows.schema[: len(kept)]] + [("runs", RUNS), ("collapsed", "string")])


def looped(text: Column, start: Column, period: Column, n: Column) -> Column:
    """The words of a text, joined by spaces, where from word `start` on the first `period` of them come again and again."""
    place = lambda i, k: F.when(i < k["a"], i).otherwise(k["a"] + (i - k["a"]) % k["p"]).cast("int")
    again = lambda ws, k: F.array_join(F.transform(F.sequence(F.lit(0), (k["n"] - 1).cast("int")), lambda i: F.get(ws, place(i, k))), " ")
    numbers = F.struct(start.alias("a"), period.alias("p"), n.alias("n"))  # computed once, not once per word
    return let(numbers, lambda k: let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda ws: again(ws, k)))


def strongest(found: Column) -> Column:
    """Of runs in order, the first one with the most periods, by exact ratios; null if there is none."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(found, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(better(a, r), r).otherwise(a))
