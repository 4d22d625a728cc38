"""N-gram Jaccard self-join by universe partition, and the groups that its links form.

Two sets r, s with Jaccard at least NUM/DEN differ in at most H = floor((DEN-NUM)/(DEN+NUM) * (|r|+|s|)) elements. Pairs
are sorted into bands by |r|+|s|. In a band, the universe of shingles is hashed into segments: `a` exact ones, of which
the subset of a set is indexed by one hash, and `d` one-deletion ones, indexed by the subset and by the subset without any
one element. A linked pair that meets in no one-deletion segment differs in at most H - 2d exact ones (pigeonhole), so it
has at least e + 1 equal ones with e = a - (H + 1 - 2d). So every set may leave out its e most common exact subsets, by one
order that all sets share: empty subsets first, then frequent ones (e by the H of the set's own largest partner). d and a
are chosen per band by a cost model of rows indexed and of expected useless meetings.

Subsets that few sets have become pairs at once. For frequent ones, each set first leaves out what its slack allows; the
rest is compared with the member of its group that has the most such subsets, and members that are still in different components afterwards are
compared with each other. All pairs are verified by their whole shingle sets. No pair is lost by any of these steps; only
links inside a component that is known already are not looked for.

Shingles are 64-bit hashes and sets are told apart by two 64-bit sums; chance equality is neglected.

Defined results: null and empty texts have no shingles and are alone; a text of fewer than n words has its whole word
sequence as its one shingle; repeated rows are exact copies; a null id takes no part in linking and gets no component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_columns
from .graph import components
from .kernel import Words, mixed, runs, shingle_sets

N = 5
NUM, DEN = 75, 100
BAND_RATIO = 1.7
#: Cost of a useless meeting, in indexed rows.
MEETING = 1e5
#: Bits of the map of wanted ids, as a power of two: 1 MB.
FILTER_BITS = 23
#: Counters of a set's sketch, a power of two.
SKETCH = 512
#: Counters of the small sketch, and documents that are compared at a time.
SMALL_SKETCH = 128
BLOCK = 1024
#: Groups up to this size become pairs at once.
SMALL = 12
#: Index entries of one bucket.
BUCKET_ENTRIES = 1_500_000


@dataclass(frozen=True)
class Band:
    number: int
    lo: int
    hi: int
    deletions: int
    exact: int


def partner_sums(n: int) -> tuple[int, int]:
    """Smallest and largest |r|+|s| of a set of n elements and a linked one."""
    return n + -(-n * NUM // DEN), n + n * DEN // NUM


def most_different(total: int) -> int:
    return total * (DEN - NUM) // (DEN + NUM)


def _tail(n: int, p: float, k: int) -> float:
    """P(Binomial(n, p) > k): its terms from k + 1 on, until they no longer count."""
    if k >= n or p <= 0:
        return 0.0
    if k < n * p:
        return 1.0
    i, q = k + 1, p / (1 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while i <= n and term > total * 1e-12:
        total += term
        term *= (n - i) / (i + 1) * q
        i += 1
    return min(1.0, total)


def allocate(hi: int, typical: int) -> tuple[int, int]:
    """The cheapest (one-deletion segments, exact segments) for the band that ends at `hi`."""
    need, best = most_different(hi) + 1, None
    for d in range(0, min(3, (need + 1) // 2) + 1):
        base = max(0, need - 2 * d)
        for e in range(0, 12 + base // 2 if base else 1, max(1, base // 100)):
            a = base + e
            if d + a == 0:
                continue
            share = 1 / (d + a)
            empty = (1 - share) ** typical
            thin = empty + typical * share * (1 - share) ** (typical - 1)
            rows = a + d * (1 + typical * share)
            cost = rows + MEETING * (_tail(a, empty, e) + d * thin)
            if best is None or cost < best[0]:
                best = (cost, d, a, e)
    return best[1:3]


@lru_cache(maxsize=None)
def band(number: int) -> Band:
    lo = 2 if number == 0 else band(number - 1).hi + 1
    hi = max(lo + 1, int(lo * BAND_RATIO))
    return Band(number, lo, hi, *allocate(hi, max(1, hi * NUM // (NUM + DEN))))


def slack_of(b: Band, n: int) -> int:
    """How many exact subsets a set of n elements may leave out: its own pairs differ less than the band's at most."""
    differ = most_different(min(b.hi, partner_sums(n)[1]))
    return b.exact - max(0, differ + 1 - 2 * b.deletions)


def bands_of(n: int) -> list[int]:
    lo, hi = partner_sums(n)
    out, k = [], 0
    while band(k).lo <= hi:
        if band(k).hi >= lo and most_different(band(k).hi) > 0:
            out.append(k)
        k += 1
    return out


def _sums(key: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit values per key, modulo 2^64, from exact sums of their halves."""
    low = np.bincount(key, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    high = np.bincount(key, (values >> np.uint64(32)).astype(np.float64), size)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def index_entries(sets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, band, slack left) of all sets, which lie one after the other."""
    sizes = np.diff(start)
    distinct, at = np.unique(sizes, return_inverse=True)
    of_size = [set(bands_of(int(n))) if n else set() for n in distinct]
    out: list[tuple[np.ndarray, ...]] = []
    for k in sorted(set().union(*of_size)) if of_size else []:
        b = band(k)
        m = b.deletions + b.exact
        rows = np.flatnonzero(np.array([k in s for s in of_size])[at])
        n = sizes[rows]
        local = np.repeat(np.arange(len(rows)), n)
        first = np.cumsum(n) - n
        elements = sets[np.arange(len(local)) - np.repeat(first, n) + np.repeat(start[rows], n)]
        h = mixed(elements ^ np.uint64(0xA5A5A5A5DEADBEEF * (k + 1) & (2**64 - 1)))
        segment = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        key = local * m + segment
        value = mixed(h + np.uint64(0x632BE59BD9B4E019))
        total = _sums(key, value, len(rows) * m)
        count = np.bincount(key, minlength=len(rows) * m).reshape(len(rows), m)
        tag = mixed(np.arange(m, dtype=np.uint64) + np.uint64(k * 1_000_003 + 17))
        signature = mixed(total.reshape(len(rows), m) + tag)
        exact_empty = count[:, b.deletions :] == 0
        order = np.cumsum(exact_empty, axis=1)
        slack = np.array([slack_of(b, int(x)) if k in s else 0 for x, s in zip(distinct, of_size, strict=True)])[at][rows]
        left = np.maximum(0, slack - exact_empty.sum(1))
        keep = np.ones((len(rows), m), bool)
        keep[:, b.deletions :] = ~exact_empty | (order > slack[:, None])
        r, s = np.nonzero(keep)
        out.append((signature[r, s], rows[r], np.full(len(r), k), left[r]))
        if b.deletions:
            gone = segment < b.deletions
            shorter = mixed(total[key[gone]] - value[gone] + tag[segment[gone]])
            out.append((shorter, rows[local[gone]], np.full(int(gone.sum()), k), left[local[gone]]))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _identity(sets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that stand for each set."""
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    size = len(start) - 1
    return _sums(of, mixed(sets + np.uint64(1)), size), _sums(of, mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), size)


def _sizes(batch: pa.RecordBatch) -> list[pa.Array]:
    parts, sketches, small = [], [], []
    for _, _, data, offsets in runs(batch):
        sets, start = shingle_sets(Words(data, offsets), N)
        h1, h2 = _identity(sets, start)
        parts.append((np.diff(start), h1.view(np.int64), h2.view(np.int64)))
        place = (sets & np.uint64(SKETCH - 1)).astype(np.int64)
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            counts = np.bincount(place[a:b], minlength=SKETCH)
            sketches.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            small.append(np.minimum(counts.reshape(-1, SMALL_SKETCH).sum(0), 255).astype(np.uint8).tobytes())
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
    return [*[pa.array(c, pa.int64()) for c in cols], pa.array(sketches, pa.binary()), pa.array(small, pa.binary())]


def _near(batches):
    """Of pairs with sizes and sketches, those that may link: the sketches differ in no more than the sets do."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column("n_a").to_numpy().astype(np.int64), batch.column("n_b").to_numpy().astype(np.int64)
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int16) for c in ("sketch_a", "sketch_b"))
        ok = (np.abs(x - y).sum(1) <= (n[0] + n[1]) * (DEN - NUM) // (DEN + NUM)) & (NUM * np.maximum(*n) <= DEN * np.minimum(*n))
        out = batch.filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])


def sized_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch, small): size, two sums that stand for the set, counts of hashed shingles."""
    fields = [("n_shingles", "bigint"), ("h1", "bigint"), ("h2", "bigint"), ("sketch", "binary"), ("small", "binary")]
    return stored(with_columns(docs.select("doc_id", "text"), fields, _sizes).drop("text"), "sets", codec="zstd")


def shingle_classes(sized: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, rep): rep is the smallest id of the documents with the same set; null without shingles."""
    sized = sized.drop("sketch", "small")
    some = sized.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    joined = some.join(reps, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "rep")
    alone = sized.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
    return stored(joined.union(alone), "classes")


def _indexed(docs: DataFrame, buckets: int) -> DataFrame:
    """Index entries packed by bucket; a set that a task has seen is not indexed again by it."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
            for lo, hi, data, offsets in runs(batch):
                sets, start = shingle_sets(Words(data, offsets), N)
                new = []
                for i, pair in enumerate(zip(*(h.tolist() for h in _identity(sets, start)), strict=True)):
                    if pair not in seen and start[i + 1] > start[i]:
                        seen.add(pair)
                        new.append(i)
                picked = [sets[start[i] : start[i + 1]] for i in new]
                begin = np.concatenate([[0], np.cumsum([len(p) for p in picked])]).astype(np.int64)
                sig, row, band_no, left = index_entries(np.concatenate(picked) if picked else sets[:0], begin)
                who = ids[lo:hi][new][row]
                bucket = (sig % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                low = (sig[by] >> np.uint64(32)).astype(np.uint32)
                who, note = who[by], (band_no[by] * 1024 + np.minimum(left[by], 1023)).astype(np.uint16)
                cut = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in full.tolist()], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(low), cut(who), cut(note)], names=["bucket", "sig", "who", "note"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, sig binary, who binary, note binary")


_FOUND = "sig bigint, a bigint, b bigint, band int, slack int"


def _meetings(table: pa.Table) -> pa.Table:
    """Pairs of small groups (sig null), and the members of frequent subsets, of one bucket."""
    bucket = table.column("bucket")[0].as_py()
    joined = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
    sig, who, note = joined("sig", np.uint32), joined("who", np.int64), joined("note", np.uint16)
    by = np.lexsort((who, sig))
    sig, who, note = sig[by], who[by], note[by]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
    sig, who, note = sig[fresh], who[fresh], note[fresh]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([begin, [len(sig)]]))
    pairs = []
    for g in range(2, SMALL + 1):
        at = begin[size == g]
        for i in range(g) if len(at) else []:
            for j in range(i + 1, g):
                pairs.append(np.stack([who[at + i], who[at + j]], 1))
    pair = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    large = np.repeat(size > SMALL, size)
    number = sig[large].astype(np.int64) * 4_000_000 + bucket
    none = pa.nulls(len(pair), pa.int32())
    note = note[large].astype(np.int32)
    return pa.Table.from_arrays(
        [
            pa.chunked_array([pa.nulls(len(pair), pa.int64()), pa.array(number)]),
            pa.chunked_array([pa.array(pair[:, 0]), pa.array(who[large])]),
            pa.chunked_array([pa.array(pair[:, 1]), pa.nulls(len(number), pa.int64())]),
            pa.chunked_array([none, pa.array(note >> 10)]),
            pa.chunked_array([none, pa.array(note & 1023)]),
        ],
        names=["sig", "a", "b", "band", "slack"],
    )


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size that has the bits of all ids set: what it lets pass is a superset of them."""

    def run(batches):
        for batch in batches:
            bit = _bit(batch.column("doc_id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], names=["word", "bits"])

    words = ids.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table = words.toArrow()  # at most as many rows as the map has words
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


def _needed_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, elements) of the documents with these ids and a few others; texts do not leave their task."""
    bits = _id_filter(ids)

    def run(batches):
        for batch in batches:
            own = np.asarray(batch.column("doc_id").fill_null(0).to_numpy(), np.int64)
            bit = _bit(own)
            kept = batch.filter(pa.array((bits[bit >> 6] >> (bit & 63)) & 1 == 1))
            rows = []
            for _, _, data, offsets in runs(kept):
                sets, start = shingle_sets(Words(data, offsets), N)
                rows += [sets[a:b].tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "elements"])

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, elements binary")
    return stored(made.dropDuplicates(["doc_id"]), "elements")


def _linked(batches):
    """Of pairs with both sets, those that link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            r, s = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if NUM * max(len(r), len(s)) > DEN * min(len(r), len(s)):
                keep.append(False)
                continue
            both = len(np.intersect1d(r, s, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(r) + len(s) - both))
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])


def verified(docs: DataFrame, sized: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets link. Sketches rule out most others; each set that is still needed is made once."""
    one = sized.dropDuplicates(["doc_id"])
    for sketch in ("small", "sketch"):
        side = lambda c: one.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col(sketch).alias(f"sketch_{c}"))  # noqa: B023, E731
        pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a bigint, b bigint"), "near")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _needed_sets(docs, ids)
    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("set_b"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return stored(full.mapInArrow(_linked, "a bigint, b bigint"), "links")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Rows of one id are one document, also where their texts differ: all their links are its links.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not different_texts(docs):
        return _groups(docs)
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows", codec="zstd")
    groups = _groups(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"))
    own = groups.select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    named = stored(rows.select("row", "doc_id").join(own, "row"), "named")
    first = named.groupBy("component_id").agg(F.min("doc_id").alias("first"))
    parts = components(named.join(first, "component_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    out = named.join(parts, F.col("doc_id") == F.col("node")).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.unionByName(groups.where("doc_id is null"))


def different_texts(docs: DataFrame) -> bool:
    """Whether an id has rows with different texts."""
    word = F.xxhash64(F.coalesce("text", F.lit("")))
    per = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(word).alias("lo"), F.max(word).alias("hi"))
    return bool(per.where("lo <> hi").head(1))


def _groups(docs: DataFrame) -> DataFrame:
    """Groups of rows whose texts depend on their ids."""
    sized = sized_sets(docs)
    classes = shingle_classes(sized)
    total = classes.agg(F.sum("n_shingles")).head()[0] or 0
    known = docs.where("doc_id is not null")
    index = _indexed(known, max(1, math.ceil(0.8 * total / BUCKET_ENTRIES)))
    found = stored(index.groupBy("bucket").applyInArrow(_meetings, _FOUND), "meetings")
    rep = classes.where("rep is not null").select(F.col("doc_id").alias("_id"), F.col("rep").alias("_rep")).distinct()
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = found.where("sig is null").select("a", "b").distinct().join(rep, F.col("a") == F.col("_id")).select(F.col("_rep").alias("a"), "b")
    small = ordered(first.join(rep, F.col("b") == F.col("_id")).select("a", F.col("_rep").alias("b")))
    members = stored(_frequent(found.where("sig is not null"), rep), "members")
    # the member with the most frequent subsets is the least changed one: most others link to it
    degree = members.groupBy("doc").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "doc").groupBy("sig").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("hub"))
    stars = ordered(members.join(hubs, "sig").select(F.col("hub").alias("a"), F.col("doc").alias("b")))
    tried = stored(small.union(stars).distinct(), "pairs")
    links = verified(docs, sized, tried)
    parts = components(links)
    rest = stored(_open_pairs(members, parts, tried, sized), "pairs")
    if rest.head(1):
        links = links.union(verified(docs, sized, rest))
        parts = components(links)
    out = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _frequent(entries: DataFrame, rep: DataFrame) -> DataFrame:
    """(sig, doc) of frequent subsets, without those that a set's slack lets it leave out."""
    from pyspark.sql import Window

    own = entries.join(rep, F.col("a") == F.col("_id")).groupBy("sig", F.col("_rep").alias("doc"), "band").agg(F.min("slack").alias("slack"))
    often = own.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1")
    per_set = Window.partitionBy("doc", "band").orderBy(F.desc("often"), "sig")
    ranked = own.join(often, "sig").withColumn("_rank", F.row_number().over(per_set))
    return ranked.where("_rank > slack").select("sig", "doc")


def _close(batches):
    """Pairs of one block pair of a group that are in different components and whose sketches allow a link."""
    for batch in batches:
        found = []
        for rows in batch.column("rows"):
            cols = {f.name: rows.values.field(f.name) for f in rows.type.value_type}
            doc, part, n, block = (cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "part", "n", "block"))
            x = np.frombuffer(b"".join(cols["small"].to_pylist()), np.uint8).reshape(len(doc), -1).astype(np.int16)
            across = block.min() != block.max()
            for lo in range(0, len(doc), 16):
                i = slice(lo, lo + 16)
                apart = np.abs(x[i, None, :] - x[None]).sum(2)
                small, large = np.minimum(n[i, None], n[None]), np.maximum(n[i, None], n[None])
                ok = (apart <= (small + large) * (DEN - NUM) // (DEN + NUM)) & (NUM * large <= DEN * small) & (part[i, None] != part[None]) & (doc[i, None] < doc[None])
                if across:
                    ok &= block[i, None] != block[None]
                r, c = np.nonzero(ok)
                found.append(np.stack([doc[i][r], doc[c]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _open_pairs(members: DataFrame, parts: DataFrame, tried: DataFrame, sized: DataFrame) -> DataFrame:
    """Pairs of a frequent subset's members that are still in different components, were not compared and may link.

    Groups are compared in blocks, a pair of blocks at a time; pairs that sketches rule out never become rows.
    """
    at = members.join(parts, F.col("doc") == F.col("node"), "left").select("sig", "doc", F.coalesce("component", "doc").alias("part"))
    several = at.groupBy("sig").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi"), F.count("*").alias("_g")).where("_lo < _hi")
    light = sized.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.col("sketch").alias("small"))
    still = stored(at.join(several.select("sig", F.ceil(F.col("_g") / BLOCK).alias("_blocks")), "sig"), "open")
    still = still.join(light, "doc")
    still = still.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("_blocks")))
    placed = still.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    pair = [F.least("block", "_other").alias("_b1"), F.greatest("block", "_other").alias("_b2")]
    lists = placed.groupBy("sig", *pair).agg(F.collect_list(F.struct("doc", "part", "n", "block", "small")).alias("rows"))
    return lists.select("rows").mapInArrow(_close, "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti")
