"""The prefix trie of conversations: which first turns they share, and how many tokens sharing would save.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it. The
operator returns a row per node and, apart, which conversations end there.

Conversations are sorted by their turns and dealt out in ranges. A shard (one Arrow batch) is an index of vertical bitmaps:
(position, turn) -> the bitset of its conversations, ascending by id. A depth-first walk starts with all of them; the
parent's bitset, intersected with the posting of its lowest member's next turn, is a child, its popcount the members, its
lowest bit the smallest id, its intersection with the conversations that stop there the end list; what is left has the other
children. A single member's remaining turns are a chain and need no intersections. Shards know a node by a hash of its turns,
so nodes on both sides of a border are added up; any dealing gives the same result.

Sums over subtrees are sums over members. A node belongs to its smallest member; a conversation then owns all nodes of its
path from some depth o on, and adds to a node of depth d above o the words of its turns d to o - 1, which a shared prefix need
not store again. It adds 1 to the leaves of every node on its path if it owns a leaf.

Long conversations are cut into segments of `SEGMENT` turns, each in the tree of the segments before it, so a row stays small
however long a conversation is. Turns travel as hashes (128 bits; chance equality is neglected) and word counts, never texts.

Defined results: null role and text are empty, and so are the words of a null text; turns come by number, null first, rows of
one number by an MD5 of role and text; repeated rows are turns of their own; rows without a conversation id take no part;
other columns are ignored; a conversation without turns ends at the root; no conversations give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_in

SEGMENT = 1_024
RANGE = 1_024


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns numbered from 0 by their order, texts replaced by a digest and a word count.

    Turn numbers are cut into ranges; rows are numbered inside their range, after the sizes of the ranges before it, so that
    one conversation with very many turns is not one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    part = F.coalesce(F.floor(F.col("turn") / RANGE).cast("long"), F.lit(-(1 << 62)))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", part.alias("part"), digest.alias("digest"), words_in(text).alias("words"))
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")
    return turns.join(sizes, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.row_number().over(inside) - 1).alias("pos"), "digest", "words")


def _segments(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation and SEGMENT turns: hashes (x1, x2) and words per turn, and what came before."""
    x = [F.xxhash64("pos", "digest").alias("x1"), F.xxhash64(F.lit("second"), "digest", "pos").alias("x2")]
    seg = F.floor(F.col("pos") / SEGMENT).alias("seg")
    made = turns.select("conv_id", seg, "pos", *x, "words").groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "words"))).alias("t"), F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.sum("words").alias("w")
    )
    none = ids.join(made.select("conv_id").distinct(), "conv_id", "left_anti")
    empty = F.array().cast(made.schema["t"].dataType)
    made = made.unionByName(none.select("conv_id", F.lit(0).cast("long").alias("seg"), empty.alias("t"), *[F.lit(0).cast("long").alias(c) for c in ("s1", "s2", "w")]))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    so_far = lambda c: F.coalesce(c.over(before), F.lit(0))
    return made.select(
        "conv_id",
        "seg",
        so_far(F.bit_xor("s1")).alias("p1"),
        so_far(F.bit_xor("s2")).alias("p2"),
        so_far(F.sum("w")).alias("w0"),
        F.sum("w").over(whole).alias("total"),
        (F.col("seg") == F.max("seg").over(whole)).alias("last"),
        *[F.col(f"t.{c}").alias(c) for c in ("x1", "x2", "words")],
    )


NODE = "h1 long, h2 long, q1 long, q2 long, depth long, n long, conv_id long, words long, upto long, ends array<long>"


class _Shard:
    """The paths of one batch of segments, as arrays: ranks by id, path hashes and running words."""

    def __init__(self, batch: pa.RecordBatch):
        order = np.argsort(batch.column("conv_id").to_numpy(zero_copy_only=False), kind="stable")
        batch = batch.take(pa.array(order))
        col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.ids, self.seg, self.p1, self.p2, self.w0, self.last = (col(c) for c in ("conv_id", "seg", "p1", "p2", "w0", "last"))
        lists = [batch.column(c) for c in ("x1", "x2", "words")]
        self.size = np.diff(lists[0].offsets.to_numpy())
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.x1, self.x2, self.words = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
        row = np.repeat(np.arange(len(self.ids)), self.size)

        def along(values, start, op):  # running values of each row, from its own start
            run = op.accumulate(values) if len(values) else values
            zero = np.concatenate([[0], run])[self.first[:-1]]
            return op(run, zero[row]) ^ start[row] if op is np.bitwise_xor else run - zero[row] + start[row]

        self.h1, self.h2 = along(self.x1, self.p1, np.bitwise_xor), along(self.x2, self.p2, np.bitwise_xor)
        self.upto = along(self.words, self.w0, np.add)
        self.base = self.seg * SEGMENT


def _bits(b: int):
    while b:
        low = b & -b
        yield low.bit_length() - 1
        b ^= low


def _shard_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The nodes of a shard, by depth-first intersection of bitmaps."""
    s = _Shard(batch)
    first, size, ids = s.first.tolist(), s.size.tolist(), s.ids.tolist()
    x1, x2, h1, h2 = s.x1.tolist(), s.x2.tolist(), s.h1.tolist(), s.h2.tolist()
    words, upto, last, base = s.words.tolist(), s.upto.tolist(), s.last.tolist(), s.base.tolist()
    roots: dict[tuple, int] = {}
    postings: dict[tuple, int] = {}
    stops: dict[int, int] = {}
    for r, root in enumerate(zip(s.seg.tolist(), s.p1.tolist(), s.p2.tolist(), strict=True)):
        bit = 1 << r
        roots[root] = roots.get(root, 0) | bit
        if last[r]:
            stops[size[r]] = stops.get(size[r], 0) | bit
        for k in range(size[r]):
            key = (k, x1[first[r] + k], x2[first[r] + k])
            postings[key] = postings.get(key, 0) | bit
    out: list[list] = [[] for _ in range(10)]

    def emit(*values):
        for c, v in zip(out, values, strict=True):
            c.append(v)

    for (seg, p1, p2), members in roots.items():
        stack = [(members, 0, p1, p2, 0, 0)]
        while stack:
            b, k, a1, a2, q1, q2 = stack.pop()
            r = (b & -b).bit_length() - 1
            ended = b & stops.get(k, 0)
            at = first[r] + k - 1
            if k:
                emit(a1, a2, q1, q2, base[r] + k, b.bit_count(), ids[r], words[at], upto[at], [ids[i] for i in _bits(ended)])
            elif seg == 0:
                emit(a1, a2, None, None, 0, b.bit_count(), ids[r], 0, 0, [ids[i] for i in _bits(ended)])
            if b & (b - 1) == 0:  # one member: the rest is a chain
                for j in range(k, size[r]):
                    at = first[r] + j
                    q1, q2, a1, a2 = a1, a2, h1[at], h2[at]
                    end = [ids[r]] if last[r] and j + 1 == size[r] else []
                    emit(a1, a2, q1, q2, base[r] + j + 1, 1, ids[r], words[at], upto[at], end)
                continue
            rest = b & ~ended
            while rest:
                r = (rest & -rest).bit_length() - 1
                at = first[r] + k
                if k >= size[r]:  # goes on in the next segment
                    rest &= rest - 1
                    continue
                child = rest & postings[(k, x1[at], x2[at])]
                rest &= ~child
                stack.append((child, k + 1, h1[at], h2[at], a1, a2))
    types = [pa.int64()] * 9 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in NODE.split(", ")])


def _shard_shares(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What a shard's conversations add to the saved words and the leaves of the nodes on their paths, added up per node."""
    s = _Shard(batch)
    order = np.argsort(batch.column("conv_id").to_numpy(zero_copy_only=False), kind="stable")
    own, before, alone = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("own", "before", "alone"))
    row = np.repeat(np.arange(len(s.ids)), s.size)
    depth = np.arange(len(row)) - s.first[:-1][row] + s.base[row] + 1
    tops = np.flatnonzero(s.seg == 0)  # the root
    row, depth = np.concatenate([row, tops]), np.concatenate([depth, np.zeros(len(tops), np.int64)])
    h1, h2 = np.concatenate([s.h1, s.p1[tops]]), np.concatenate([s.h2, s.p2[tops]])
    above = np.concatenate([s.upto - s.words, np.zeros(len(tops), np.int64)])
    saved = np.where(depth < own[row], before[row] - above, 0)
    leaf = (depth < alone[row]).astype(np.int64)
    some = np.flatnonzero((saved != 0) | (leaf != 0))
    by = some[np.lexsort((h2[some], h1[some]))]
    a, b = h1[by], h2[by]
    head = np.ones(len(by), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(head)
    add = lambda v: np.add.reduceat(v[by], at) if len(at) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[at], b[at], add(saved), add(leaf))], names=["h1", "h2", "saved", "leaves"])


def _each(fn):
    def run(batches):
        for batch in batches:
            yield fn(batch)

    return run


def trie(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of numbered turns (conv_id, pos from 0, digest, words); ids has every conversation once.

    Nodes: h1, h2 (the hash of the path), conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens. Ends: h1, h2, conv_id.
    """
    segments = stored(_segments(turns, ids), "segments")
    dealt = segments.repartitionByRange("seg", "p1", "x1", "conv_id").sortWithinPartitions("seg", "p1", "x1", "conv_id")
    parts = stored(dealt.mapInArrow(_each(_shard_nodes), NODE), "parts")
    first = [F.first(c).alias(c) for c in ("q1", "q2", "depth", "words", "upto")]
    nodes = stored(parts.groupBy("h1", "h2").agg(*first, F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.size("ends")).alias("n_ends")), "nodes")
    far = F.lit((1 << 62))
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("own"),
        F.min_by(F.col("upto") - F.col("words"), "depth").alias("before"),
        # how deep others are still on the path, for conversations that own a leaf
        F.when(F.bool_or(F.col("n_convs") == F.col("n_ends")), F.coalesce(F.min(F.when(F.col("n_convs") == 1, F.col("depth"))), far)).otherwise(0).alias("alone"),
    )
    shared = segments.join(owners, "conv_id", "left").select(
        "conv_id", "seg", "p1", "p2", "w0", "last", "x1", "x2", "words", F.coalesce("own", far).alias("own"), F.coalesce("before", "total").alias("before"), F.coalesce("alone", F.lit(0)).alias("alone")
    )
    shares = shared.mapInArrow(_each(_shard_shares), "h1 long, h2 long, saved long, leaves long")
    shares = shares.groupBy("h1", "h2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    children = nodes.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    full = nodes.join(children, ["h1", "h2"], "left").join(shares, ["h1", "h2"], "left").join(parents, ["q1", "q2"], "left")
    done = full.select(
        "h1",
        "h2",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        zero("n_children").alias("n_children"),
        F.when(F.col("n_convs") == 1, F.lit(1)).otherwise(zero("leaves")).cast("long").alias("n_leaves"),
        zero("saved").alias("saved_tokens"),
    )
    return done, parts.select("h1", "h2", F.explode("ends").alias("conv_id"))


def prefix_trie(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends, as `trie` gives them, of conversations (conv_id, turn, role, text)."""
    turns = stored(numbered_turns(rows), "turns")
    return trie(turns, turns.select("conv_id").distinct())


def with_shared_heads(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and ids of conversations whose first `head` (at most `most`) turns are those of conversation `base`."""
    ids = turns.select("conv_id").distinct().select("conv_id", head.alias("head"), base.alias("base"))
    tops = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    length = tops.groupBy("base").agg(F.count("*").alias("length"))
    plan = stored(ids.join(length, "base", "left").withColumn("taken", F.least("head", F.coalesce("length", F.lit(0)))), "heads")
    heads = plan.join(tops, "base").where(F.col("pos") < F.col("head")).select("conv_id", "pos", "digest", "words")
    own = turns.join(plan.select("conv_id", "head", "taken"), "conv_id").where(F.col("pos") >= F.col("head"))
    return heads.unionByName(own.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "digest", "words")), plan.select("conv_id")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256): hash of each node's ending ids, ascending and joined by commas, taken row by row of a sorted partition."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            made: tuple[list, list, list] = ([], [], [])
            for h1, h2, conv in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "conv_id")), strict=True):
                if (h1, h2) != key:
                    if key is not None:
                        for c, v in zip(made, (*key, state.hexdigest()), strict=True):
                            c.append(v)
                    key, state = (h1, h2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string())], names=["h1", "h2", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["h1", "h2", "ends_sha256"])

    return ends.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "conv_id").mapInArrow(run, "h1 long, h2 long, ends_sha256 string")
