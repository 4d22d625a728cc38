"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are scaled to whole numbers. With M the largest length of a candidate, (x, sqrt(M^2 - |x|^2)) and (q, 0) are at
squared distance |q|^2 + M^2 - 2 q.x, so the nearest candidates are those with the largest products, and distances obey
the triangle inequality. Pivots from a bounded sample cut this space into cells. A summary per cell (its k + 1 smallest
distances to the pivot; for queries the largest) bounds, for every query cell, the distance of the k + 1 nearest
candidates: a candidate in cell j at distance r of its pivot can only matter for query cell i if

    d(i, j) - U(i) - theta(i) <= r <= d(i, j) + U(i) + theta(i).

Query cells are put together into groups of about `GROUP` queries, near ones first. A candidate is sent to the groups that
have a cell it can matter for, and there to one of several chunks, so that neither a common vector nor a large cell meets
in one task. Each (group, block of queries, chunk) is solved by one matrix product in exact whole numbers, and the chunks'
best are merged.

Defined results: vectors that are null or empty or hold null or non-finite components take no part; vectors of each length
are searched among their own; components that do not fit 64 bits when scaled, and products that do not, are errors; ties go to the smaller id; with fewer candidates than k all are given;
a query's own id is never its result, other rows with equal vectors are; repeated rows of an id count once, the longest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
PIVOTS = 64
#: Rows the pivots are chosen from: those with the smallest hash of their id.
SAMPLE = 2_048
GROUP = 512
#: Queries that are compared in one task; a group's candidates are copied once per so many.
BLOCK = 8_192
CHUNK = 20_000


def usable_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): one vector of finite components per id."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return good.groupBy("id").agg(F.min(F.struct((-F.size("v")).alias("n"), "v")).alias("m")).select("id", "m.v")


def whole_vectors(good: DataFrame, scale: int) -> DataFrame:
    """(id, v, norm): vectors of one length as 64-bit whole numbers in binary form, and their squared lengths."""

    def run(batches):
        for batch in batches:
            v = _rows(batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.num_rows).astype(np.float64)
            v = np.floor(scale * v)
            if (np.abs(v) >= 2.0**63).any():
                raise ValueError("a scaled component does not fit 64 bits")
            v = v.astype(np.int64)
            norm = (v.astype(np.float64) ** 2).sum(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(norm)], names=["id", "v", "norm"])

    return stored(good.mapInArrow(run, "id bigint, v binary, norm double"), "vectors")


def _rows(flat: np.ndarray, n: int) -> np.ndarray:
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _matrix(column) -> np.ndarray:
    """Binary whole vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _rows(np.frombuffer(b"".join(column.to_pylist()), np.int64), len(column))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """A few rounds of k-means from evenly spaced sample rows."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(many, len(sample))).astype(int)].copy()
    for _ in range(5):
        near = _distances(sample, pivots).argmin(1)
        for j in np.unique(near):
            pivots[j] = sample[near == j].mean(0)
    return pivots


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))[:, None]])




def top_k(rows: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): queries is a condition on the column `id`."""
    good = usable_vectors(rows, id_col, vector)
    lengths = sorted(r["n"] for r in good.select(F.size("v").alias("n")).distinct().collect())  # a row per length
    found = [_top_k(whole_vectors(good.where(F.size("v") == n), scale), queries, k) for n in lengths]
    none = rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found) if found else none


def _top_k(vectors: DataFrame, queries, k: int) -> DataFrame:
    out = "query_id bigint, vec_id bigint, score bigint"
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    asked = vectors.where(queries)
    n_queries = asked.count()
    if not sample.num_rows or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    top = vectors.agg(F.max("norm")).head()[0]
    pivots = choose_pivots(_lifted(_matrix(sample.column("v")), top), PIVOTS)

    def assign(lift: bool):
        def run(batches):
            for batch in batches:
                v = _matrix(batch.column("v"))
                x = _lifted(v, top) if lift else np.hstack([v.astype(np.float64), np.zeros((len(v), 1))])
                d = _distances(x, pivots) if len(v) else np.zeros((0, len(pivots)))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(v)), cell])], names=["id", "v", "cell", "r"])

        return run

    schema = "id bigint, v binary, cell int, r double"
    data = stored(vectors.select("id", "v").mapInArrow(assign(True), schema), "cells")
    own = stored(asked.select("id", "v").mapInArrow(assign(False), schema), "queries")

    def nearest(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, r = batch.column("cell").to_numpy(), batch.column("r").to_numpy()
            for j in np.unique(cell).tolist():
                best[j] = np.sort(np.append(best.get(j, []), r[cell == j]))[: k + 1]
        pairs = [(j, float(x)) for j, xs in best.items() for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.float64())], names=["cell", "r"])

    by_task = data.select("cell", "r").mapInArrow(nearest, "cell int, r double")
    ranked = by_task.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("r"))).where(F.col("_n") <= k + 1)
    near = ranked.select("cell", "r").toArrow()  # at most (k + 1) rows per pivot
    reach = {r["cell"]: (r["u"], r["n"]) for r in own.groupBy("cell").agg(F.max("r").alias("u"), F.count("*").alias("n")).collect()}
    lo, hi, group_of = _bounds(pivots, near, reach, k, top)
    groups = max(group_of.values()) + 1

    def send(batches):
        for batch in batches:
            cell, r = batch.column("cell").to_numpy(), batch.column("r").to_numpy()
            at, to = [], []
            for g in range(groups):
                cells = [i for i, x in group_of.items() if x == g]
                ok = np.any((r[:, None] >= lo[cells][:, cell].T) & (r[:, None] <= hi[cells][:, cell].T), axis=1)
                at.append(np.flatnonzero(ok))
                to.append(np.full(int(ok.sum()), g))
            pick = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("v").take(pick), pa.array(np.concatenate(to).astype(np.int32))], names=["id", "v", "grp"])

    sent = data.mapInArrow(send, "id bigint, v binary, grp int")
    size = {r["grp"]: r["count"] for r in sent.groupBy("grp").count().collect()}  # one row per group of queries
    asked_in = {g: sum(reach[i][1] for i, x in group_of.items() if x == g) for g in range(groups)}
    chunks = F.element_at(F.array(*[F.lit(-(-size.get(g, 0) // CHUNK) or 1) for g in range(groups)]), F.col("grp") + 1)
    blocks = F.element_at(F.array(*[F.lit(-(-asked_in[g] // BLOCK)) for g in range(groups)]), F.col("grp") + 1)
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    left = sent.withColumns({"chunk": F.pmod(F.xxhash64("id"), chunks).cast("int"), "block": F.explode(spread(blocks))})
    grp = F.element_at(F.array(*[F.lit(group_of.get(i, 0)) for i in range(len(pivots))]), F.col("cell") + 1)
    right = own.withColumn("grp", grp).withColumns({"block": F.pmod(F.xxhash64("id"), blocks).cast("int"), "chunk": F.explode(spread(chunks))})

    def solve(candidates: pa.Table, some: pa.Table) -> pa.Table:
        ids, qids = candidates.column("id").to_numpy(), some.column("id").to_numpy()
        x, q = _matrix(candidates.column("v")), _matrix(some.column("v"))
        found = [(np.zeros(0, np.int64),) * 3]
        if len(ids) and len(qids):
            large = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1]
            kind = np.float64 if large < 2**53 else object
            x = x.astype(kind)
            for a in range(0, len(qids), 64):
                score = q[a : a + 64].astype(kind) @ x.T
                for i, qid in enumerate(qids[a : a + 64]):
                    s = score[i]
                    others = np.flatnonzero(ids != qid)
                    if len(others) > k:
                        cut = np.partition(s[others], len(others) - k)[len(others) - k]
                        others = others[s[others] >= cut]
                    # numbers of both signs sort as whole numbers; the smaller id wins a tie
                    order = others[np.lexsort((ids[others], -s[others].astype(np.int64)))][:k]
                    found.append((np.full(len(order), qid), ids[order], s[order].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    unit = ["grp", "block", "chunk"]
    parts = left.groupBy(*unit).cogroup(right.select("id", "v", *unit).groupBy(*unit)).applyInArrow(lambda a, b: solve(a, b), out)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounds(pivots: np.ndarray, near: pa.Table, reach: dict[int, tuple[float, int]], k: int, top: float) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Smallest and largest pivot distance that matters, by query cell and candidate cell, and each query cell's group."""
    apart = _distances(pivots, pivots)
    cell, r = near.column("cell").to_numpy(), near.column("r").to_numpy()
    slack = 1e-6 * (1 + float(apart.max()) + float(r.max()) + float(np.sqrt(top)))
    lo, hi = np.full_like(apart, np.inf), np.full_like(apart, -np.inf)
    for i, (u, _) in reach.items():
        bound = np.sort(apart[i, cell] + u + r)
        theta = bound[k] if len(bound) > k else np.inf
        lo[i], hi[i] = apart[i] - u - theta - slack, apart[i] + u + theta + slack
    group_of, left, g = {}, set(reach), 0
    while left:
        first, many = min(left), 0
        for i in sorted(left, key=lambda j: (apart[first, j], j)):
            if many and many + reach[i][1] > GROUP:
                break
            group_of[i], many = g, many + reach[i][1]
        left -= {i for i, x in group_of.items() if x == g}
        g += 1
    return lo, hi, group_of
