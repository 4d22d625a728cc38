import itertools

import numpy as np
from odd_inputs import documents, odd_documents, words

from tallyframe.llm import graph
from tallyframe.llm import ngram_join as J


def brute(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_groups(df).collect()}


def test_documents_like_brute_force(spark):
    docs = documents(spark)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_dense_groups_with_frequent_subsets(spark, monkeypatch):
    """Many near copies around the threshold, a passage that many share, and tiny groups and blocks."""
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    base, passage, rows = [word() for _ in range(60)], [word() for _ in range(50)], []
    for i in range(70):
        t = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            t[k] = word()
        rows.append((i, " ".join(t)))
    for i in range(70, 110):
        rows.append((i, " ".join([word() for _ in range(rng.integers(3, 60))] + passage)))
    for i in range(110, 140):  # small sets, one element apart
        rows.append((i, " ".join(base[: rng.integers(5, 12)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = J.jaccard_groups(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (2, 5)
    assert by[6][1] == by[7][1] == 6 and by[None][1] is None
    assert J.jaccard_groups(docs.limit(0)).count() == 0


def test_signatures_keep_every_pair():
    """Pairs at the threshold share an index entry, whatever is left out."""
    rng = np.random.default_rng(1)
    for n in [3, 4, 7, 10, 20, 33, 60, 100, 250, 700]:
        for _ in range(20):
            m = int(rng.integers(-(-n * 3 // 4), n + 1))
            both = -(-3 * (n + m) // 7)
            if both > min(n, m):
                continue
            pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64))
            r, s = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
            sets, start = np.concatenate([r, s]), np.array([0, len(r), len(r) + len(s)])
            sig, row, *_ = J.index_entries(sets, start)
            if both * 7 >= 3 * (n + m) and (n, m) != (both, both):
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (n, m, both)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    a, b, c = ("one two three four five six seven eight " + w for w in ("nine", "ten eleven twelve", "x"))
    rows = [(1, a), (2, b), (2, a), (3, b), (4, "nothing like the others at all here"), (4, c), (None, a), (5, None), (5, "")]
    out = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in out.collect())
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (4, 1 if linked(a, c) else 4), (4, 1 if linked(a, c) else 4), (0, 0), (5, 5), (5, 5)])


def linked(x, y):
    r, s = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
    return 100 * len(r & s) >= 75 * len(r | s)
