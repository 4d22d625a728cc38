"""The prefix trie against brute force: shared and long conversations, odd rows, and the query by itself."""

import hashlib
import re
import zlib
from collections import defaultdict

from odd_inputs import CLASHES
from pyspark.sql import functions as F

from tallyframe.llm import trie
from tallyframe.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def digest(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def turns_of(rows):
    """Turns (digest, words) of each conversation, in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
            convs[conv].append(((turn is not None, turn or 0), digest(role, text), words))
    return {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}


def brute(convs):
    """All nodes by their paths."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for c in sorted(convs):
        path = tuple(d for d, _ in convs[c])
        for k in range(len(path) + 1):
            members[path[:k]].append(c)
            if k:
                words[path[:k]] = convs[c][k - 1][1]
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words[p] + sum(saved[q] for q in children[p])
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p in members
    )


def got(nodes, ends):
    rows = nodes.join(trie.ends_digest(ends), ["h1", "h2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return sorted((*[r[c] for c in COLUMNS], r["ends_sha256"] or none) for r in rows.collect())


def frame(spark, rows):
    odd = [F.lit("x").alias(c) for c in [*CLASHES, "a.b", "pos", "digest", "words"]]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *odd)


ODD = [
    (1, 0, "user", "hello  there"),
    (1, 1, "assistant", "a b c"),
    (2, None, "user", "hello  there"),
    (2, 5, "assistant", "a b c"),
    (2, 9, "user", "more"),
    (3, 0, None, None),
    (3, 0, None, None),
    (4, 0, "", ""),
    (None, 0, "user", "nobody"),
    (5, 7, "user", "same number"),
    (5, 7, "assistant", "same number"),
    (5, -3, "user", "before"),
    (6, 0, "userhello", ""),
    (7, 0, "user", "hello"),
    *[(8, t, "user", "hello  there" if not t else f"turn {t % 7}") for t in range(2_600)],
    *[(9, t, "user", "hello  there" if not t else f"turn {t % 7}") for t in range(2_600)],
    *[(10, t, "user", "hello  there" if not t else f"turn {t % 7 if t < 2_100 else 9}") for t in range(2_300)],
    *[(11, t, "user", "hello  there" if not t else f"turn {t % 7}") for t in range(2_048)],
    *[(100 + k, t, "user", f"many {t if k % 3 else 0}") for k in range(300) for t in range(k % 4 + 1)],
]


def test_odd_rows(spark):
    rows = frame(spark, ODD).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # several shards
    try:
        assert got(*trie.prefix_trie(rows)) == brute(turns_of(ODD))
        assert got(*trie.prefix_trie(rows.where("false"))) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_conversations_without_turns(spark):
    turns = trie.numbered_turns(frame(spark, ODD[:5]))
    ids = spark.range(1, 5).withColumnRenamed("id", "conv_id")
    assert got(*trie.trie(turns, ids)) == brute(turns_of(ODD[:5]) | {3: [], 4: []})
    assert got(*trie.trie(turns.where("false"), ids)) == brute({k: [] for k in (1, 2, 3, 4)})


def test_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs, rebuilt = turns_of(rows), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    out = QUERIES["op12_prefix_trie"](spark, folder)
    assert sorted(tuple(r[c] for c in [*COLUMNS, "ends_sha256"]) for r in out.collect()) == brute(rebuilt)
