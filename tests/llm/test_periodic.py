"""Periodic runs against the definition, for arrays, for odd documents and for the whole query."""

import hashlib
import random
import re
import zlib

import numpy as np
from odd_inputs import CLASHES, odd_documents

from tallyframe.llm import periodic
from tallyframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=24, times=3):
    """All runs by comparing a text with itself at every distance."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w, out = np.array([number[x] for x in words], dtype=np.int64), []
    for q in range(1, len(w) // times + 1):
        edge = np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e + q - s >= max(shortest, times * q) and not any((w[s : e + q - p] == w[s + p : e + q]).all() for p in range(1, q)):
                out.append((s, e + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_of_small_alphabets():
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters, text = rng.choice([1, 2, 3, 5]), []
            for _ in range(rng.randint(0, 6)):
                text += [rng.randrange(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 6)
            texts.append(text)
        shortest, times = rng.choice([(24, 3), (4, 3), (1, 2), (6, 2), (12, 4)])
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = periodic.periodic_runs(np.array([x for t in texts for x in t], dtype=np.int64), first, shortest, times)
        rows = list(zip(*[c.tolist() for c in found], strict=True))
        assert [[r[1:] for r in rows if r[0] == k] for k in range(len(texts))] == [brute(t, shortest, times) for t in texts]


def test_odd_documents(spark):
    extra = [(20, "a b c " * 8), (21, "x " * 23), (22, "x\n" * 24), (23, "p q " * 9 + "z " + "p q " * 12), (20, "a b c " * 8 + "a")]
    from odd_inputs import TEXTS

    docs = odd_documents(spark, TEXTS + extra).withColumnRenamed("spans", "runs").withColumnRenamed("key", "a.b")
    rows = periodic.collapse_runs(docs).collect()
    assert len(rows) == len(TEXTS + extra)
    for r in rows:
        words = WORD.findall(r["text"] or "")
        want = brute(words) if len(words) < 1_000 else [(0, len(words), 2)]
        assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == collapsed(words, want)
        assert r["a.b"] == "x" and r["lang"] == "en"
    assert set(CLASHES) - {"spans", "key"} <= set(rows[0].asDict())
    assert periodic.collapse_runs(docs.where("false")).count() == 0


def test_query_against_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    repeated = 0
    for d in docs:
        words = WORD.findall(d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        r = got[d["doc_id"]]
        best = None
        for s, m, q in found:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want and r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        repeated += bool(found)
    assert repeated > 10
