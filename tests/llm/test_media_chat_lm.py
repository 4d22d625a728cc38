import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_inputs import documents, odd_documents, words

from tallyframe.llm import chat, lm, mpeg


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_media_round_trip(spark):
    docs = odd_documents(spark).select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    texts = Counter()
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        texts[(r.doc_id, len(b), len(p), digest(p), zlib.crc32(p[-16:]))] += 1
    got = mpeg.read_back(mpeg.media_of_texts(docs)).collect()
    assert Counter(tuple(r)[:5] for r in got) == texts
    assert all(r.hertz == 48000 and r.samples == len(r.offsets) * 1152 == r.payload_bytes // 192 * 1152 for r in got)
    assert all(f"frames={r.payload_bytes // 192};" in r.feature and f"crc={r.payload_bytes // 192}/0;resync=0" in r.feature for r in got)
    odd = mpeg.read_back(mpeg.media_of_texts(odd_documents(spark).where("doc_id = 5"))).collect()
    assert len(odd) == 2 and odd[0] == odd[1]
    assert mpeg.read_back(mpeg.media_of_texts(docs.limit(0))).count() == 0


def test_parser_resynchronises_and_checks():
    raw = mpeg.store(np.full(192 * 5, 65, np.uint8), 950)
    whole = mpeg.parse(raw)
    assert (whole.samples, whole.hertz, whole.crc_good, whole.resyncs, whole.tags["n_bytes"], whole.end_tag) == (5 * 1152, 48000, 5, 0, "950", True)
    assert whole.table["frames"] == 5 and whole.table["bytes"] == 192 + 5 * 240
    cut = mpeg.parse(raw[:700] + b"junk" + raw[940:])
    assert cut.resyncs >= 1 and 2 <= len(cut.offsets) < 5
    at = int(whole.offsets[2])
    broken = mpeg.parse(raw[: at + 8] + b"\x01" + raw[at + 9 :])
    assert (broken.crc_good, broken.crc_bad) == (4, 1)
    for nothing in (b"", b"x", b"\xff\xfb", bytes(500), b"\xff" * 300):
        s = mpeg.parse(nothing)
        assert len(s.offsets) == 0 and s.samples == 0


def test_frames_beside_damage_and_end_tags():
    raw = mpeg.store(np.full(192 * 6, 65, np.uint8), 1150)
    at = mpeg.parse(raw).offsets.tolist()
    assert len(at) == 6
    for k in range(1, 6):  # bytes put in before a frame: all frames are still whole
        hurt = mpeg.parse(raw[: at[k]] + bytes(37) + raw[at[k] :])
        assert len(hurt.offsets) == 6 and hurt.resyncs == 1 and hurt.samples == 6 * 1152
        cut = mpeg.parse(raw[: at[k] - 50] + raw[at[k] :])  # a frame without its end
        assert len(cut.offsets) == 5 and cut.offsets.tolist()[-1] == at[-1] - 50
    body = raw[:-128]
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32 + 10).to_bytes(4, "little") + bytes(16)
    lyrics = b"LYRICSBEGIN" + b"x" * 20 + b"000031" + b"LYRICS200"
    id3 = b"TAG" + b"A title".ljust(30, b"\0") + bytes(95)
    for tail in (bytes(10) + ape, lyrics, bytes(10) + ape + id3, lyrics + id3, b""):
        s = mpeg.parse(body + tail)
        assert len(s.offsets) == 6 and s.resyncs == 0 and s.tags.get("TIT2") == ("A title" if tail.endswith(id3) else None)
    assert len(mpeg.parse(raw).seek) == 100
    plain = (b"\xff\xfb\x90\xc0" + bytes(413)) * 3  # not protected: only neighbours vouch
    assert len(mpeg.parse(plain + b"junk" * 9 + plain).offsets) == 6
    assert len(mpeg.parse(plain[:-100] + plain).offsets) == 5
    guarded = (b"\xff\xfc\x80\x00" + bytes(144 * 128_000 // 44_100 - 4)) * 3
    assert mpeg.parse(guarded).unverified == 3 and mpeg.parse(guarded).crc_bad == 0


@pytest.mark.parametrize("head,n,samples", [(b"\xff\xfd\x80\x00", 144 * 128_000 // 44_100, 1152), (b"\xff\xf3\x84\xc0", 72 * 64_000 // 24_000, 576), (b"\xff\xff\x80\x00", 12 * 256_000 // 44_100 * 4, 384)])
def test_other_layers(head, n, samples):
    """Layer II at 44.1 kHz and 128 kbit/s, MPEG 2 layer III at 24 kHz and 64, layer I at 44.1 kHz and 256."""
    s = mpeg.parse((head + bytes(n - 4)) * 3)
    assert s.samples == 3 * samples and s.offsets.tolist() == [0, n, 2 * n]


def test_media_index_of_any_column(spark):
    df = spark.createDataFrame([(1, mpeg.store(np.full(384, 65, np.uint8), 3)), (2, None), (3, b"noise")], "doc_id long, media binary")
    rows = {r.doc_id: r for r in mpeg.media_index(df).collect()}
    assert rows[1].frames == 2 and rows[1].offsets[1] - rows[1].offsets[0] == 240 and rows[1].tags["n_bytes"] == "3"
    assert rows[2].frames == rows[3].frames == 0


def test_escape_is_reversible():
    for t in ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|>", "[\\INST]", "<<SYS>>x<</SYS>>", "a<", "\\", "<|im_start|>user\n"]:
        assert chat.unescape(chat.escape(t)) == t
        assert all(a + b not in chat.escape(t) for a, b in chat.CONTROL)
        text, spans = chat.format_turns([("user", t), ("assistant", t), ("we\\ird\nrole", t)])
        assert chat.parse_turns(text) == [("user", t), ("assistant", t), ("we\\ird\nrole", t)]
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t]


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, None, None), (-1, 1, "assistant", ""), (None, 0, "user", "x"), (-2, 3, "assistant", "<s>"), (-2, 3, "assistant", "<s>")], rows.schema)
    got = {r.conv_id: r for r in chat.read_back(chat.format_trees(chat.linear_messages(rows.union(odd)))).collect()}
    by = defaultdict(list)
    for r in rows.union(odd).collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    assert set(got) == set(by)
    for i, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == (len(turns), digest(whole.encode()), len(said), digest(said.encode()))
    assert chat.format_trees(chat.linear_messages(rows.limit(0))).count() == 0


def test_best_branch_of_a_tree(spark):
    m = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 1.0),
        (1, 5, 4, "assistant", "end", 9.0), (1, 6, 2, "user", "x", 2.0), (2, 1, 77, "user", "orphan", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
    ]
    df = spark.createDataFrame(m, "tree long, id long, parent long, role string, text string, score double")
    texts = {r.tree: [t for _, t in chat.parse_turns(r.formatted)] for r in chat.format_trees(df).collect()}
    assert texts == {"t1": ["root", "good", "more", "end"], "t2": ["orphan"]}
    both = [[t for _, t in chat.parse_turns(r.formatted)] for r in chat.format_trees(df.where("tree = 1"), branches=5).collect()]
    assert sorted(both) == [["root", "bad", "x"], ["root", "good", "more", "end"]]


def kneser_ney(train):
    c1, c2 = Counter(), Counter()
    for t in train:
        c1.update(t)
        c2.update(zip(["<s>", *t], t))
    follow, n_of, before = Counter(), defaultdict(Counter), Counter()
    for (v, w), c in c2.items():
        follow[v] += c
        n_of[v][min(c, 3)] += 1
        before[w] += 1

    def discounts(counts):
        n = Counter(counts)
        if min(n[1], n[2], n[3], n[4]) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [min(x, k) for k, x in enumerate(d)] if min(d) >= 0 else [0, 0.5, 1.0, 1.5]

    d, e, kinds, vocabulary = discounts(c2.values()), discounts(before.values()), len(c2), len(c1)
    kept = sum(e[min(b, 3)] for b in before.values()) / kinds

    def p(v, w):
        low = (before[w] - e[min(before[w], 3)]) / kinds + kept / (vocabulary + 1)
        if not follow[v]:
            return low
        c = c2[v, w]
        return (c - d[min(c, 3)] + sum(d[k] * n_of[v][k] for k in (1, 2, 3)) * low) / follow[v]

    return p, c1, sum(c1.values()), vocabulary


def test_model_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_PAIRS", 5_000)
    monkeypatch.setattr(lm, "_RUN", 50_000)
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "of the " * 3000)], "doc_id long, text string")).repartition(3)
    train = docs.where("doc_id % 5 <> 1")
    seqs = {r.doc_id: [*words(r.text), "</s>"] for r in docs.collect()}
    p, c1, n, v = kneser_ney([t for i, t in seqs.items() if not (i % 5 == 1 and i > 0)])
    model = lm.train(train)
    assert (model.tokens, model.vocabulary) == (n, v)
    assert math.isclose(sum(p("the", w) for w in c1) + p("the", "unseen word"), 1, rel_tol=1e-9)
    for r in lm.score(docs, model).collect():
        t = seqs[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in c1 for w in t))
        assert math.isclose(r.base_score, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t)), rel_tol=1e-6)


def test_order_three_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_PAIRS", 5_000)
    monkeypatch.setattr(lm, "_RUN", 50_000)
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "of the " * 3000)], "doc_id long, text string")).repartition(3)
    seqs = {r.doc_id: [*words(r.text), "</s>"] for r in docs.collect()}
    train = [t for i, t in seqs.items() if not (i % 5 == 1 and i > 0)]
    c3, before, single, one = Counter(), Counter(), Counter(), Counter()
    for t in train:
        one.update(t)
        c3.update(zip(["<s>", "<s>", *t], ["<s>", *t], t))
    for _, v, w in c3:
        before[v, w] += 1
    for _, w in before:
        single[w] += 1

    def discounts(counts):
        n = Counter(counts)
        if min(n[k] for k in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [min(x, k) for k, x in enumerate(d)] if min(d) >= 0 else [0, 0.5, 1.0, 1.5]

    def level(counts):
        total, mass, d = Counter(), Counter(), discounts(counts.values())
        for gram, c in counts.items():
            total[gram[:-1]] += c
            mass[gram[:-1]] += d[min(c, 3)]
        return lambda gram, low: (counts[gram] - d[min(counts[gram], 3)] + mass[gram[:-1]] * low) / total[gram[:-1]] if total[gram[:-1]] else low

    e = discounts(single.values())
    kept = sum(e[min(b, 3)] for b in single.values()) / len(before)
    p2, p3 = level(before), level(c3)
    p = lambda u, v, w: p3((u, v, w), p2((v, w), (single[w] - e[min(single[w], 3)]) / len(before) + kept / (len(one) + 1)))
    model = lm.train(docs.where("doc_id % 5 <> 1"), order=3)
    assert (model.tokens, model.vocabulary) == (sum(one.values()), len(one)) and model.spread_files
    for r in lm.score(docs, model).collect():
        t = seqs[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in one for w in t))
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (model.tokens + model.vocabulary + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(*g)) for g in zip(["<s>", "<s>", *t], ["<s>", *t], t)), rel_tol=1e-6)
    none = lm.train(docs.limit(0), order=3)
    assert [r.score for r in lm.score(docs.where("doc_id = -2"), none).collect()] == [0.0]


def test_model_of_odd_and_no_texts(spark):
    docs = odd_documents(spark)
    out = lm.score(docs, lm.train(docs))
    assert out.count() == docs.count() and out.where("score > 0 or isnan(score)").count() == 0
    none = lm.train(docs.limit(0))
    assert [r.score for r in lm.score(docs.where("doc_id = 2"), none).collect()] == [0.0]
    assert lm.score(docs.limit(0), none).count() == 0
