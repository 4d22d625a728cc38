import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_inputs import documents, odd_documents
from tokenizers import Tokenizer

from tallyframe.llm import kernel, packing, records
from tallyframe.llm.tokens import coder

BYTES, WORDS = (public_tokenizers.path(f"{n}_bpe_{k}.json") for n, k in (("byte", "50k"), ("word", "49k")))
HARD = ["", "  a  b \n c\n\nd\t e f   g  ", "<|endoftext|> x", "a<|endoftext|>b  <|startoftext|> c</s>", "<|endoftext|><|endoftext|>", "ÉÉ Σ ΟΔΟΣ  é ́x", "'s it's  's", "a\r\n b", " ", " lead", "trail ", "\n", "12 345  6", "  　x  y", "a ́b", None]


def ids_of(path, texts, special_text=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_text
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_units_give_the_ids_of_whole_texts(spark, path):
    texts = HARD + [r.text for r in documents(spark).limit(80).collect()]
    data, offsets = kernel.utf8(pa.array(texts))
    for special_text in (False, True):
        ids, start = coder(path, special_text).encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:])] == ids_of(path, texts, special_text)


def test_words_are_the_same_units_with_and_without_signs():
    """Signs, digits and single line feeds are units of their own where the pattern parts them, and ids stay those of whole texts."""
    rng = np.random.default_rng(8)
    bits = ["a", "Zb", "'", "'s", "'ll", "1", "9", ".", ",!", "\n", "\n\n", " ", "  ", "\t", "\r", "é", "ß", "…", "\u00a0", "\u0301", "\x1c", "\x7f", "$", "語", "٣", "<|"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 20))) for _ in range(3000)]
    own = type(coder(BYTES))(BYTES)
    ids, start = own.encode(*kernel.utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:])] == ids_of(BYTES, texts)
    words = [f" w{'abcdefghij'[i]}{'klmnopqrst'[j]}" for i in range(10) for j in range(10)]
    own = type(coder(BYTES))(BYTES)
    own.encode(*kernel.utf8(pa.array(["".join(words), ".".join(words), ",".join(words) + "!", "\n".join(w.strip() for w in words), "7".join(words)])))
    assert len(own.keys) < 2.5 * len(words)


def test_crc32c_known_answers():
    d = np.frombuffer(b"123456789" + bytes(32) + b"\xff" * 32, np.uint8)
    assert records.crc32c(d, np.array([0, 9, 41, 5]), np.array([9, 41, 73, 5])).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43, 0]


def test_frames_are_checked():
    raw, at = records.framed(np.arange(100, dtype=np.uint8), np.array([0, 0, 7, 100]))
    begin, end = records.checked(raw, at)
    assert (end - begin).tolist() == [0, 7, 93]
    for k in range(0, len(raw), 5):
        bad = raw.copy()
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.checked(bad, at)


def test_record_files_round_trip(spark):
    for docs in (documents(spark), odd_documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        start, want = 0, []
        for (i, _), ids in zip(rows, ids_of(BYTES, [t for _, t in rows])):
            ids = ids + [2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = [tuple(r) for r in records.read_records(records.record_files(docs, BYTES, 2)).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert records.read_records(records.record_files(docs.limit(0), BYTES, 2)).count() == 0


def test_packing(spark):
    for docs in (documents(spark), odd_documents(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = Counter()
        for (i, _), ids in zip(rows, ids_of(WORDS, [t for _, t in rows])):
            ids = ids + [0]
            for piece, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want[(i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        got = packing.packed_documents(docs, WORDS, 0).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        full = defaultdict(list)
        for r in got:
            full[r.sequence_id].append((r.offset, r.length))
        for places in full.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 2048
        total = sum(r.length for r in got)
        assert len(full) <= -(-total // 2048) * 1.02 + 1
    assert packing.packed_documents(docs.limit(0), WORDS, 0).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_the_optimum(seed):
    """Against exhaustive search on small instances: what is fixed leaves an optimal packing possible."""
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(2, 20, rng.integers(1, 9)).tolist(), reverse=True)

    def optimum(items):
        best = [len(items)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= 20:
                    go(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1 :])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best[0] if items else 0

    class Reduced(packing.Plan):
        def _best_fit(self):
            pass

    plan = Reduced(dict(Counter(lengths)), 20)
    rest = [n for n in range(20, 0, -1) for _ in range(int(plan.left[n]))]
    assert plan.reduced + optimum(rest) == optimum(lengths)
    full = packing.Plan(dict(Counter(lengths)), 20)
    assert optimum(lengths) <= full.sequences <= optimum(lengths) + 1
