import numpy as np
import pyarrow as pa
import pytest
from odd_inputs import documents

from tallyframe.llm import lm
from tallyframe.llm.kernel import runs


@pytest.mark.parametrize("order", [2, 3])
def test_repeated_words_pairs_and_triples_are_looked_up_once(spark, monkeypatch, order):
    """Texts that come four times need no more looking up than once, and get the same scores."""
    monkeypatch.setattr(lm, "BUCKET_PAIRS", 20_000)
    docs = documents(spark).select("doc_id", "text")
    model = lm.train(docs, order=order)
    texts = [r.text for r in docs.limit(100).collect()] + [None, ""]
    maps = {k: lm.Maps(model.folder, k) for k in ("triples", "pairs", "shared", "words")}
    find, asked = lm.Maps.find, []

    def counted(arrays, name, keys):
        asked[-1] += len(keys)
        return find(arrays, name, keys)

    monkeypatch.setattr(lm.Maps, "find", staticmethod(counted))
    got = []
    for times in (1, 4):
        asked.append(0)
        batch = pa.RecordBatch.from_arrays([pa.array(texts * times, pa.string())], names=["text"])
        ((_, _, data, offsets),) = runs(batch, size=1 << 30)
        got.append(lm._scores(model, maps, data, offsets))
    assert asked[0] == asked[1] < 8 * got[0][0].sum()
    assert all(np.array_equal(np.tile(once, 4), four) for once, four in zip(*got, strict=True))


def test_small_batches_are_scored_together(monkeypatch):
    monkeypatch.setattr(lm, "_RUN", 10_000)
    batches = [pa.RecordBatch.from_arrays([pa.array([n]), pa.array(["x" * size])], names=["id", "text"]) for n, size in enumerate([3_000, 3_000, 3_000, 50_000, 10, 10])]
    out = list(lm._gathered(iter(batches), 1))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1, 2], [3], [4, 5]]
    assert list(lm._gathered(iter([]), 1)) == []


@pytest.mark.parametrize("width", [20, 48, 64])
def test_order_is_a_stable_argsort(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 1_000, 40_000):
        for spread in (1, 3, 40, width - 1):
            top = rng.integers(0, 1 << min(spread, 8), n).astype(np.uint64) << np.uint64(max(0, width - 8))
            key = (top | rng.integers(0, 1 << min(spread, 62), n).astype(np.uint64)) & np.uint64((1 << width) - 1)
            assert np.array_equal(lm._order(key, width), np.argsort(key, kind="stable"))
            distinct, which = lm._distinct(key, width)
            assert np.array_equal(distinct, np.unique(key)) and np.array_equal(distinct[which], key)


def test_bisect_finds_each_number_in_its_range():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << 10, n)) if n < 300 else np.unique(rng.integers(0, 1 << 40, n)) for n in (0, 1, 2, 9, 200, 5_000, 3, 0)]  # short ones differ in the last byte alone
    whole, start = np.concatenate(parts).astype(np.uint64), np.cumsum([0, *map(len, parts)])
    which = rng.integers(0, len(parts), 20_000)
    low = np.where(rng.random(20_000) < 0.5, whole[rng.integers(0, len(whole), 20_000)], rng.integers(0, 1 << 10, 20_000).astype(np.uint64))
    got = lm._bisect((whole >> np.uint64(8)).astype(np.uint32), whole.astype(np.uint8), start[which], start[which + 1], low)
    where = [{int(x): int(start[k]) + i for i, x in enumerate(p)} for k, p in enumerate(parts)]
    assert got.tolist() == [where[k].get(int(x), -1) for k, x in zip(which, low, strict=True)]
