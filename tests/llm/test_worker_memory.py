"""What workers hold at a time, since an executor's workers share its memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from webloom.llm import common, decontaminate, packing
from webloom.llm.common import byte_values, flat, prefix, spans_hash
from webloom.llm.queries import vocabulary


def words(n, seed=5):
    """n words, nearly all different."""
    letters = np.random.default_rng(seed).integers(97, 123, (n, 9), dtype=np.uint8)
    letters[:, 0] = 32
    return letters.tobytes().decode()


class Watched:
    """A tokenizer that notes how many bytes each call gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.calls.append(sum(len(t.encode()) for t in texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_bytes_hash_is_spans_hash(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 5_000, dtype=np.uint8)
    ends = np.append(np.unique(np.random.default_rng(4).integers(1, 3_000, 200)), 5_000)  # the last run is longer than a stretch
    starts = np.append(0, ends[:-1])
    want = spans_hash(prefix(byte_values(data)), starts, ends)
    for stretch in (1, 64, 1_000, 1 << 18):
        monkeypatch.setattr(common, "STRETCH", stretch)
        assert np.array_equal(common.bytes_hash(data, starts, ends), want)
        assert np.array_equal(common.bytes_hash(data, starts[::3], ends[::3]), want[::3])
    assert len(common.bytes_hash(data, starts[:0], ends[:0])) == 0


def test_packing_encodes_few_segments_a_call():
    encoder = packing.Encoder(vocabulary())
    encoder.tokenizer = watched = Watched(encoder.tokenizer)
    texts = [words(20_000), "\n".join(words(6_000, seed=6).split())]  # segments that can be joined, and some that can't
    ids, at = encoder.encode(*flat(pa.array(texts)))
    assert len(watched.calls) > 10 and max(watched.calls) <= 20_000
    for k, text in enumerate(texts):
        assert np.array_equal(ids[at[k] : at[k + 1]], watched.tokenizer.encode(text, add_special_tokens=False).ids)


def peak(call) -> int:
    common.release()
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        common.release()


def test_sums_are_not_of_a_whole_slice():
    data, at = flat(pa.array([words(500)] * 450))  # 2 MB of few words: the sums would be most of what is held
    encoder = packing.Encoder(vocabulary())
    assert len(data) > 2_000_000
    assert peak(lambda: encoder.encode(data, at)) < 32 * len(data)
    assert peak(lambda: decontaminate.terms(data, at)) < 32 * len(data)


def test_decompose_sends_rows_without_python_workers(spark, monkeypatch):
    rows = [(np.array([k % 7, 7 + k % 5]), np.array([1.0, 0.5], np.float32)) for k in range(40)]
    dense = np.zeros((40, 12))
    for k, (t, x) in enumerate(rows):
        dense[k, t] = x
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: 1 / 0)
    v = decontaminate.decompose(spark, rows, 12, 12)
    assert np.allclose(dense @ v @ v.T, dense, atol=1e-4)
