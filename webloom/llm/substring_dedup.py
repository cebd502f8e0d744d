"""Repeated word windows by a compressed FM-index per shard.

A word goes if a window of `n` words that covers it also starts anywhere else.  A shard holds the distinct runs that
share minimisers (see repeats).  It builds the Burrows-Wheeler transform of their words, keeps it as a wavelet matrix of
packed bits with rank counts, and streams the runs' windows through backward search, all in step: a stream ends when
fewer than two places match it, and its matching statistic reaches the threshold if n steps leave two or more.

Defined results: a null text has no words; texts of fewer than `n` words lose nothing; every row of a text that several
rows hold loses all of it, if it has n words, whatever their ids; a text of any length is searched whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import flat, release, slices, word_spans
from webloom.llm.repeats import LAST, SLICE, Shape, covered, flagged, spans_of

#: Windows that are streamed at a time.
STREAMS = 1 << 18


class WaveletMatrix:
    """Ranks of symbols below 2**bits in a sequence, from one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.size, self.levels = len(symbols), []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = len(bit) - int(counts[-1])
            self.levels.append((level, words, counts, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begin = self._walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in self.levels:
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(words[word] & low)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.begin[symbol]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by prefix doubling; the end sorts first."""
    rank, known = symbols.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-known] = rank[known:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = new
        known *= 2
        if known >= depth or new[-1] == len(order) - 1 or known >= len(order):
            return order


class FMIndex:
    """Backward search over a sequence of symbols 1..sigma; 0 separates and ends it."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        order = suffix_array(symbols, depth)
        transform = symbols[order - 1]
        bits = max(1, int(symbols.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        self.wavelet = WaveletMatrix(transform, bits)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.before[symbol]
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching(self, symbols: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """For each end the length, at most n, of the longest stretch before it that two or more places hold."""
        found = np.zeros(len(ends), np.int64)
        for a in range(0, len(ends), STREAMS):
            live = np.arange(a, min(a + STREAMS, len(ends)))
            lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.wavelet.size, np.int64)
            for length in range(1, n + 1):
                lo, hi = self.step(symbols[ends[live] - length], lo, hi)
                go = hi - lo > 1
                live, lo, hi = live[go], lo[go], hi[go]
                if not len(live):
                    break
                found[live] = length
        return found


def decide(n: int):
    def comes_again(words: np.ndarray, at: np.ndarray, _owner: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whether the window at each word is also elsewhere in the shard; runs of weight over 1 come again whole."""
        again = np.zeros(len(words), bool)
        lengths = np.diff(at)
        if not len(lengths):
            return again
        _, symbols = np.unique(words, return_inverse=True)
        run = np.repeat(np.arange(len(lengths)), lengths)
        spread = np.zeros(len(words) + len(lengths), np.int64)
        place = np.arange(len(words)) + run  # a separator follows each run
        spread[place] = symbols + 1
        index = FMIndex(spread, n)
        starts = np.flatnonzero((np.arange(len(words)) + n <= at[1:][run]) & (weight[run] == 1))
        again[starts] = index.matching(spread, place[starts] + n, n) >= n
        several = weight[run] > 1
        again[several & (np.arange(len(words)) + n <= at[1:][run])] = True
        return again

    return comes_again


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 35) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept, intervals): words left, joined by one space, and the removed intervals."""
    shape = Shape(n=n, k=max(2, n * 2 // 7), words=True, anywhere=True)
    rows = spans_of(flagged(docs, id_col, text_col), shape, decide(n))
    names = ["id", "n_words", "n_removed", "kept_sha256", "kept", "intervals"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, at = flat(batch.column("text"))
                starts, ends, begin = word_spans(data, at)
                raw, out = data.tobytes(), []
                for d, (i, copies, own) in enumerate(zip(batch.column("id").to_pylist(), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                    lo, hi = int(begin[d]), int(begin[d + 1])
                    runs = covered(n, own)
                    if copies is not None and copies > 1:
                        runs = [(0, hi - lo)] if hi - lo >= n else []
                    keep = np.ones(hi - lo, bool)
                    for a, z in runs:
                        keep[a:z] = False
                    w = np.flatnonzero(keep) + lo
                    left = b" ".join([raw[a:z] for a, z in zip(starts[w].tolist(), ends[w].tolist(), strict=True)])
                    out.append((None if i == LAST else i, hi - lo, hi - lo - len(w), hashlib.sha256(left).hexdigest(), left, [x for r in runs for x in r]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                columns = [list(c) for c in zip(*out, strict=True)]
                columns[4] = pa.array(columns[4], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        release()

    return rows.select("id", "text", "copies", "spans").mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept string, intervals array<long>")
