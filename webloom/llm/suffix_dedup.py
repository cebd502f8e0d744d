"""Suffix-array removal of repeated byte strings: difference-cover blockwise construction.

A byte goes if a window of `n` bytes that covers it also starts in a document with a smaller id.  Tasks hold the text
of runs that share a minimiser (see repeats), and sort the suffixes at window starts one bucket at a time.  A bucket is
a range of leading bytes, so that its arrays are small.  Ties beyond two machine words are resolved by the ranks of a
difference cover of period 7: any two suffixes reach cover positions by one common step of at most 6.

Defined results: a null text is empty; texts shorter than `n` lose nothing; a later exact copy of a longer text loses
all; rows with the same id never take from one another, equal or not; a null id counts as the largest; a text of any
length is searched whole, in slices of whole documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import release
from webloom.llm.repeats import LAST, Shape, covered, flagged, spans_of

PERIOD = 7
COVER = (0, 1, 3)
#: STEP[a][b]: least step from residues a and b to cover residues.
STEP = [[next(s for s in range(PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
BUCKET = 1 << 18


def _leading(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, high byte first."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    out = np.zeros(len(text) + 56, np.uint64)
    for j in range(8):
        out |= padded[j : j + len(out)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by keys, first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(words: np.ndarray, size: int, depth: int) -> np.ndarray:
    """For each cover position the rank of its suffix, by prefix doubling in steps of the period, to `depth` bytes."""
    at = np.arange(size)
    sample = np.flatnonzero(np.isin(at % PERIOD, COVER))
    rank = np.zeros(size + 8 * depth, np.int64)
    if not len(sample):
        return rank
    rank[sample] = 1 + _dense(words[sample], words[sample + 8])
    step, known = 2 * PERIOD, 16
    while known < depth:
        rank[sample] = 1 + _dense(rank[sample], rank[sample + step])
        known, step = known + step, 2 * step
    return rank


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """`starts` in suffix order to `depth` bytes at least, and the eight bytes from each position."""
    words = _leading(text)
    rank = cover_ranks(words, len(text), depth)
    lead = words[starts]
    cuts = np.sort(lead[:: max(1, BUCKET // 64)])[64::64]
    bucket = np.searchsorted(np.unique(cuts), lead, "right")
    out = []
    by = np.argsort(bucket, kind="stable")
    bounds = np.append(np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) > 0])), len(by)) if len(by) else [0]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = starts[by[lo:hi]]
        order = np.lexsort((words[own + 8], words[own]))
        own = own[order]
        a, b = words[own], words[own + 8]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(tied):
            own[tied] = own[tied][_tie_order(own[tied], group[tied], rank)]
        out.append(own)
    return np.concatenate(out) if out else starts, words


def _tie_order(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order within groups of suffixes with 16 equal bytes: each counts the smaller ones of every residue."""
    residue, below = at % PERIOD, np.zeros(len(at), np.int64)
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    for a in range(PERIOD):
        for b in range(PERIOD):
            if len(members[a]) and len(members[b]):
                key = lambda m, s=STEP[a][b]: group[m] << 40 | rank[at[m] + s]
                theirs = np.sort(key(members[b]))
                below[members[a]] += np.searchsorted(theirs, key(members[a])) - np.searchsorted(theirs, group[members[a]] << 40)
    return np.lexsort((below, group))


def decide(n: int):
    def smaller(text: np.ndarray, at: np.ndarray, owner: np.ndarray, _weight: np.ndarray) -> np.ndarray:
        """Whether the window at each position also starts in a run whose least id is smaller."""
        again = np.zeros(len(text), bool)
        lengths = np.diff(at)
        run = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.flatnonzero(np.arange(len(text)) + n <= at[1:][run])
        order, words = suffix_order(text, starts, n)
        if not len(order):
            return again
        same = np.ones(len(order) - 1, bool)
        for step in (*range(0, n - 7, 8), n - 8):
            w = words[order + step]
            same &= w[1:] == w[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        own = owner[run[order]]
        least = np.minimum.reduceat(own, first)
        again[order] = own > np.repeat(least, np.diff(np.append(first, len(order))))
        return again

    return smaller


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each text, and its digest."""
    shape = Shape(n=n, k=n // 2 - 1, words=False, anywhere=False)
    rows = spans_of(flagged(docs, id_col, text_col), shape, decide(n))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").cast(pa.binary())
            firsts, spans = batch.column("first").to_pylist(), batch.column("spans").to_pylist()
            out = []
            for i, raw, first, own in zip(ids, texts.to_pylist(), firsts, spans, strict=True):
                runs = covered(n, own)
                if first is not None and i > first:
                    runs = [(0, len(raw))] if len(raw) >= n else []
                kept, at = [], 0
                for lo, hi in runs:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                out.append((None if i == LAST else i, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            for lo in range(0, len(out), 2000):
                columns = zip(*out[lo : lo + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        release()

    return rows.select("id", "text", "first", "spans").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
