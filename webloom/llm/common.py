"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import kept as stage
from webloom.session import shared_dir, small_batches

__all__ = ["SPACES", "WORD", "by_slice", "byte_values", "bytes_hash", "flat", "mix", "owner_of", "partitions", "prefix", "ragged", "release", "shared_dir", "sized", "slices", "sliding", "small_batches", "spans_hash", "stage", "windows_hash", "word_hashes", "word_spans"]

#: Words are runs of anything but these bytes, in every operator on words.
SPACES = (0x20, *range(0x09, 0x0E))
#: The word pattern for engines with regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def sized(small: DataFrame, rows: int, width: int, most: int = 24 << 20) -> DataFrame:
    """Hint a broadcast of `small` where its counted rows times its row width stay below `most` bytes; else leave it to shuffle."""
    return F.broadcast(small) if rows * width <= most else small


def release() -> None:
    """Gives freed memory back to the system where the allocator can, since workers live on between tasks."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and where each begins (one more entry: the end).  A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about `most` bytes each, so that work on a part has bounded memory."""
    at = flat(batch.column(name))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def by_slice(batches: Iterator[pa.RecordBatch], name: str, most: int, one: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`one` of each slice; its memory goes back before the worker takes another task."""
    for whole in batches:
        for batch in slices(whole, name, most):
            yield one(batch)
    release()


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of its first word (one more entry: the count)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums from which `spans_hash` takes the hash of any run of 64-bit values."""
    up, _ = _grown(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


#: Elements that one polynomial covers.  Modulo 2**64 a longer one is zero for some differences whatever its base (those
#: of Thue-Morse words); over so few elements it is not.
CHUNK = 32


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A span of more than CHUNK elements is hashed as the sequence of its chunks' hashes, which `mix` makes independent
    of each other, and so on."""
    _, down = _grown(len(sums))
    lengths = ends - starts
    long = np.flatnonzero(lengths > CHUNK)
    if not len(long):
        return mix((sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
    out = np.empty(len(starts), np.uint64)
    short = np.flatnonzero(lengths <= CHUNK)
    out[short] = mix((sums[ends[short]] - sums[starts[short]]) * down[starts[short]] + lengths[short].astype(np.uint64))
    parts = -(-lengths[long] // CHUNK)
    at = np.concatenate([[0], np.cumsum(parts)])
    lo = np.repeat(starts[long], parts) + CHUNK * ragged(np.zeros(len(long), np.int64), parts)
    hi = np.minimum(lo + CHUNK, np.repeat(ends[long], parts))
    inner = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    out[long] = mix(spans_hash(prefix(inner), at[:-1], at[1:]) + lengths[long].astype(np.uint64))
    return out


def windows_hash(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums = prefix(values)
    _, down = _grown(len(sums))
    return mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


#: Bytes whose sums `bytes_hash` holds at a time.
STRETCH = 1 << 18


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """`spans_hash` of runs of bytes that follow each other, each byte by its value; sums are of a stretch of the bytes
    at a time, or of one run that is longer, since they take many times the bytes' memory."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STRETCH, "right")))
        base = starts[lo]
        out[lo:hi] = spans_hash(prefix(values[data[base : ends[hi - 1]]]), starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(prefix(byte_values(data)), starts, ends)


def sliding(values: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The least (or by np.maximum the largest) of each run of w values, by doubling."""
    if len(values) < w:
        return values[:0]
    width = 1
    while 2 * width <= w:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[: len(values) - (w - width)], values[w - width :]) if w > width else values


def owner_of(at: np.ndarray) -> np.ndarray:
    """For each element the number of the document that holds it."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all runs one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
