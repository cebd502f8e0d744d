"""Best-fit packing by minimum bin slack.

Token counts of documents form a histogram with at most `size` classes, whatever the corpus.  For one bin after the
other, a bitset subset-sum dynamic programme over the lengths still in stock finds the fullest feasible combination
that holds the largest length; that combination leaves the stock as often as the stock allows.  So the plan is a short
list of patterns, each with a repeat count, and a piece finds its bin from its rank among the pieces of its length.

Defined results: a null or empty text is the closing id alone; pieces of one length are ranked by id, piece and checksum,
and those alike in all three are interchangeable; repeated rows are packed each; a text of any length is encoded whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import by_slice, bytes_hash, flat, ragged, release, small_batches, stage

SIZE = 2048
SLICE = 2 << 20
#: Segments that one call of the tokenizer gets as one text.
JOINED = 2_000
#: Texts that are encoded in one call, joined ones being a call each: what it returns takes some 100 bytes a token.
BATCH = 2_000
#: Distinct text segments whose ids a worker keeps from slice to slice.
CACHE = 600_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def _may_be_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte at each place, two at least before it, may end a white space character that is not ASCII."""
    return (data[at - 1] == 0xC2) & ((data[at] == 0x85) | (data[at] == 0xA0)) | (data[at - 2] >= 0xE1) & (data[at - 2] <= 0xE3)


def segments(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of segments that byte-level BPE encodes on their own: a cut is before a space or line end that follows no
    white space, where the vocabulary's pre-tokeniser always ends a token.  Bytes that may close a non-ASCII white
    space allow no cut."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        before = data[:-1]
        cut[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & ~_WHITE[before]
        odd = np.zeros(n, bool)  # byte ends a character that may be white space
        odd[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        odd[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        cut[1:] &= ~odd[:-1]
        cut[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids by segment; equal segments (by 64-bit hash and length) are encoded once and kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a byte-level token has a character a byte
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has: each encoded by itself."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), BATCH):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[lo : lo + BATCH], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same, many as one text, where a token ends between any two of them."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), JOINED):
            group = texts[lo : lo + JOINED]
            text = b"".join(group).decode("utf-8", "replace")
            own = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.n_bytes[own])
            want = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
            at = np.minimum(np.searchsorted(ends, want), max(0, len(ends) - 1))
            if not len(ends) or (ends[at] != want).any() or any(t in text for t in self.added):  # added tokens may take spaces in
                own, counts = self._apart([t.decode("utf-8", "replace") for t in group])
            else:
                counts = np.diff(at + 1, prepend=0)
            ids.append(own)
            lengths.append(counts)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, keys: np.ndarray, texts: list[bytes], joins: np.ndarray) -> None:
        """`joins` says which texts begin with a space and end in no white space, so that such texts can follow each other."""
        own, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        found = [self._together([texts[i] for i in own.tolist()]), self._apart([texts[i].decode("utf-8", "replace") for i in rest.tolist()])]
        keys = keys[np.concatenate([own, rest])]
        ids, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.starts, self.lengths = all_keys[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.lengths, lengths])[order]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and where each document's begin (one more entry)."""
        starts = segments(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, back = np.unique(bytes_hash(data, starts, ends), return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, keys)
        new = (pos == len(self.keys)) | (self.keys[np.minimum(pos, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + new.sum() > CACHE:  # all that this slice has is learned at once, whatever its number
                self.clear()
                new[:] = True
            raw, lo, hi = data.tobytes(), starts[first[new]], ends[first[new]]
            joins = (data[lo] == 0x20) & (hi - lo > 3) & ~_WHITE[data[hi - 1]] & ~_may_be_white(data, hi - 1)
            self._learn(keys[new], [raw[a:z] for a, z in zip(lo.tolist(), hi.tolist(), strict=True)], joins)
        pos = np.searchsorted(self.keys, keys)[back]
        lengths = self.lengths[pos]
        ids = self.ids[ragged(self.starts[pos], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.searchsorted(starts, at)]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, close: int = 0) -> DataFrame:
    """(id, piece, start, length, crc): each document's ids and the closing id, cut where longer than `size`; the first
    piece of a cut document takes the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        yield from by_slice(batches, "text", SLICE, one)
        encoder.cache_clear()  # the worker lives on, and other tasks need its memory
        release()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = flat(batch.column("text"))
        ids, begin = encoder(vocabulary).encode(data, at)
        counts = np.diff(begin) + 1
        closed = np.full(counts.sum(), close, "<u4")
        starts = np.cumsum(counts) - counts
        closed[ragged(starts, counts - 1)] = ids
        n = -(-counts // size)
        doc = np.repeat(np.arange(len(counts)), n)
        piece = ragged(np.zeros(len(n), np.int64), n)
        head = counts - size * (n - 1)
        start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
        length = np.where(piece == 0, head[doc], size)
        raw = memoryview(closed).cast("B")
        lo = 4 * (starts[doc] + start)
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)), np.int64, len(lo))
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["id", "piece", "start", "length", "crc"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, crc long")


@dataclass(frozen=True)
class Pattern:
    """`parts` (length, times) fill each of `repeat` bins."""

    parts: tuple[tuple[int, int], ...]
    repeat: int


def fullest(stock: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of stocked lengths (descending) with the largest sum that is at most `room`."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, times = min(stock[length], room // length) if length <= room else 0, 1
        while left > 0:  # counts in powers of two
            take = min(times, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left, times = left - take, times * 2
        if bits >> room & 1:
            break
    total, found = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            found[length] = found.get(length, 0) + take
    return found


def plan(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    stock, out = {n: c for n, c in histogram.items() if c > 0}, []
    lengths = sorted(stock, reverse=True)
    while lengths:
        top = lengths[0]
        stock[top] -= 1
        parts = fullest(stock, [n for n in lengths if stock[n]], size - top)
        stock[top] += 1
        parts[top] = parts.get(top, 0) + 1
        repeat = min(stock[n] // times for n, times in parts.items())
        for n, times in parts.items():
            stock[n] -= repeat * times
        lengths = [n for n in lengths if stock[n]]
        out.append(Pattern(tuple(sorted(parts.items(), reverse=True)), repeat))
    return out


def ranges(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Which ranks of a length go where: rows (length, first rank, times, first bin, offset) sorted by length and rank."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for p in patterns:
        offset = 0
        for length, times in p.parts:
            rows.append((length, used.get(length, 0), times, bins, offset))
            used[length] = used.get(length, 0) + times * p.repeat
            offset += length * times
        bins += p.repeat
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "bin", "offset"), table.T, strict=True))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, close: int = 0, part_rows: int = 250) -> DataFrame:
    """(id, piece, start, length, crc, sequence, offset).  Only the histogram of lengths comes to the driver."""
    cut = stage(pieces(docs, vocabulary, id_col, text_col, size, close), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = ranges(plan(histogram, size))
    # ranks within (length, part): a common length is dealt to as many parts as its rows need
    n_parts = min(4096, max(1, max(histogram.values(), default=0) // part_rows))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(n_parts)))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "crc"))
    ranked = cut.withColumn("rank", rank.cast("long") - 1)
    if n_parts > 1:
        counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
        begins = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("begin"))
        ranked = ranked.join(begins, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("begin"))
    ranked = ranked.select("id", "piece", "start", "length", "crc", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] << 44 | table["rank"] if table else None
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(keys, length << 44 | rank, "right") - 1
            turn = rank - table["rank"][row]
            sequence = table["bin"][row] + turn // table["times"][row]
            offset = table["offset"][row] + turn % table["times"][row] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "crc")), pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "crc", "sequence", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, crc long, sequence long, offset long")
