"""Windows of n elements (bytes or words) that come again: what suffix-array and FM-index removal share.

Each window is named by its minimiser, the least hash among its k-grams, so equal windows always share one.

1. `repeated`: batches send the minimisers of their texts, packed by ranges of the hash; the task of a range sees which
   come again and returns them to their documents.  One batch sends a minimiser once, however common it is.
2. `candidates`: each document cuts itself into maximal runs of windows with one minimiser, keeps the runs whose
   minimiser comes again, and sends their text to the task of that minimiser; equal runs of a batch are sent once.
3. The operator decides windows within such a task, by its own index, and returns spans to the documents.

Keys are truncated hashes: an accidental collision in step 1 only adds candidates.  No step gathers a group of equal
windows without aggregating it within batches first.  Exact copies of a text never get that far: see `flagged`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import byte_values, flat, mix, owner_of, partitions, prefix, ragged, release, sized, sliding, slices, small_batches, spans_hash, stage, windows_hash, word_hashes, word_spans

SLICE = 2 << 20
#: Text bytes that a batch gathers before it sends.
FLUSH = 24 << 20
SHIFT = np.uint64(20)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Windows of n elements, anchored by k-grams.  once: a window counts as repeated if it comes again anywhere, the
    same document included; else if a document with another id holds it."""

    n: int
    k: int
    words: bool
    anywhere: bool

    @property
    def w(self) -> int:
        return self.n - self.k + 1


def pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def lists(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Values gathered by group: the first row of each group in sorted order, and the lists."""
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return order[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(g)).astype(np.int32)), pa.array(values[order].astype(np.int64)))


@dataclass
class Elements:
    """The elements of a slice of documents, their windows' minimisers, and the runs of equal ones."""

    data: np.ndarray
    at: np.ndarray
    values: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    grams: np.ndarray
    least: np.ndarray
    doc: np.ndarray
    valid: np.ndarray
    begin: np.ndarray  # where a document's elements begin

    @classmethod
    def of(cls, column, shape: Shape) -> Elements:
        data, at = flat(column)
        starts = ends = None
        values, begin = byte_values(data), at
        if shape.words:
            starts, ends, begin = word_spans(data, at)
            values = spans_hash(prefix(values), starts, ends)
        grams = windows_hash(values, shape.k)
        least = sliding(grams, shape.w)
        doc = owner_of(begin)
        valid = doc[: len(least)] == doc[shape.n - 1 :] if len(least) else np.zeros(0, bool)
        return cls(data, at, values, starts, ends, grams, least, doc, valid, begin)

    def anchors(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """(key, document) of minimisers: each place that is one, or for distinct ids each run."""
        if shape.anywhere:
            pad = np.zeros(shape.w - 1, np.uint64)
            most = sliding(np.concatenate([pad, np.where(self.valid, self.least, np.uint64(0)), pad]), shape.w, np.maximum)
            at = np.flatnonzero(self.grams == most) if len(self.least) else np.zeros(0, np.int64)
            return self.grams[at] >> SHIFT, self.doc[at]
        at, _ = self.runs()
        return self.least[at] >> SHIFT, self.doc[at]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window (exclusive) of the runs."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = self.valid[1:] & self.valid[:-1] & (self.least[1:] == self.least[:-1]) & (self.doc[1 : len(self.least)] == self.doc[: len(self.least) - 1])
        first, last = self.valid.copy(), self.valid.copy()
        first[1:] &= ~joined
        last[:-1] &= ~joined
        return np.flatnonzero(first), np.flatnonzero(last) + 1


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the keys: the order of buckets is the order of keys."""
    return ((keys >> np.uint64(20)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def flagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k2, text, first, copies): an id and a text hash stand for a row; `first` is the least id of the rows with
    this text and `copies` their number, where there are several.  Only groups of several rows are joined."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"k2": F.hash("text"), "t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})
    groups = rows.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = stage(groups, "copies")
    return rows.join(sized(groups, groups.count(), 48), ["t1", "t2"], "left").select("id", "k2", "text", "first", "copies")


def _gathered(batches: Iterator[pa.RecordBatch], flush: Callable, take: Callable, most: int = FLUSH) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            held.append(take(batch))
            size += batch.column("text").nbytes
            if size >= most:
                yield from flush(held)
                held, size = [], 0
                release()
    if held:
        yield from flush(held)
    del held
    release()


ANCHORS = "bucket int, kind int, to int, h binary, d binary, ids binary"
_ANCHOR_NAMES = [x.split()[0] for x in ANCHORS.split(", ")]
_ANCHOR_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _send(held: list, n: int, back: int, distinct_ids: bool, counts: bool) -> Iterator[pa.RecordBatch]:
    """One batch's (key, id) to ranges of keys: one entry a key; what already comes again here goes back as it is."""
    keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if distinct_ids and len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    several = np.repeat(sizes > 1, sizes)
    rows = [(to % n, 1, to, h, None, i) for to, h, i in _returned(ids[several], keys[several], back, counts)]
    # one entry a key: number of its document in a table, or 0 if it is known to come again
    keys, single, ids = keys[first], sizes == 1, ids[first]
    bounds = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[b], bounds[b + 1]
        known, number = np.unique(ids[lo:hi][single[lo:hi]], return_inverse=True)
        d = np.zeros(hi - lo, np.int64)
        d[single[lo:hi]] = number + 1
        rows.append((b, 0, None, pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), pack(d), pack(np.diff(known, prepend=0))))
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ANCHOR_TYPES)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ANCHOR_TYPES, strict=True)], _ANCHOR_NAMES)


def _place(ids: np.ndarray, back: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(back)).astype(np.int64)


def _returned(ids: np.ndarray, keys: np.ndarray, back: int, counts: bool) -> list[tuple[int, bytes, bytes]]:
    """(place, keys, ids): what goes back to the ids of a place, packed; of `counts`, how many keys an id has."""
    if counts:
        ids, keys = np.unique(ids, return_counts=True)
    place = _place(ids, back)
    order = np.lexsort((keys, ids, place))
    place, ids, keys = place[order], ids[order], keys[order].astype(np.uint64)
    bounds = np.searchsorted(place, np.arange(back + 1))
    return [(to, pack(keys[bounds[to] : bounds[to + 1]]), pack(np.diff(ids[bounds[to] : bounds[to + 1]], prepend=0))) for to in np.flatnonzero(np.diff(bounds)).tolist()]


def repeated_keys(rows: DataFrame, take: Callable, distinct_ids: bool, counts: bool = False, flush_bytes: int = FLUSH) -> DataFrame:
    """(id, keys): which of the 44-bit keys that `take` finds in a batch with columns id and text come again, with
    another id or at all; with `counts`, (id, n): how many of them.  What goes out to a range of keys and what comes back
    from it to a part of the ids is one packed row each."""
    back = partitions(rows.sparkSession)
    n = 4 * back

    def meet(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.equal(table["kind"], 1)).select(["to", "h", "ids"])
        sent = table.filter(pa.compute.equal(table["kind"], 0))
        keys, ids, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for h, d, i in zip(sent["h"].to_pylist(), sent["d"].to_pylist(), sent["ids"].to_pylist(), strict=True):
            number = unpack(d)
            keys.append(np.cumsum(unpack(h, np.uint64), dtype=np.uint64))
            ids.append(np.concatenate([[0], np.cumsum(unpack(i))])[number])
            known.append(number == 0)
        keys, ids, known = map(np.concatenate, (keys, ids, known))
        order = np.argsort(keys, kind="stable")
        keys, ids, known = keys[order], ids[order], known[order]
        same = keys[1:] == keys[:-1]
        again = np.zeros(len(keys), bool)
        again[1:] |= same
        again[:-1] |= same
        again &= ~known
        found = _returned(ids[again], keys[again], back, counts)
        columns = list(zip(*found, strict=True)) or [[]] * 3
        release()
        return pa.concat_tables([own, pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, own.schema.types, strict=True)], schema=own.schema)])

    def gather(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x, np.uint64) for x in table["h"].to_pylist()])
        ids = np.concatenate([np.cumsum(unpack(x)) for x in table["ids"].to_pylist()])
        if counts:
            known, number = np.unique(ids, return_inverse=True)
            return pa.table({"id": pa.array(known), "n": pa.array(np.bincount(number, keys.astype(np.int64), len(known)).astype(np.int64))})
        lead, own = lists(ids, keys)
        return pa.table({"id": pa.array(ids[lead]), "keys": own})

    sent = rows.mapInArrow(lambda it: _gathered(it, lambda held: _send(held, n, back, distinct_ids, counts), take, flush_bytes), ANCHORS)
    met = sent.groupBy("bucket").applyInArrow(meet, "to int, h binary, ids binary")
    return met.groupBy("to").applyInArrow(gather, "id long, n long" if counts else "id long, keys array<long>")


def repeated(firsts: DataFrame, shape: Shape) -> DataFrame:
    """(id, keys): the minimisers of each document that come again."""

    def take(batch: pa.RecordBatch):
        keys, doc = Elements.of(batch.column("text"), shape).anchors(shape)
        return keys, batch.column("id").to_numpy()[doc]

    return repeated_keys(firsts.select("id", "text"), take, not shape.anywhere)


RUNS = "bucket int, kind int, to int, body binary, sizes binary, weight binary, number binary, ids binary, k2s binary, begins binary, ends binary"
_RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]
_RUN_TYPES = [*[pa.int32()] * 3, *[pa.binary()] * 8]
_SPANS = ["to", "ids", "k2s", "begins", "ends"]


def spans_table(ids: np.ndarray, k2s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Spans gathered by row: ids, second keys, and lists of start, end, start, end, ..."""
    order = np.lexsort((k2s, ids))
    i, k = ids[order], k2s[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])])) if len(i) else np.zeros(0, np.int64)
    both = np.stack([starts[order], ends[order]], 1).reshape(-1)
    return i[first], k[first], pa.ListArray.from_arrays(pa.array((2 * np.append(first, len(i))).astype(np.int32)), pa.array(both.astype(np.int64)))


def _spans_back(ids: np.ndarray, k2s: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: int) -> list[tuple]:
    """(place, ids, second keys, starts, ends): spans packed for each place that has some."""
    place = _place(ids, back)
    order = np.lexsort((starts, k2s, ids, place))
    bounds = np.searchsorted(place[order], np.arange(back + 1))
    return [(to, *(pack(x[order[bounds[to] : bounds[to + 1]]].astype(np.int64)) for x in (ids, k2s, starts, ends))) for to in np.flatnonzero(np.diff(bounds)).tolist()]


def _grouped(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value and id; for each element in that order the number of its group; the groups' first elements."""
    order = np.lexsort((ids, values))
    v = values[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def split_known(shape: Shape, hashes: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal runs as one: (order, group of each in order, first of each group, group weight, whether an occurrence in
    order is decided, since all its windows come again)."""
    order, group, first = _grouped(hashes, ids)
    weight = np.bincount(group, weights[order], len(first)).astype(np.int64)
    if shape.anywhere:
        return order, group, first, weight, weight[group] > 1
    return order, group, first, weight, ids[order] > ids[order][first][group]


def candidates(rows: DataFrame, shape: Shape) -> DataFrame:
    """Rows (id, k2, text, keys) to packed runs, dealt by the minimiser; decided runs come as spans of their row."""
    back = partitions(rows.sparkSession)
    n = 4 * back

    def take(batch: pa.RecordBatch):
        e = Elements.of(batch.column("text"), shape)
        begin, end = e.runs()
        keys = batch.column("keys")
        counts = np.diff(keys.offsets.to_numpy()) if len(keys) else np.zeros(0, np.int64)
        pair = lambda d, k: mix(k.astype(np.uint64) ^ mix(d.astype(np.uint64) + np.uint64(1)))
        own = pair(np.repeat(np.arange(len(counts)), counts), keys.values.to_numpy()[keys.offsets[0].as_py() : keys.offsets[-1].as_py()]) if len(keys) else np.zeros(0, np.uint64)
        hit = np.isin(pair(e.doc[begin], e.least[begin] >> SHIFT), own)
        begin, end = begin[hit], end[hit] - 1 + shape.n
        hashes = spans_hash(prefix(e.values), begin, end)
        least, doc = e.least[begin], e.doc[begin]
        lo, hi = (e.starts[begin], e.ends[end - 1]) if shape.words else (begin, end)
        body = e.data[ragged(lo, hi - lo)]
        return hashes, least, batch.column("id").to_numpy()[doc], batch.column("k2").to_numpy()[doc].astype(np.int64), begin - e.begin[doc], end - begin, hi - lo, body

    def flush(held) -> Iterator[pa.RecordBatch]:
        hashes, least, ids, k2s, begins, lengths, sizes, body = (np.concatenate(x) for x in zip(*held, strict=True))
        order, group, first, weight, decided = split_known(shape, hashes, ids, np.ones(len(ids)))
        ids, k2s, begins, lengths = ids[order], k2s[order], begins[order], lengths[order]
        known = _spans_back(ids[decided], k2s[decided], begins[decided], (begins + lengths)[decided], back)
        rows = [(to % n, 1, to, *[None] * 4, *spans) for to, *spans in known]
        lead = order[first]
        bucket = bucket_of(mix(least[lead]) >> SHIFT, n)
        by = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[by], np.arange(n + 1))
        place = np.cumsum(sizes) - sizes
        open_, open_group = np.flatnonzero(~decided), group[~decided]  # occurrences that others may decide, by group
        for b in range(n):
            g = np.sort(by[bounds[b] : bounds[b + 1]])
            if not len(g):
                continue
            text = body[ragged(place[lead[g]], sizes[lead[g]])].tobytes()
            lo, hi = np.searchsorted(open_group, g), np.searchsorted(open_group, g, "right")
            o = open_[ragged(lo, hi - lo)]
            number = np.repeat(np.arange(len(g)), hi - lo)
            rows.append((b, 0, None, zstandard.ZstdCompressor(level=3).compress(text), pack(sizes[lead[g]]), pack(weight[g]), pack(number), pack(ids[o]), pack(k2s[o]), pack(begins[o]), None))
        columns = list(zip(*rows, strict=True)) or [[]] * len(_RUN_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES, strict=True)], _RUN_NAMES)

    return rows.mapInArrow(lambda it: _gathered(it, flush, take), RUNS)


Decide = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def settle(runs: DataFrame, shape: Shape, decide: Decide) -> DataFrame:
    """(id, k2, spans): `decide(values, at, owner, weight)` says of each element of the distinct runs of a task whether
    the window that starts there comes again; spans count elements."""
    places = partitions(runs.sparkSession)

    def meet(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.equal(table["kind"], 1)).select(_SPANS)
        sent = table.filter(pa.compute.equal(table["kind"], 0))
        if not sent.num_rows:
            return own
        bodies = [zstandard.ZstdDecompressor().decompress(x) for x in sent["body"].to_pylist()]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        parts = {c: [unpack(x) for x in sent[c].to_pylist()] for c in ("sizes", "weight", "number", "ids", "k2s", "begins")}
        shift = np.cumsum([0] + [len(x) for x in parts["sizes"]])
        sizes, weight, ids, k2s, begins = (np.concatenate(parts[c]) for c in ("sizes", "weight", "ids", "k2s", "begins"))
        number = np.concatenate([x + s for x, s in zip(parts["number"], shift, strict=False)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        values = byte_values(data)
        if shape.words:
            starts, ends, at = word_spans(data, at)
            values = word_hashes(data, starts, ends)
        hashes = spans_hash(prefix(values), at[:-1], at[1:])
        # equal runs of several batches: occurrences and weights meet
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(back, weight, len(kinds)).astype(np.int64)
        least = np.full(len(kinds), LAST, np.int64)
        group = back[number]
        np.minimum.at(least, group, ids)
        lengths = np.diff(at)[first]
        decided = total[group] > 1 if shape.anywhere else ids > least[group]
        found = [(ids[decided], k2s[decided], begins[decided], begins[decided] + lengths[group[decided]])]
        text = ragged(at[first], lengths)
        again = decide(values[text] if shape.words else data[text], np.concatenate([[0], np.cumsum(lengths)]), least, total)
        # runs of repeated windows within a distinct run, for each occurrence still open
        marks = np.concatenate([[0], again.astype(np.int8), [0]])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        edge = np.diff(marks)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(bounds, lo, "right") - 1
        a, z = np.searchsorted(of, group[~decided]), np.searchsorted(of, group[~decided], "right")
        pick, occ = ragged(a, z - a), np.repeat(np.flatnonzero(~decided), z - a)
        base = bounds[of[pick]]
        found.append((ids[occ], k2s[occ], begins[occ] + lo[pick] - base, begins[occ] + hi[pick] - base + shape.n - 1))
        columns = list(zip(*_spans_back(*(np.concatenate(x) for x in zip(*found, strict=True)), places), strict=True)) or [[]] * len(_SPANS)
        release()
        return pa.concat_tables([own, pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, own.schema.types, strict=True)], schema=own.schema)])

    def gather(table: pa.Table) -> pa.Table:
        i, k, spans = spans_table(*(np.concatenate([unpack(x) for x in table[c].to_pylist()]) for c in _SPANS[1:]))
        return pa.table({"id": pa.array(i), "k2": pa.array(k.astype(np.int32)), "spans": spans})

    met = runs.groupBy("bucket").applyInArrow(meet, "to int, ids binary, k2s binary, begins binary, ends binary")
    return met.groupBy("to").applyInArrow(gather, "id long, k2 int, spans array<long>")


def spans_of(rows: DataFrame, shape: Shape, decide: Decide) -> DataFrame:
    """`rows` (from `flagged`) with the spans of their repeated windows; rows that are no first of their text have none."""
    carrier = F.coalesce(F.col("id") == F.col("first"), F.lit(True)) & (F.octet_length("text") >= (2 * shape.n - 1 if shape.words else shape.n))
    keys = repeated(rows.where(carrier), shape)
    dealt = rows.join(keys.withColumnRenamed("id", "key_id"), F.col("id") == F.col("key_id"), "left")
    runs = candidates(dealt.where(F.col("keys").isNotNull() & carrier).select("id", "k2", "text", "keys"), shape)
    spans = settle(runs, shape, decide).select(F.col("id").alias("span_id"), F.col("k2").alias("span_k2"), "spans")
    return rows.join(spans, (F.col("id") == F.col("span_id")) & (F.col("k2") == F.col("span_k2")), "left").drop("span_id", "span_k2")


def covered(n: int, spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of what the spans (start, end, start, end, ...) cover."""
    if spans is None or not len(spans):
        return []
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
