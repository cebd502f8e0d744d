"""Benchmark decontamination by latent semantic retrieval.

1. Term counts over all documents give inverse frequencies.
2. A randomised singular value decomposition of TF-IDF rows (the benchmark items, and all passages of all documents, which
   weigh `CORPUS` together) finds the latent directions; the products with the row matrix run as Spark tasks.  The
   passages enter by a Nystrom approximation of their second moment, for which one pass over the documents is enough.
3. Every passage of every document, two blocks of `BLOCK` words, one block apart, gets its cosine with each item in the
   latent space, over the passage's whole norm; those that reach the threshold are candidates.  A term's row times an
   item's row is the same for every passage, so it is taken once; products below `FAINT` are left out, and the threshold
   is lowered by as much as they could add.  A passage is skipped where its terms' largest products cannot reach it.
4. No cosine reaches every stretch that step 5 counts: replaced words may be the heavy ones, and an item may be far
   shorter or longer than a passage.  So stretches that share enough of an item's rarest words are candidates too
   (`shared`); each stretch that can count is among these.
5. A candidate counts if the longest common subsequence with a stretch of a quarter more words than the item holds most
   of the item; a weaker one, a paraphrase, if it also holds the item's answer, its last third.  Stretches begin at each
   eighth of the item's length.

Items have one latent space for each `ITEMS` of them, and `SHARED` items share a pass over the documents that fits their
spaces.  `PASS` items at a time come to the driver; each such block is one more pass over the documents, whose slices are
searched in one space after the other.  Words of no item of the space count in the norms of passages only: their products
with items that the directions span are zero.

Defined results: null and wordless texts have no passages and are clean; null or wordless items match nothing; an item
of fewer than `SHORT` words counts only word for word; of items that match equally the one of the least id is named;
repeated rows and rows with a null id are judged each; a text of any length is searched whole; empty tables give empty
results or clean documents; other columns pass through `drop` untouched and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import by_slice, byte_values, bytes_hash, flat, ragged, release, slices, small_batches, stage, word_spans

SLICE = 2 << 20
BLOCK = 16
#: Items of one latent space, and latent directions.  The directions must span the items, with room for the passages': an
#: item outside them reaches no threshold.
ITEMS = 128
RANK = 256
#: What all passages weigh together where an item weighs 1, and the items whose spaces share their second moment.
CORPUS = 16.0
SHARED = 8 * ITEMS
#: Terms whose sums travel in one row, and the most frequent ones, whose products are taken densely.
RANGE = 16
DENSE = 256
#: Items of one pass over the documents.
PASS = 64 * ITEMS
#: Products of a term and an item that are left out, terms whose products are taken densely, and blocks of words that are
#: scored at a time.
FAINT = 1e-3
OFTEN = 64
BLOCKS = 2048
COSINE = 0.35
EXACT, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
SHORT = 8
#: Word hits that the shared-word filter holds at a time.
HITS = 500_000
#: Candidates whose words are counted at a time.
STRETCHES = 1 << 15
#: Terms are counted by so many leading bits of their hash.
BITS = 18
#: Hashes are looked up by so many leading bits.
BUCKETS = 16
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LOWER = byte_values(_FOLD)
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, in lower case and without ASCII punctuation at their ends."""
    starts, ends, begin = word_spans(data, at)
    for edge, step in ((ends - 1, -1), (starts, 1)):  # a word of punctuation only stays as it is
        moved = edge.copy()
        live = np.flatnonzero(_MARK[data[edge]])
        while len(live):
            moved[live] += step
            inside = live[(moved[live] >= starts[live]) & (moved[live] < ends[live])]
            moved[np.setdiff1d(live, inside, assume_unique=True)] = -1
            live = inside[_MARK[data[moved[inside]]]]
        kept = moved >= 0
        if step < 0:
            ends = np.where(kept, moved + 1, ends)
        else:
            starts = np.where(kept, moved, starts)
    return bytes_hash(data, starts, ends, _LOWER), begin


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are among the sorted keys, and where there; by buckets of their leading bits."""
    held = np.bincount((keys >> _U(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
    first, held = (np.cumsum(held) - held).astype(np.int32), held.astype(np.int32)
    bucket = (h >> _U(64 - BUCKETS)).astype(np.int32)
    some = np.flatnonzero((held > 0)[bucket])
    row, left, want = first[bucket[some]], held[bucket[some]], h[some]
    hit = keys[row] == want
    for k in range(1, int(held.max())):
        more = np.flatnonzero((left > k) & ~hit)
        row[more] += 1
        hit[more] = keys[row[more]] == want[more]
    hit = np.flatnonzero(hit)
    return some[hit], row[hit]


def term_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each leading part of the hashes occurs in all documents: 2**BITS counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, _ = terms(*flat(batch.column("text")))
                total += np.bincount((h >> _U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        held = np.flatnonzero(total)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    """No term is without weight: one frequent through copies may be all that an item has."""
    return np.log((counts.sum() + 2) / (counts + 1)).astype(np.float32)


@dataclass(frozen=True)
class Sought:
    """Sorted word hashes, the items that seek each (from `at`), and how many hits an item needs in how many words."""

    keys: np.ndarray
    at: np.ndarray
    item: np.ndarray
    need: np.ndarray
    width: np.ndarray


def least_common(n: int) -> int:
    """How many words an item of n words has in common with any stretch that counts."""
    return n if n < SHORT else next(c for c in range(n // 2, n + 1) if c / n >= PARAPHRASE)


def stretch_width(n: int) -> int:
    return n if n < SHORT else n + n // 4


def sought(items: list[np.ndarray], counts: np.ndarray) -> Sought:
    """The rarest words of each item.  A stretch that counts has m of the item's n words; of these at most n - p are not
    among the p rarest, so m - (n - p) hits are."""
    keys, owner, need = [], [], []
    for k, h in enumerate(items):
        n = len(h)
        m = least_common(n)
        hits = m if n < SHORT else max(1, m // 2)
        rare = np.argsort(counts[(h >> _U(64 - BITS)).astype(np.int64)], kind="stable")[: n - m + hits]
        own = np.unique(h[rare])
        keys.append(own)
        owner.append(np.full(len(own), k))
        need.append(hits)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((owner, keys))
    found, at = np.unique(keys[order], return_index=True)
    return Sought(found, np.append(at, len(keys)), owner[order], np.array(need), np.array([stretch_width(len(h)) for h in items]))


@dataclass(frozen=True)
class Space:
    """Sorted hashes of the terms that score, the largest product of each with an item, its items and products (from
    `at`), the items' ids, and their words, whole and as the shared-word filter seeks them."""

    terms: np.ndarray
    most: np.ndarray
    at: np.ndarray
    item: np.ndarray
    product: np.ndarray
    ids: list
    words: list[list[int]]
    sought: Sought


def _sums(z: np.ndarray) -> pa.RecordBatch:
    """A task's share of a matrix, by ranges of its rows."""
    z = z.astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(-(-len(z) // RANGE))), pa.array([z[a : a + RANGE].tobytes() for a in range(0, len(z), RANGE)])], ["range", "z"])


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The matrix whose shares the rows hold; none if there are no rows."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(table["z"].to_pylist()))
        return pa.table({"range": table["range"].slice(0, 1), "z": pa.array([total.astype(np.float32).tobytes()])})

    rows = parts.groupBy("range").applyInArrow(add, "range long, z binary").orderBy("range").collect()
    return np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r.z, np.float32) for r in rows)]).reshape(-1, width)


def decompose(spark: SparkSession, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, rank: int, rounds: int = 2, parts: int = 8) -> np.ndarray:
    """Orthonormal columns that span the leading right singular vectors of the sparse rows (term numbers, values).

    Randomised subspace iteration: Z = A'(A V) from a random V, then orthonormal again.  Tasks hold a part of the rows
    and return their share of Z by ranges of terms, which are summed by range.
    """
    width = min(rank, n_terms)
    v = np.linalg.qr(np.random.default_rng(7).standard_normal((n_terms, width)))[0].astype(np.float32)
    columns = [pa.array(np.arange(len(rows), dtype=np.int32) % parts), pa.array([t.astype(np.int64).tobytes() for t, _ in rows], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary())]
    table = spark.createDataFrame(pa.table(columns, ["part", "terms", "values"])).repartition(parts, "part")  # rows of Python objects would pass through workers of another daemon, which stay
    for _ in range(rounds):

        def multiply(batches: Iterator[pa.RecordBatch], v=v) -> Iterator[pa.RecordBatch]:
            z = None
            for batch in batches:
                z = np.zeros_like(v) if z is None else z
                for t, x in zip(batch.column("terms").to_pylist(), batch.column("values").to_pylist(), strict=True):
                    t, x = np.frombuffer(t, np.int64), np.frombuffer(x, np.float32)
                    z[t] += np.outer(x, x @ v[t])
            if z is not None:  # parts without rows send nothing
                yield _sums(z)

        v = np.linalg.qr(_summed(table.mapInArrow(multiply, "range long, z binary"), width).astype(np.float64))[0].astype(np.float32)
    return v


def _add(out: np.ndarray, to: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """out[to[k]] += rows[of[k]] for all k, those that are the n-th of their `to` at a time."""
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else to
    turn = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    order, a = np.argsort(turn, kind="stable"), 0
    for n in np.bincount(turn):
        some = order[a : a + n]
        out[to[some]] += np.take(rows, of[some], axis=0)
        a += n


def moment(h: np.ndarray, begin: np.ndarray, idf: np.ndarray, known: np.ndarray, v: np.ndarray, z: np.ndarray) -> int:
    """Adds to z the sum of x x'v over all passages' unit rows x, but for the weights of z's own terms; v's rows have
    theirs.  Returns how many passages there are."""
    block, owner, more = passages_of(begin)
    if not len(block):
        return 0
    x = idf[(h >> _U(64 - BITS)).astype(np.int64)].astype(np.float64)
    norm = np.bincount(block, x * x, len(owner))
    norm = norm + np.append(norm[1:], 0) * more
    starts = more | np.append(True, owner[1:] != owner[:-1])
    weight = np.divide(starts, norm, out=np.zeros(len(norm)), where=norm > 0).astype(np.float32)
    near, row = find(known, h)
    own, z_rare = block[near], np.zeros_like(v)
    often = np.argsort(idf[(known >> _U(64 - BITS)).astype(np.int64)], kind="stable")[:DENSE]
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    column, v_often, z_often = column[row], v[often], np.zeros((len(often), v.shape[1]))
    for a in range(0, len(owner), BLOCKS):
        n = min(a + BLOCKS, len(owner)) - a
        lo, hi = np.searchsorted(own, [a, a + n + 1])  # the last passage's second block too
        if lo == hi:
            continue
        at, some, col = own[lo:hi] - a, row[lo:hi], column[lo:hi]
        dense, rare = col >= 0, np.flatnonzero(col < 0)
        times = np.bincount(at[dense] * len(often) + col[dense], minlength=(n + 1) * len(often)).reshape(n + 1, -1).astype(np.float32)
        y = times @ v_often
        _add(y, at[rare], v, some[rare])
        pair = more[a : a + n, None]
        passage = (y[:-1] + y[1:] * pair) * weight[a : a + n, None]
        y[:-1], y[-1] = passage, 0
        y[1:] += passage * pair
        z_often += times.T @ y
        _add(z_rare, some[rare], y, at[rare])
    z[:-1] += z_rare
    z[often] += z_often
    return int(starts.sum())


def directions(docs: DataFrame, text_col: str, known: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows (terms, values) whose second moment is that of all passages of all documents in the `known` terms, as far as
    `RANK` directions hold it, at a weight of `CORPUS`.

    Nystrom approximation of the mean C of x x' over unit rows x: with Y = C V for a random V, Y (V'Y)^-1 Y'.
    """
    width, own = min(RANK, len(known)), idf[(known >> _U(64 - BITS)).astype(np.int64)].astype(np.float64)[:, None]
    v = np.linalg.qr(np.random.default_rng(11).standard_normal((len(known), width)))[0]
    scaled = (v * own).astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros((len(known) + 1, width)), 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                n += moment(*terms(*flat(batch.column("text"))), idf, known, scaled, z)
        z[-1] = n
        release()
        if n:
            yield _sums(z)

    z = _summed(docs.select(F.col(text_col).alias("text")).mapInArrow(multiply, "range long, z binary"), width).astype(np.float64)
    if not len(z):
        return []
    y = z[:-1] * own / z[-1, 0]
    core, turn = np.linalg.eigh((v.T @ y + y.T @ v) / 2)
    kept = core > 1e-6 * core.max()  # below, they are sums' rounding
    rows = np.sqrt(CORPUS) * (y @ (turn[:, kept] / np.sqrt(core[kept])))
    return [(known, r) for r in rows.T]


def fit(spark: SparkSession, items: list[tuple], corpus: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, counts: np.ndarray) -> Space:
    """`items`: (id, hashes of its words); `corpus`: rows (terms, values), of the items' terms among others."""
    known = np.unique(np.concatenate([h for _, h in items]))

    def vector(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = idf[(h >> _U(64 - BITS)).astype(np.int64)]
        t, back = np.unique(np.searchsorted(known, h), return_inverse=True)
        return t, (np.bincount(back, x) / max(1e-9, float(np.sqrt((x.astype(float) ** 2).sum())))).astype(np.float32)

    own = [vector(h) for _, h in items]
    others = [(np.arange(len(known)), x[np.searchsorted(t, known)]) for t, x in corpus]
    v = decompose(spark, own + others, len(known), RANK)
    product = v @ np.stack([x @ v[t] for t, x in own]).T
    term, item = np.nonzero(np.abs(product) >= FAINT)
    scoring, first = np.unique(term, return_index=True)
    value = product[term, item].astype(np.float64)
    most = np.maximum.reduceat(value, first) if len(first) else value
    return Space(known[scoring], np.maximum(most, 0), np.append(first, len(term)), item, value, [i for i, _ in items], [h.tolist() for _, h in items], sought([h for _, h in items], counts))


def common(words: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, a word of the stretch at a time on n bits."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def counts_as(share: float, answer: float) -> bool:
    return share >= EXACT or share >= PARAPHRASE and answer >= ANSWER


def judge(text: np.ndarray, item: list[int], lo: int, hi: int) -> tuple[bool, float, float]:
    """Whether a stretch of the text that begins at lo .. hi counts, and the best share of the item and of its answer."""
    n, width = len(item), stretch_width(len(item))
    lo, hi = max(0, lo), min(hi, max(0, len(text) - n))
    near = text[lo : hi + width].tolist()
    if n < SHORT:
        return (True, 1.0, 1.0) if any(near[k : k + n] == item for k in range(hi - lo + 1)) else (False, 0.0, 0.0)
    masks, tail = _masks(item), item[n - -(-n // 3) :]
    ends, step, best = _masks(tail), max(1, n // 8), (False, 0.0, 0.0)
    for k in range(-(-lo // step) * step, hi + 1, step):
        stretch = near[k - lo : k - lo + width]
        share = common(stretch, masks, n) / n
        if share >= min(PARAPHRASE, best[1]):
            answer = common(stretch, ends, len(tail)) / len(tail)
            best = max(best, (counts_as(share, answer), share, answer))
    return best


def passages_of(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word's block; for each block its document and whether the next one is in it too."""
    n = np.diff(begin)
    blocks = -(-n // BLOCK)
    base = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(n)), n)
    block = base[doc] + (np.arange(len(doc)) - begin[:-1][doc]) // BLOCK
    owner = np.repeat(np.arange(len(n)), blocks)
    return block, owner, np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)


@dataclass(frozen=True)
class Known:
    """The words of a slice that are words of items: sorted hashes of all items' words, where the slice holds some, and
    which."""

    words: np.ndarray
    spot: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, h: np.ndarray) -> Known:
        return cls(words, *find(words, h))

    def among(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `find` of these keys, all of which are words of items."""
        place = np.full(len(self.words), -1, np.int32)
        place[np.searchsorted(self.words, keys)] = np.arange(len(keys))
        row = place[self.number]
        own = np.flatnonzero(row >= 0)
        return self.spot[own], row[own]


@dataclass(frozen=True)
class Passages:
    """`passages_of` a slice, its words' weights and the squared norms of its blocks."""

    block: np.ndarray
    owner: np.ndarray
    more: np.ndarray
    x: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, begin: np.ndarray, idf: np.ndarray) -> Passages:
        block, owner, more = passages_of(begin)
        x = idf[(h >> _U(64 - BITS)).astype(np.int64)].astype(np.float64)
        return cls(block, owner, more, x, np.bincount(block, x * x, len(owner)))


def candidates(h: np.ndarray, begin: np.ndarray, idf: np.ndarray, space: Space, cosine: float, known: Known | None = None, passages: Passages | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first word within it, item) of the passages whose cosine reaches the threshold, some at a time."""
    passages = passages or Passages.of(h, begin, idf)
    block, owner, more, x = passages.block, passages.owner, passages.more, passages.x
    if not len(block) or not len(space.terms):
        return
    near, row = known.among(space.terms) if known else find(space.terms, h)
    two = lambda v: v + np.append(v[1:], 0) * more
    reach = (cosine - FAINT * np.sqrt(2 * BLOCK)) * np.sqrt(two(passages.square))
    # a passage of one block only stands for itself where its document has no other, or it is covered by the one before
    lone = more | np.append(True, owner[1:] != owner[:-1])
    able = lone & (two(np.bincount(block[near], x[near] * space.most[row], len(owner))) >= reach) & (reach > 0)
    wanted = able | np.append(False, (able & more)[:-1])
    use = wanted[block[near]]
    near, row = near[use], row[use]
    own, n_items = block[near], len(space.ids)
    width = np.diff(space.at)
    # the terms with the most products are taken densely
    often = np.argsort(-width * np.bincount(row, minlength=len(width)), kind="stable")[:OFTEN]
    column, dense = np.full(len(width), -1, np.int32), np.zeros((len(often), n_items))
    column[often] = np.arange(len(often))
    entry = ragged(space.at[often], width[often])
    dense[np.repeat(np.arange(len(often)), width[often]), space.item[entry]] = space.product[entry]
    column, weight, reach = column[row], x[near], np.where(able, reach, np.inf)
    for a in range(0, len(owner), BLOCKS):
        z = min(a + BLOCKS, len(owner))
        if not able[a:z].any():
            continue
        lo, hi = np.searchsorted(own, [a, min(z + 1, len(owner))])
        col, at, some, by = column[lo:hi], own[lo:hi] - a, row[lo:hi], weight[lo:hi]
        full, thin = np.flatnonzero(col >= 0), np.flatnonzero(col < 0)
        score = np.bincount(at[full] * len(often) + col[full], by[full], (z - a + 1) * len(often)).reshape(-1, len(often)) @ dense
        at, some, by = at[thin], some[thin], by[thin]
        each = width[some]
        entry = ragged(space.at[some], each)
        score += np.bincount(np.repeat(at * n_items, each) + space.item[entry], np.repeat(by, each) * space.product[entry], (z - a + 1) * n_items).reshape(-1, n_items)
        score = score[:-1] + score[1:] * more[a:z, None]
        p, item = np.divmod(np.flatnonzero(score >= reach[a:z, None]), n_items)
        p = p + a
        yield owner[p], (p - np.searchsorted(owner, owner[p])) * BLOCK, item


def shared(h: np.ndarray, begin: np.ndarray, sought: Sought, known: Known | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first and last word at which a stretch may begin, item): stretches with as many hits as the item needs."""
    spot, row = known.among(sought.keys) if known else find(sought.keys, h)
    load = np.bincount(sought.item, np.bincount(row, minlength=len(sought.keys)).repeat(np.diff(sought.at)), len(sought.need))
    turn = (np.cumsum(load) // HITS).astype(np.int64)  # some items at a time
    for t in np.unique(turn[load >= sought.need]):
        wanted = np.flatnonzero(turn[sought.item] == t)
        edges = np.searchsorted(wanted, sought.at)
        each = np.diff(edges)[row]
        item = sought.item[wanted[ragged(edges[row], each)]]
        at = np.repeat(spot, each)
        order = np.argsort(item.astype(np.uint16) if len(sought.need) <= 1 << 16 else item, kind="stable")  # so by radix
        item, at = item[order], at[order]
        last = np.arange(len(at)) + sought.need[item] - 1
        held = np.flatnonzero(last < len(at))
        last = last[held]
        held, last = (x[(item[last] == item[held]) & (at[last] - at[held] < sought.width[item[held]])] for x in (held, last))
        doc = np.searchsorted(begin, at[held], "right") - 1
        inside = at[last] < begin[doc + 1]
        held, last, doc = held[inside], last[inside], doc[inside]
        if not len(held):
            continue
        item = item[held]
        lo, hi = np.maximum(0, at[last] - sought.width[item] + 1 - begin[doc]), at[held] - begin[doc]
        first = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)))
        yield doc[first], lo[first], hi[np.append(first[1:], len(held)) - 1], item[first]


#: What the judge says of a document: the column that `_judged` adds.
VERDICT = T.StructType([T.StructField(n, t) for n, t in (("n_passages", T.LongType()), ("n_candidates", T.LongType()), ("item_id", T.LongType()), ("share", T.DoubleType()), ("answer_share", T.DoubleType()), ("contaminated", T.BooleanType()))])


def item_words(spaces: list[Space]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, _U), *(np.array(w, _U) for s in spaces for w in s.words)]))


def _gathered(every: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in fewer, larger parts of about `most`."""
    held: list[tuple[np.ndarray, ...]] = []
    for some in every:
        held.append(some)
        if sum(len(s[0]) for s in held) >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def holding(begin: np.ndarray, space: Space, known: Known, before: np.ndarray, every: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Candidates, some at a time, and which of them hold, from the first word at which a stretch may begin to the end of
    the last stretch, as many of the item's words as any stretch that counts.  A word of the slice counts unless the same
    came `before` it within these."""
    size = np.array([len(w) for w in space.words])
    least, width = np.array([least_common(n) for n in size.tolist()]), np.array([stretch_width(n) for n in size.tolist()])
    own, place = np.unique(np.concatenate([np.array(w, _U) for w in space.words]), return_inverse=True)
    times = np.bincount(np.repeat(np.arange(len(size)), size) * len(own) + place, minlength=len(size) * len(own)).astype(np.int32)
    local = np.full(len(known.words), -1, np.int32)
    local[np.searchsorted(known.words, own)] = np.arange(len(own))
    row = local[known.number]
    kept = np.flatnonzero(row >= 0)
    row, spot, before = row[kept], known.spot[kept], before[kept]
    for some in _gathered(every, STRETCHES):
        doc, first, last, item = some
        start = begin[doc] + np.maximum(0, first)
        lo, hi = np.searchsorted(spot, start), np.searchsorted(spot, np.minimum(begin[doc] + last + width[item], begin[doc + 1]))
        held, some_held = np.flatnonzero(hi > lo), np.zeros(len(doc), bool)
        n = (hi - lo)[held]
        for part in np.split(held, np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1):
            if len(part):
                n = (hi - lo)[part]
                at = ragged(lo[part], n)
                found = times[np.repeat(item[part] * len(own), n) + row[at]] * (before[at] < np.repeat(start[part], n))
                some_held[part] = np.add.reduceat(found, np.cumsum(n) - n) >= least[item[part]]
        yield some, some_held


def _look(h: np.ndarray, begin: np.ndarray, idf: np.ndarray, spaces: list[Space], cosine: float, words: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, tuple[bool, float, float, int]]]:
    """How many candidates each document has, and its best one: (counts, share, answer share, item id negated)."""
    best: dict[int, tuple[bool, float, float, int]] = {}
    met = np.zeros(len(begin) - 1, np.int64)
    known, passages = Known.of(item_words(spaces) if words is None else words, h), Passages.of(h, begin, idf)
    order = np.argsort(known.number.astype(np.uint16) if len(known.words) <= 1 << 16 else known.number, kind="stable")
    number, before = known.number[order], np.full(len(order), -1)
    before[order[1:]] = np.where(number[1:] == number[:-1], known.spot[order[:-1]], -1)
    for space in spaces:
        size = np.array([len(w) for w in space.words])
        latent = ((d, at - size[k] - size[k] // 4, at + 2 * BLOCK + size[k] // 4, k) for d, at, k in candidates(h, begin, idf, space, cosine, known, passages))
        for some, held in holding(begin, space, known, before, chain(shared(h, begin, space.sought, known), latent)):
            met += np.bincount(some[0], minlength=len(met))
            for d, first, last, item in zip(*(c[held].tolist() for c in some), strict=True):  # others hold no subsequence long enough
                words, own = space.words[item], -space.ids[item]
                if d in best and best[d][1] == 1.0 and best[d][3] >= own:
                    continue
                best[d] = max(best.get(d, (False, 0.0, 0.0, 0)), (*judge(h[begin[d] : begin[d + 1]], words, first, last), own))
    return met, best


def _judged(docs: DataFrame, text_col: str, name: str, idf: np.ndarray, spaces: list[Space], cosine: float) -> DataFrame:
    """`docs` with a struct column `name` of VERDICT."""
    words = item_words(spaces)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, begin = terms(*flat(batch.column(text_col)))
        n = np.diff(begin)
        met, best = _look(h, begin, idf, spaces, cosine, words)
        found = [best.get(d, (False, 0.0, 0.0, 0)) for d in range(len(n))]
        bad, share, answer, item = zip(*found, strict=True) if found else ((), (), (), ())
        columns = [pa.array(np.maximum(-(-n // BLOCK) - 1, np.minimum(n, 1))), pa.array(met), pa.array([-i if b else None for b, i in zip(bad, item, strict=True)], pa.int64()), pa.array(share, pa.float64()), pa.array(answer, pa.float64()), pa.array(bad, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, VERDICT.names)], [*batch.schema.names, name])

    return docs.mapInArrow(lambda it: by_slice(it, text_col, SLICE, look), T.StructType([*docs.schema.fields, T.StructField(name, VERDICT)]))


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator[tuple[np.ndarray, list[Space]]]:
    """(inverse frequencies, spaces) of each pass over the documents; one without spaces if there are no items."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = term_counts(docs, text_col)
    idf = inverse_frequency(counts)
    some = False
    for items in _item_blocks(benchmark, item_col, item_text_col, PASS):
        some, spaces = True, []
        for a in range(0, len(items), SHARED):
            group = items[a : a + SHARED]
            corpus = directions(docs, text_col, np.unique(np.concatenate([h for _, h in group])), idf)
            spaces += [fit(spark, group[k : k + ITEMS], corpus, idf, counts) for k in range(0, len(group), ITEMS)]
        yield idf, spaces
    if not some:
        yield idf, []


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """(id, n_passages, n_candidates, item_id, share, answer_share, contaminated) of each document: its best item."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found: list[DataFrame] = []
    for idf, spaces in _passes(rows, benchmark, "text", item_col, item_text_col):
        if found:
            found[-1] = stage(found[-1], "judged")
        keyed = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
        found.append(_judged(keyed, "text", "found", idf, spaces, cosine).select("id", "k1", "k2", "found"))
    if len(found) == 1:
        return found[0].select("id", "found.*")
    # rows of one id and text have one verdict; each pass has judged each of them
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.max(F.struct("found.contaminated", "found.share", "found.answer_share", (-F.col("found.item_id")).alias("own")))
    every = every.groupBy("id", "k1", "k2").agg(best.alias("b"), F.max("found.n_passages").alias("n_passages"), F.sum("found.n_candidates").alias("all"), F.count("*").alias("n"))
    copies = F.explode(F.expr(f"sequence(1, cast(n / {len(found)} AS int))"))
    every = every.withColumn("copy", copies)
    return every.select("id", "n_passages", (F.col("all") / (F.col("n") / len(found))).cast("long").alias("n_candidates"), (-F.col("b.own")).alias("item_id"), F.col("b.share").alias("share"), F.col("b.answer_share").alias("answer_share"), F.col("b.contaminated").alias("contaminated"))


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = ITEMS) -> Iterator[list[tuple]]:
    """Items with words, `most` at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").orderBy("id", "text")
    held: list[tuple] = []
    for r in rows.toLocalIterator():
        h, _ = terms(*flat(pa.array([r.text])))
        if len(h):
            held.append((r.id, h))
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def drop(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """`docs` without the contaminated ones, whatever their ids."""
    left, name = None, "__found"
    while name in docs.columns:
        name += "_"
    for idf, spaces in _passes(docs, benchmark, text_col, item_col, item_text_col):
        rows = docs if left is None else stage(left, "clean")
        left = _judged(rows, text_col, name, idf, spaces, cosine).where(~F.col(name)["contaminated"]).drop(name)
    return left
