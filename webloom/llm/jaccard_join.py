"""N-gram Jaccard join by prefix trees, and the classes of documents that its links join.

A document is the set of its 5-word shingles (64-bit hashes).  Two sets link when 100 * common >= 80 * union.

1. Equal sets become one node, named by the least id.
2. A set that links with another has all but `slack` of its shingles in it, so it needs slack + 1 repeated ones among
   its 2 * slack + 1 lowest (a few small sets send more, see `low_count`).  Only nodes that have them go on (repeats:
   packed ranges of keys, no set is moved).
3. First links: of the nodes that share one of their `SIGNS` lowest shingles the one with the largest share of repeated
   shingles is a star's centre; the others are held against it.  Those that link make first classes.  Each node also
   joins the cluster of the centre that it is most like, linked or not; clusters only deal out the work of step 4.
4. All others: in the global order, from rare shingles to those of many nodes, two sets that link share one of their
   first slack + 1 shingles (the least common one has only shingles that the other lacks before it).  Where such a
   shingle joins a node with another class in some cluster, the node is held against that cluster's nodes, the smaller
   cluster's against the larger's, in tiles of `TILE` shingles a side.  So nodes of one class are not paired, a cluster
   is asked once by a node however many shingles or classes they share, and pairs are not formed as rows.
In steps 3 and 4 a task stores the globally ordered sets of one side in a prefix tree and walks it with the other side's
sets, all at once: members that share a prefix share its partial overlaps, and a subtree is left by the sets whose
overlap so far and remaining length cannot reach the threshold.  A tile returns a spanning forest of its links.

Defined results: null, empty and wordless texts have no shingles and are their own class; a null id links with nothing
and has a null class; rows that share an id are one document, which links by any of its texts; ties between centres go
to the least id; a text of any length is one set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import by_slice, byte_values, flat, mix, partitions, prefix, release, sized, small_batches, spans_hash, stage, windows_hash, word_spans
from webloom.llm.repeats import SHIFT, SLICE, repeated_keys

SIGNS = 4
#: A node joins the cluster of a centre with at least this Jaccard similarity, in percent.
ALIKE = 40
#: Shingles of one side of a tile.
TILE = 1 << 18
#: Elements of an edge that a walk takes at a time, and bytes of its table of queries.
STRIDE, TABLE = 48, 48 << 20
#: Text bytes that a batch gathers before it sends keys.
FLUSH = 12 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each document in a row, and where each document's begin (one more entry)."""
    starts, ends, words = word_spans(data, at)
    hashes = spans_hash(prefix(byte_values(_FOLD[data])), starts, ends)
    n = np.diff(words)
    doc = np.repeat(np.arange(len(n)), n)
    grams = windows_hash(hashes, size)
    whole = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < size))
    tokens = np.concatenate([grams[whole], spans_hash(prefix(hashes), words[short], words[short + 1])])
    owner = np.concatenate([doc[: len(grams)][whole], short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]) if len(tokens) else np.zeros(0, bool)
    tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(n) + 1))


def slack(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles a set of n may have that a set it links with lacks."""
    return n - -(-percent * n // 100)


def low_count(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its lowest shingles a set of n sends, so that each set it links with sees slack + 1 of its own again:
    2 * slack + 1, and at least what a larger set may need.  Of sets of m and n, the common shingle of place slack(m) has
    at most n - common others before it in the set of n; that sum is largest at m = n or at m = n * 100 / percent.
    For a percent over 50."""
    q = percent / 100
    most = np.floor((1 - q) * max(1 + 1 / (1 + q), 1 / q) * n + 1e-9).astype(np.int64)
    return np.maximum(2 * slack(n, percent), most) + 1


def _digests(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that stand for each set."""
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(seed)), dtype=np.uint64)])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common shingles by which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


class PrefixTree:
    """Sets as a tree whose edges are stretches of their elements, in one order for all: from those of most sets on.

    node: (depth where its edge begins, depth where it ends, a set that holds it, least and largest size below, children,
    sets that end here)
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat_sets = np.concatenate([*sets, np.zeros(0, np.uint64)])
        self.known, back, held = np.unique(flat_sets, return_inverse=True, return_counts=True)
        self.place = np.empty(len(self.known), np.int64)
        self.place[np.argsort(-held, kind="stable")] = np.arange(len(self.known))
        cuts = np.cumsum([len(x) for x in sets])[:-1]
        self.sets = [np.sort(x) for x in np.split(self.place[back], cuts)] if sets else []
        raw = [x.astype(">u4").tobytes() for x in self.sets]
        order = sorted(range(len(sets)), key=raw.__getitem__)
        self.root = [0, 0, order[0] if order else 0, 1 << 60, 0, [], []]
        path = [self.root]
        before = None
        for k in order:
            own = self.sets[k]
            common = 0 if before is None else self._common(before, own)
            last = None
            while path[-1][1] > common:
                last = path.pop()
            if path[-1][1] < common:  # split the edge of the node that was left
                upper = [last[0], common, last[2], last[3], last[4], [last], []]
                last[0] = common
                path[-1][5][-1] = upper
                path.append(upper)
            if common < len(own):
                leaf = [common, len(own), k, len(own), len(own), [], []]
                path[-1][5].append(leaf)
                path.append(leaf)
            path[-1][6].append(k)
            for node in path:
                node[3], node[4] = min(node[3], len(own)), max(node[4], len(own))
            before = own

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        return int(apart[0]) if len(apart) else n

    def _table(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which elements (by place) each query has, how many of its before each 64th place, and how many at all."""
        owner = np.repeat(np.arange(len(queries)), [len(x) for x in queries])
        found = np.concatenate(queries)
        spot = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        held = self.known[spot] == found
        table = np.zeros((len(self.known), len(queries)), np.uint8)
        table[self.place[spot[held]], owner[held]] = 1
        sums = np.add.reduceat(table, np.arange(0, len(table), 64), axis=0, dtype=np.int32)
        before = np.concatenate([np.zeros((1, len(queries)), np.int32), np.cumsum(sums, axis=0, dtype=np.int32)])
        return table, before, before[-1]

    def matches(self, queries: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, set, common elements) where 100 * common >= percent * union.  All queries walk the tree together."""
        out = [(np.zeros(0, np.int64),) * 3]
        step = max(16, TABLE // max(1, len(self.known)))
        for a in range(0, len(queries) if self.sets else 0, step):
            out += [(q + a, np.full(len(q), k), common) for q, k, common in self._walk(queries[a : a + step], percent)]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))

    def _walk(self, queries: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        table, before, inside = self._table(queries)
        sizes = np.array([len(x) for x in queries])
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while todo:
            (lo, hi, held, least, most, children, ends), live, overlap = todo.pop()
            while lo < hi and len(live):
                edge = self.sets[held][lo : min(lo + STRIDE, hi)]
                lo += len(edge)
                rows = table[edge] if len(live) == len(queries) else table[edge[:, None], live]
                overlap = overlap + rows.sum(axis=0, dtype=np.uint8)
                left = inside[live] - before[edge[-1] >> 6][live]  # the query's elements that may still come
                best = np.minimum(np.maximum(lo + left, least), most)  # the size that has most to gain
                able = overlap + np.minimum(best - lo, left) >= needed(sizes[live], best, percent)
                if not able.all():
                    live, overlap = live[able], overlap[able]
            if not len(live):
                continue
            for k in ends:
                own = overlap >= needed(sizes[live], len(self.sets[k]), percent)
                if own.any():
                    yield live[own], k, overlap[own]
            todo += [(child, live, overlap) for child in children]

    def links(self, x: np.ndarray, percent: int) -> list[int]:
        """The sets that link with x."""
        return self.matches([x], percent)[1].tolist()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the edges (a, b): each node and the least that it reaches."""
    known, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label = np.arange(len(known))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new[new]]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(known)))
    return known[own], known[label[own]]


LINKS = "a long, b long, alike double"


def _tiles(sides: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b, alike) of each tile (group, tile) of `sides` (group, tile, side, node, tokens).  With least < percent, all
    pairs of a query (side 1) and a member (side 0) that are so much alike; else a spanning forest of the links."""
    parts = 4 * partitions(sides.sparkSession)

    def one(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side, node = table["side"].to_numpy(), table["node"].to_numpy()
        column = table["tokens"].combine_chunks()
        values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        members, queries = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(members) or not len(queries):
            return node[:0], node[:0], np.zeros(0)
        sets = lambda at_: [values[at[i] : at[i + 1]] for i in at_]
        q, m, common = PrefixTree(sets(members)).matches(sets(queries), least)
        sizes = np.diff(at)
        alike = common / (sizes[queries[q]] + sizes[members[m]] - common)
        a, b = node[queries[q]], node[members[m]]
        if least < percent:
            return a, b, alike
        a, b = _forest(a, b)
        return a, b, np.ones(len(a))

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("tile", "ascending")])
        keys = np.stack([table["group"].to_numpy(), table["tile"].to_numpy().astype(np.int64)])
        cuts = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)), [table.num_rows]])
        found = [one(table.slice(lo, hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        a, b, alike = (np.concatenate(x) for x in zip(*found, strict=True))
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "alike": pa.array(alike, pa.float64())})

    dealt = sides.withColumn("part", F.pmod(F.hash("group", "tile"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(walk, LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of `edges` (a, b) reaches.

    Large and small stars in turn, until every node hangs on its label; each round is written to the shared folder.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = stage(small.where("a <> b").distinct(), "small")
        seen = now.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state and seen[0] == seen[1]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = seen


def _classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with a column `class`."""
    labels = components(edges)
    return nodes.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    twice = stage(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL").select("id"), "several-rows")
    if twice.isEmpty():
        return _classes_of(rows, size, percent).withColumnRenamed("n", "n_shingles")
    # each text of an id with several rows is a node of its own, and all of an id's nodes are one class
    several = twice.withColumn("several", F.lit(True))
    keyed = rows.join(sized(several, twice.count(), 16), "id", "left")
    keyed = keyed.select("id", F.when(F.col("several"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("key"), "text")
    texts = keyed.select(F.col("key").alias("id"), "text").dropDuplicates(["id", "text"])
    found = stage(_classes_of(texts.where("id IS NOT NULL"), size, percent).select(F.col("id").alias("key"), F.col("component_id").alias("label")), "texts")
    members = keyed.select("id", "key").where("id IS NOT NULL").distinct().join(found, "key")
    first = members.groupBy("id").agg(F.min("label").alias("b"))
    again = components(members.join(first, "id").select(F.col("label").alias("a"), "b"))
    members = stage(members.join(again.select(F.col("node").alias("label"), F.col("label").alias("joined")), "label", "left").select("id", F.coalesce("joined", "label").alias("label")).distinct(), "members")
    least = members.groupBy("label").agg(F.min("id").alias("component_id"))
    known = members.join(least, "label").select("id", "component_id")
    return _counted(rows, size).join(known, "id", "left").select("id", F.col("n").alias("n_shingles"), "component_id")


def _counted(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, d2): size and digests of each row's set."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, at = shingles(*flat(batch.column("text")), size)
        d1, d2 = _digests(tokens, at)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(d1), pa.array(d2)], ["id", "n", "d1", "d2"])

    return rows.mapInArrow(lambda it: by_slice(it, "text", SLICE, measure), "id long, n long, d1 long, d2 long")


def _classes_of(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, component_id) of rows (id, text) without repeated ids."""
    small_batches(rows.sparkSession)
    measured = stage(_counted(rows, size), "sets")
    full = measured.where("n > 0 AND id IS NOT NULL")
    groups = full.groupBy("n", "d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = stage(groups, "equal")
    named = full.join(sized(groups, groups.count(), 48), ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("first", "id").alias("node"))
    named = stage(named, "named")
    sets = _able_sets(rows, named, size, percent)
    edges, near = _stars(sets, percent)
    nodes = _clusters(sets, edges, near)
    more = _other_links(sets, nodes, percent)
    joined = nodes.select(F.col("node").alias("a"), F.col("class").alias("b"))
    labels = stage(components(joined.unionByName(more)), "classes")
    named = named.join(sized(labels, labels.count(), 24), "node", "left").select("id", "n", F.coalesce("label", "node").alias("component_id"))
    rest = measured.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return named.unionByName(rest)


def _able_sets(rows: DataFrame, named: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, repeated, tokens): sets that may link, and the share of their lowest shingles that come again."""
    later = stage(named.where("id > node").select("id"), "later")
    firsts = rows.where("id IS NOT NULL AND text <> ''").join(sized(later, later.count(), 16), "id", "left_anti")

    def lowest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        tokens, at = shingles(*flat(batch.column("text")), size)
        n = np.diff(at)
        rank = np.arange(len(tokens)) - np.repeat(at[:-1], n)
        low = rank < np.repeat(low_count(n, percent), n)
        return tokens[low] >> SHIFT, np.repeat(batch.column("id").to_numpy(), n)[low]

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, at = shingles(*flat(batch.column("text")), size)
        n = np.diff(at)
        repeated = batch.column("again").to_numpy() / np.maximum(1, np.minimum(n, low_count(n, percent)))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(repeated), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))], ["node", "n", "repeated", "tokens"])

    counts = repeated_keys(firsts, lowest, distinct_ids=True, counts=True, flush_bytes=FLUSH).select("id", F.col("n").alias("again"))
    some = F.expr(f"n - cast(ceil({percent} * n / 100.0) AS long)")
    able = stage(counts.join(named.where("id = node"), "id").where(F.col("again") > some).select("id", "again"), "able")
    sets = rows.join(sized(able, able.count(), 24), "id").select("id", "text", "again").mapInArrow(lambda it: by_slice(it, "text", SLICE, gather), "node long, n long, repeated double, tokens array<long>")
    return stage(sets.where("n > 0"), "able-sets")


def _dealt(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Tiles (group, tile, side, node, tokens) of `pairs` (group, node, side): each side's sets in as many blocks as
    their shingles need, each block of one side with each block of the other."""
    pairs = pairs.join(sets.select("node", "n"), "node")
    blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)) / TILE)).cast("int")
    width = pairs.groupBy("group").agg(blocks(0).alias("blocks"), blocks(1).alias("turns"))
    own = lambda of: F.pmod(F.hash("node", F.lit(of)), F.col(of))
    tiles = pairs.join(width, "group").withColumn(
        "tile",
        F.explode(F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: own("blocks") * F.col("turns") + t)).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b * F.col("turns") + own("turns")))),
    )
    return tiles.select("group", "tile", "side", "node").join(sets.select("node", "tokens"), "node")


def _stars(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the links between centres and others, and (node, centre, alike) of all that are alike."""
    signs = sets.select("node", "repeated", F.explode(F.slice("tokens", 1, SIGNS)).alias("token"))
    best = F.max(F.struct("repeated", (-F.col("node")).alias("minus")))
    centres = signs.groupBy("token").agg((-best["minus"]).alias("group"), F.count("*").alias("held")).where("held > 1").drop("held")
    stars = stage(signs.join(centres, "token").where("node <> group").select("group", "node").distinct(), "stars")
    pairs = stars.withColumn("side", F.lit(0)).unionByName(stars.select("group", F.col("group").alias("node")).distinct().withColumn("side", F.lit(1)))
    near = stage(_tiles(_dealt(pairs, sets), percent, min(ALIKE, percent - 1)), "alike")
    return near.where(f"100 * alike >= {percent} - 1e-9").select("a", "b"), near.select(F.col("b").alias("node"), F.col("a").alias("centre"), "alike")


def _clusters(sets: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    """(node, class, cluster): classes by the first links; clusters by the most alike centre, and by that one's."""
    best = F.max(F.struct("alike", (-F.col("centre")).alias("minus")))
    up = stage(near.groupBy("node").agg((-best["minus"]).alias("cluster")), "nearest")
    for _ in range(2):
        above = up.select(F.col("node").alias("cluster"), F.col("cluster").alias("above"))
        up = stage(up.join(above, "cluster", "left").select("node", F.coalesce("above", "cluster").alias("cluster")), "nearest")
    nodes = sets.select("node").join(components(edges), "node", "left").join(up, "node", "left")
    return stage(nodes.select("node", F.coalesce("label", "node").alias("class"), F.coalesce("cluster", "node").alias("cluster")), "nodes")


def _other_links(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the nodes of different first classes which link."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    lists = tokens.join(held, "token").groupBy("node").agg(F.collect_list(F.struct("held", "token")).alias("often"))
    # a set's shingles that no other has come first
    first = F.expr(f"slice(array_sort(often), 1, cast(greatest(0, n - ceil({percent} * n / 100.0) + 1 - (n - size(often))) AS int))")
    early = lists.join(sets.select("node", "n"), "node").join(nodes, "node").select("node", "class", "cluster", F.explode(first["token"]).alias("token"))
    early = stage(early, "early")
    mixed = early.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token")
    early = stage(early.join(mixed, "token"), "mixed")
    within = nodes.groupBy("cluster", "class").agg(F.count("*").alias("n"))
    weight = within.groupBy("cluster").agg(F.sum("n").alias("members"), F.max(F.struct("n", "class"))["class"].alias("main"))
    there = early.groupBy("token", "cluster").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).join(weight, "cluster")
    there = there.select("token", F.col("cluster").alias("group"), "lo", "hi", "members", "main")
    own = early.join(weight.select("cluster", F.col("members").alias("own_members")), "cluster")
    asks = own.join(there, "token").where((F.col("lo") != F.col("class")) | (F.col("hi") != F.col("class")))
    larger = (F.col("own_members") < F.col("members")) | (F.col("own_members") == F.col("members")) & (F.col("cluster") > F.col("group"))
    asks = asks.where(F.when(F.col("cluster") == F.col("group"), F.col("class") != F.col("main")).otherwise(larger))
    asks = stage(asks.select("group", "node").distinct(), "asks")
    members = early.select(F.col("cluster").alias("group"), "node").distinct().join(asks.select("group").distinct(), "group", "left_semi")
    pairs = members.withColumn("side", F.lit(0)).unionByName(asks.withColumn("side", F.lit(1)))
    return stage(_tiles(_dealt(stage(pairs, "pairs"), sets), percent, percent), "other-links").select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the documents that link, over any number of steps, with one of a smaller id."""
    found = classes(docs, id_col, text_col, **options)
    gone = stage(found.where("id <> component_id").select(F.col("id").alias("__gone")).distinct(), "gone")
    return docs.join(sized(gone, gone.count(), 16), F.col(id_col) == F.col("__gone"), "left_anti")
