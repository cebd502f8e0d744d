"""Sharding by fixed virtual slots.

Every record hashes by its id into one of a fixed number of virtual slots.  The bytes of each slot are summed, and a
versioned map says which shard holds which slot.  Growing or rebalancing edits the map: only records of slots that
changed hands move.  The map has one entry per slot, so its size is bounded by a parameter, whatever the corpus.

Defined results: a null text has no bytes and counts `overhead` only; a null id hashes like any other value; records
with the same id share a slot, each with a place of its own; equal loads go to the lower slot and shard; a text of any
length is one record; an empty table gives an empty result; columns other than id and text are ignored, whatever their
names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
#: Ranks within a slot are dealt to this many parts, so that one slot is never one task's work.
PARTS = 8


@dataclass(frozen=True)
class SlotMap:
    """Slot to shard, with the bytes and rows by which it was made."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    loads: tuple[int, ...] = field(default=())

    def shard_bytes(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.loads[slot]
        return out


def record(docs: DataFrame, id_col: str, text_col: str, n_slots: int, overhead: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int").alias("vslot"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
    )


def _part(size: Column, crc: Column) -> Column:
    return F.pmod(F.hash(size, crc), F.lit(PARTS)).cast("int")


def slot_loads(records: DataFrame) -> list[tuple[int, int, int, int]]:
    """(slot, part, bytes, rows) of the slots in use: at most n_slots * PARTS rows come to the driver."""
    rows = records.groupBy("vslot", _part(F.col("size"), F.col("crc")).alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r.vslot, r.part, r.bytes, r.rows) for r in rows)


def first_map(loads: list[int], n_shards: int) -> SlotMap:
    """Heaviest slot first, each to the lightest shard; then single moves and swaps while they shrink the spread."""
    heap, shard_of = [(0, s) for s in range(n_shards)], [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda s: (-loads[s], s)):
        held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (held + loads[slot], shard))
    return rebalance(SlotMap(0, n_shards, tuple(shard_of), tuple(loads)), loads, moves=200)


def rebalance(old: SlotMap, loads: list[int], moves: int = 64) -> SlotMap:
    """A next version: up to `moves` edits, each the move or swap between fullest and emptiest shard that evens them most."""
    shard_of, held = list(old.shard_of), [0] * old.n_shards
    for slot, shard in enumerate(shard_of):
        held[shard] += loads[slot]
    for _ in range(moves):
        high, low = max(range(old.n_shards), key=lambda s: (held[s], -s)), min(range(old.n_shards), key=lambda s: (held[s], s))
        gap = held[high] - held[low]
        mine, theirs = ([s for s in range(len(loads)) if shard_of[s] == x] for x in (high, low))
        pairs = sorted((loads[s], s) for s in theirs) or []
        best = min(((abs(gap - 2 * loads[s]), s, -1) for s in mine if loads[s]), default=(gap, -1, -1))
        j, values = 0, sorted((loads[s], s) for s in mine)
        for load, s in values:  # the partner whose load is nearest to load - gap / 2
            while j + 1 < len(pairs) and pairs[j + 1][0] <= load - gap / 2:
                j += 1
            for k in (j, j + 1):
                if k < len(pairs):
                    best = min(best, (abs(gap - 2 * (load - pairs[k][0])), s, pairs[k][1]))
        if best[0] >= gap:
            break
        _, out, back = best
        shard_of[out] = low
        held[high], held[low] = held[high] - loads[out], held[low] + loads[out]
        if back >= 0:
            shard_of[back] = high
            held[high], held[low] = held[high] + loads[back], held[low] - loads[back]
    return SlotMap(old.version + 1, old.n_shards, tuple(shard_of), tuple(loads))


def grow(old: SlotMap) -> SlotMap:
    """A next version with one more shard: the fullest shards give it slots until it holds its share; nothing else moves."""
    shard_of, held, new = list(old.shard_of), old.shard_bytes(), old.n_shards
    share, got = sum(held) / (new + 1), 0
    for slot in sorted(range(len(shard_of)), key=lambda s: (-old.loads[s], s)):
        load, giver = old.loads[slot], shard_of[slot]
        if load and got + load <= share and held[giver] - load >= share * 0.98:
            shard_of[slot], got = new, got + load
            held[giver] -= load
    return SlotMap(old.version + 1, new + 1, tuple(shard_of), old.loads)


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Each version is a folder of its own; readers take the newest whole one."""
    rows = [(slot, shard, load) for slot, (shard, load) in enumerate(zip(m.shard_of, m.loads, strict=True))]
    df = spark.createDataFrame(rows, "slot int, shard int, bytes long").withColumns({"n_shards": F.lit(m.n_shards), "n_slots": F.lit(len(rows))})
    df.coalesce(1).write.parquet(f"{path}/version={m.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The newest version, or the given one, of which all slots are there."""
    df = spark.read.option("basePath", path).parquet(path)
    whole = {r.version for r in df.groupBy("version", "n_slots").count().where("count = n_slots").select("version").collect()}
    version = max(whole, default=None) if version is None else version
    if version not in whole:
        raise ValueError(f"no whole slot map of version {version} in {path}")
    rows = df.where(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows), tuple(r.bytes for r in rows))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, n_slots: int = N_SLOTS, overhead: int = 8, use: SlotMap | None = None, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows (id, size, crc, vslot, shard, place) and the map that placed them; `use` keeps an earlier map.  With a `path`, the
    map is stored there and rows are placed by the stored version.

    `place` counts a shard's rows from 0 without gaps: rows rank within (slot, part), and the parts' row counts, which
    are a bounded table, say where each part begins.
    """
    records = record(docs, id_col, text_col, n_slots, overhead)
    parts = slot_loads(records)
    loads = [0] * n_slots
    for slot, _, size, _ in parts:
        loads[slot] += size
    m = use or first_map(loads, n_shards)
    if path is not None:
        save_map(docs.sparkSession, m, path)
        m = load_map(docs.sparkSession, path, m.version)
    filled, begins = [0] * m.n_shards, []
    for slot, part, _, rows in parts:
        begins.append((slot, part, m.shard_of[slot], filled[m.shard_of[slot]]))
        filled[m.shard_of[slot]] += rows
    table = docs.sparkSession.createDataFrame(begins, "vslot int, part int, shard int, begin long")
    ranked = records.withColumn("part", _part(F.col("size"), F.col("crc"))).withColumn("rank", F.row_number().over(Window.partitionBy("vslot", "part").orderBy("id", "size", "crc")))
    placed = ranked.join(F.broadcast(table), ["vslot", "part"])  # at most n_slots * PARTS rows
    return placed.select("id", "size", "crc", "vslot", "shard", (F.col("begin") + F.col("rank") - 1).alias("place")), m
