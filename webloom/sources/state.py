"""A traversal's state: Parquet natively, and JSON and SQLite files for exchange.

Readers are tolerant: entries of the wrong type become null or are left out.  The exchange formats go through the
driver, as they are single files.
"""

from __future__ import annotations

import json
import sqlite3
from contextlib import closing
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.schemas import FRONTIER, RESULT, VISITED
from webloom.sources.store import write_atomic

_TEXT, _INT, _FLOAT = ("content_type", "error"), ("status", "elapsed_ms", "bytes", "depth"), ("fetched_at", "next_crawl_at")


@dataclass
class State:
    queue: list[tuple[str, int]] = field(default_factory=list)
    visited: set[str] = field(default_factory=set)
    results: list[dict] = field(default_factory=list)


def result_row(data: dict) -> dict:
    """A result with all fields, mistyped ones empty."""
    typed = lambda key, *kinds: data.get(key) if isinstance(data.get(key), kinds) else None
    out = {"url": str(data.get("url", "")), "links": [x for x in typed("links", list) or [] if isinstance(x, str)]}
    out |= {k: typed(k, str) for k in _TEXT} | {k: None if typed(k, int) is None else int(typed(k, int)) for k in _INT}
    out |= {k: None if typed(k, int, float) is None else float(typed(k, int, float)) for k in _FLOAT}
    return out | {"from_cache_hint": bool(data.get("from_cache_hint", False)), "metadata": typed("metadata", dict) or {}}


def _state(queue: object, visited: object, results: object) -> State:
    rows = lambda x: x if isinstance(x, list) else []
    pairs = [(str(q[0]), int(q[1])) for q in rows(queue) if isinstance(q, list) and len(q) == 2]
    return State(pairs, {v for v in rows(visited) if isinstance(v, str)}, [result_row(r) for r in rows(results) if isinstance(r, dict)])


def read_json(path: str | Path) -> State:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return _state(*(data.get(k) for k in ("queue", "visited", "results")))


def write_json(path: str | Path, state: State) -> None:
    write_atomic(path, json.dumps({"queue": [list(q) for q in state.queue], "visited": sorted(state.visited), "results": [result_row(r) for r in state.results]}, indent=2, sort_keys=True))


_DDL = (
    "CREATE TABLE IF NOT EXISTS crawl_state (id INTEGER PRIMARY KEY CHECK (id = 1), queue_json TEXT NOT NULL, visited_json TEXT NOT NULL, results_json TEXT NOT NULL)",
    "CREATE TABLE IF NOT EXISTS crawl_results (url TEXT PRIMARY KEY, payload_json TEXT NOT NULL)",
)


def _open(path: str | Path) -> sqlite3.Connection:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    for statement in _DDL:
        db.execute(statement)
    return db


def read_sqlite(path: str | Path) -> State:
    """The state of a database file; an empty one where none was saved."""
    with closing(_open(path)) as db:
        row = db.execute("SELECT queue_json, visited_json, results_json FROM crawl_state").fetchone()
    return _state(*map(json.loads, row)) if row else State()


def write_sqlite(path: str | Path, state: State) -> None:
    """Replaces the state, and per url the last result wins."""
    rows = [result_row(r) for r in state.results]
    dump = lambda x: json.dumps(x, sort_keys=True)
    with closing(_open(path)) as db, db:
        db.execute("REPLACE INTO crawl_state VALUES (1, ?, ?, ?)", (dump([list(q) for q in state.queue]), dump(sorted(state.visited)), dump(rows)))
        db.executemany("REPLACE INTO crawl_results VALUES (?, ?)", [(r["url"], dump(r)) for r in rows])


def write_parquet(path: str, visited: DataFrame, frontier: DataFrame, results: DataFrame) -> None:
    """Three tables of any size; results are last-wins by url where they have a seq."""
    visited.select("url").write.mode("overwrite").parquet(f"{path}/visited")
    frontier.select("url", "depth", "seq").write.mode("overwrite").parquet(f"{path}/frontier")
    results.write.mode("overwrite").parquet(f"{path}/results")


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}")
    return read(VISITED, "visited"), read(FRONTIER, "frontier"), read(RESULT, "results")


def results_frame(spark: SparkSession, state: State) -> DataFrame:
    """Results as typed rows; the two keys of metadata that traversals write become columns."""
    rows = [(r["url"], r["status"], r["links"], r["content_type"], r["elapsed_ms"], r["bytes"], r["depth"], r["error"], r["fetched_at"], r["next_crawl_at"], r["from_cache_hint"], [m for m in r["metadata"].get("models") or [] if isinstance(m, str)], bool(r["metadata"].get("rendered_js"))) for r in map(result_row, state.results)]
    return spark.createDataFrame(rows, RESULT)


def last_per_url(results: DataFrame) -> DataFrame:
    """The result of each url with the largest seq, by a map-side aggregate."""
    columns = [c for c in results.columns if c != "url"]
    best = results.groupBy("url").agg(F.max_by(F.struct(*columns), "seq").alias("r"))
    return best.select("url", *[F.col(f"r.{c}").alias(c) for c in columns])
