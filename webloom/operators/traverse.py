"""Breadth-first traversal, a level at a time.

One job per level: the frontier meets its pages, their links are filtered and those seen before drop out.  Order is
explicit: a page's `seq` follows its parent's and the link's place, so limits cut the same prefix whatever the
partitioning.  Each level is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import inventory, policy
from webloom.options import Options
from webloom.session import Grown, kept, numbered


@dataclass
class Traversal:
    """visited (url, depth, seq), frontier (url, depth, seq) and edges (src, dst, pos) that were followed."""

    visited: DataFrame
    frontier: DataFrame
    levels: list[int]


def traverse(spark: SparkSession, seeds: DataFrame, edges: DataFrame, max_depth: int = 2, max_pages: int | None = 100, budget: int | None = None, allow: Callable | None = None, visited: DataFrame | None = None) -> Traversal:
    """Seeds (url, depth, seq), first one of a url wins, and edges (src, dst, pos).

    `max_pages` bounds all visited pages, `budget` the pages of this call.  A spent budget empties the frontier; a
    reached page limit leaves it.  Levels have least depths.
    """
    first = Window.partitionBy("url").orderBy("seq")
    front = seeds.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    done = visited.select("url", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("seq")) if visited is not None else spark.createDataFrame([], "url string, depth int, seq long")
    seen = Grown(done, "visited")
    total, spent, levels = seen.frame().count(), 0, []
    front = kept(front.join(seen.frame().select("url"), "url", "left_anti").where(F.col("depth") <= max_depth).select("url", "depth", "seq"), "frontier")
    while (waiting := front.count()) > 0:
        room = min(x for x in (waiting, None if max_pages is None else max_pages - total, None if budget is None else budget - spent) if x is not None)
        if room <= 0:
            if budget is not None and spent >= budget:
                front = front.limit(0)
            break
        level = front if room == waiting else kept(front.orderBy("seq").limit(room), "level-cut")
        rest = None if room == waiting else kept(front.join(level.select("url"), "url", "left_anti"), "rest")
        levels.append(room)
        total, spent = total + room, spent + room
        seen.add(level)
        done = seen.frame()
        expand = level.where(F.col("depth") < max_depth)
        found = expand.join(edges.withColumnRenamed("src", "url"), "url").select(F.col("dst").alias("to"), (F.col("depth") + 1).alias("depth"), F.col("seq").alias("parent"), "pos")
        if allow is not None:
            found = found.where(allow(F.col("to")))
        found = found.join(done.select(F.col("url").alias("to")), "to", "left_anti")
        if rest is not None:
            found = found.join(rest.select(F.col("url").alias("to")), "to", "left_anti")
        # the first discovery of a page: least (depth, parent, pos), by a map-side aggregate
        found = found.groupBy("to").agg(F.min(F.struct("depth", "parent", "pos")).alias("d")).select(F.col("to").alias("url"), "d.depth", "d.parent", "d.pos")
        begin = (front.agg(F.max("seq")).first()[0] or 0) + 1
        front = numbered(found, "depth", "parent", "pos", begin=begin).select("url", "depth", "seq")
        if rest is not None:
            front = rest.select("url", "depth", "seq").unionByName(front)
    return Traversal(seen.frame(), front, levels)


def start_rows(o: Options, sitemap_links: list[str] = (), queue: list[tuple[str, int]] | None = None) -> list[tuple[str, int, int]]:
    """Seeds in order: the queue, or else the start page; then sitemap links, sorted; then self-descriptions."""
    out = list(queue or [(urls.page_identity(o.start_url), 0)])
    if o.include_sitemap:
        out += [(u, 0) for u in sorted(set(sitemap_links))]
    if o.agent_discovery:
        out += [(urls.page_identity(u), 0) for u in inventory.seeds(o.start_url)]
    return [(u, d, k) for k, (u, d) in enumerate(out)]


def crawl_captured(spark: SparkSession, pages: DataFrame, edges: DataFrame, o: Options, robots: DataFrame | None = None, **start) -> DataFrame:
    """Results (schema RESULT without bodies) of a traversal over captured `pages` (url, status, content_type, body,
    elapsed_ms, fetched_at).  A page that was not captured is an error row; robots-blocked pages are never expanded."""
    seeds = spark.createDataFrame(start_rows(o, **start), "url string, depth int, seq long")
    seeds = seeds.where((F.col("seq") == 0) | policy.may_follow(F.col("url"), o))
    blocked = None
    if robots is not None and o.respect_robots:
        known = edges.select(F.col("dst").alias("url")).unionByName(seeds.select("url")).distinct()
        blocked = kept(policy.allowed_by_robots(known, robots, o.user_agent).where("NOT robots_ok").select("url"), "blocked")
        edges = edges.join(blocked.withColumnRenamed("url", "src"), "src", "left_anti")
    walk = traverse(spark, seeds, edges, o.max_depth, o.max_pages, o.request_budget, lambda u: policy.may_follow(u, o))
    out = walk.visited.join(pages, "url", "left")
    links = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("links")).withColumnRenamed("src", "url")
    out = out.join(links, "url", "left")
    media = F.coalesce("content_type", F.lit(""))
    error = F.when(F.col("status").isNull(), "not captured").when(media.contains("text/html") & (F.octet_length("body") > o.max_bytes), f"truncated at {o.max_bytes} bytes")
    if blocked is not None:
        out = out.join(blocked.withColumn("b", F.lit(True)), "url", "left")
        error = F.when(F.col("b"), "blocked by robots").otherwise(error)
    return out.select("url", "status", F.coalesce("links", F.array().cast("array<string>")).alias("links"), "content_type", "elapsed_ms", F.least(F.octet_length("body"), F.lit(o.max_bytes)).alias("bytes"), "depth", error.alias("error"), "fetched_at", (F.col("fetched_at") + o.recrawl_after_seconds).alias("next_crawl_at"), (F.coalesce("status", F.lit(0)) == 304).alias("from_cache_hint"), "seq")


def metrics(results: DataFrame) -> DataFrame:
    """One row of counters.  Robots-blocked rows count as blocked only."""
    blocked = F.coalesce(F.col("error") == "blocked by robots", F.lit(False))
    media = F.coalesce("content_type", F.lit(""))
    return results.agg(
        F.count_if(~blocked).alias("fetched"),
        F.count_if(~blocked & F.col("error").isNotNull()).alias("errors"),
        F.count_if(blocked).alias("blocked_robots"),
        F.count_if(~blocked & (media != "") & ~media.contains("text/html")).alias("non_html"),
        F.count_if(~blocked & F.coalesce(F.col("error").startswith("truncated"), F.lit(False))).alias("truncated"),
        F.count_if(F.col("from_cache_hint")).alias("cache_hits"),
    )
