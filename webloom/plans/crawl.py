"""An online traversal: each level's pages are fetched by tasks, a host within one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import health, policy
from webloom.operators.traverse import metrics, start_rows
from webloom.options import Options
from webloom.session import Grown, kept, numbered
from webloom.sources import http, sitemap
from webloom.sources.state import State, results_frame

COLUMNS = ["url", "status", "links", "content_type", "elapsed_ms", "bytes", "depth", "error", "fetched_at", "next_crawl_at", "from_cache_hint", "models", "rendered_js"]


@dataclass
class Crawl:
    """What a traversal found, and what a later one goes on from: validators (url, etag, last_modified) for conditional
    requests, circuits (domain, state, failures, opened), and outcomes for the operators of health."""

    results: DataFrame
    frontier: DataFrame
    visited: DataFrame
    outcomes: DataFrame
    validators: DataFrame
    circuits: DataFrame | None = None

    def metrics(self) -> DataFrame:
        sent = self.outcomes.agg(F.coalesce(F.sum("conditional"), F.lit(0)).alias("cache_conditional_sent"))
        return metrics(self.results).join(F.broadcast(sent))  # one row each

    def health(self, **options) -> dict:
        return health.details(self.outcomes.where("attempts > 0"), **options)


def _fetched(level: DataFrame, o: Options, fetcher: http.Fetcher, validators: DataFrame, retry, breaker, circuits: DataFrame | None) -> DataFrame:
    """Results of a level, links resolved but not filtered, with what the fetch says beside them."""
    requests = http.requests_of(level, validators)
    got = kept(http.fetch_frame(requests, fetcher, o.max_workers, o.timeout, o.max_bytes, retry, breaker, circuits, o.per_host_workers), "fetched")  # once
    media = F.coalesce(F.col("headers")["content-type"], F.lit(""))
    json, cached = F.lower(media).contains("json"), F.coalesce(F.col("status") == 304, F.lit(False))
    page = media.contains("text/html") & ~json
    text, longer = html.truncated(F.col("body"), o.max_bytes)
    asked = requests.select("url", (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()).cast("int").alias("asked"))
    rows = level.drop("delay").join(got.drop("seq"), "url").join(asked, "url").withColumn("text", F.when(~cached & (page | json), text))
    found = rows.select("*", html.links(F.when(page, F.col("text"))).alias("raw"))
    # links are resolved a row each, by built-in expressions where they are plain
    places = found.select("url", F.posexplode("raw").alias("pos", "link")).withColumn("to", urls.resolve_key(F.col("url"), F.col("link"))).where("to IS NOT NULL")
    links = places.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"]).alias("links"))
    now = F.unix_micros(F.current_timestamp()) / 1e6
    return found.join(links, "url", "left").select(
        "url", "status", F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.nullif(media, F.lit("")).alias("content_type"), F.when(F.col("attempts") > 0, F.col("elapsed_ms")).alias("elapsed_ms"),
        F.least(F.octet_length("body"), F.lit(o.max_bytes)).alias("bytes"), "depth", F.coalesce("error", F.when(page & longer, f"truncated at {o.max_bytes} bytes")).alias("error"),
        now.alias("fetched_at"), (now + o.recrawl_after_seconds).alias("next_crawl_at"), cached.alias("from_cache_hint"),
        F.when(json, html.models(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("models"), F.lit(o.render_js).alias("rendered_js"), "seq",
        "attempts", "ended", "asked", F.col("error").isNull().alias("success"), F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("last_modified"), "state", "failures", "opened",
    )


def outcomes_of(fetched: DataFrame) -> DataFrame:
    """Rows for the operators of health: an attempt that an open circuit stopped has attempts = 0 and no outcome."""
    return fetched.select("seq", F.col("ended").alias("ts"), urls.authority(F.col("url")).alias("domain"), "success", F.when(F.col("success"), F.col("status")).alias("status"), "elapsed_ms", F.when(F.col("success"), F.col("bytes")).alias("bytes_read"), "attempts", (F.col("asked") * F.col("attempts")).alias("conditional"))


def robots_for(level: DataFrame, known: DataFrame | None, o: Options, fetcher: http.Fetcher) -> tuple[DataFrame, DataFrame]:
    """Rules of all authorities met so far, and those of new ones, which are fetched."""
    hosts = level.select(urls.authority(F.col("url")).alias("netloc"), F.regexp_extract("url", "^https?://[^/?#]*", 0).alias("origin")).dropDuplicates(["netloc"])
    if known is not None:
        hosts = hosts.join(known.select("netloc"), "netloc", "left_anti")
    requests = http.requests_of(hosts.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit(0).cast("long").alias("seq")))
    got = http.fetch_frame(requests, fetcher, o.max_workers, o.timeout, o.max_bytes)
    code = F.regexp_extract(F.coalesce("error", F.lit("")), r"HTTP Error (\d{3})", 1)
    answers = got.select(urls.authority(F.col("url")).alias("netloc"), F.coalesce("status", F.nullif(code, F.lit("")).try_cast("int")).alias("status"), F.make_valid_utf8(F.col("body").cast("string")).alias("body"), (F.col("error").isNotNull() & (code == "")).alias("failed"))
    rules = kept(policy.robots_table(answers), "robots")
    return rules if known is None else known.unionByName(rules), rules


def sitemap_pages(rules: DataFrame, o: Options, fetcher: http.Fetcher) -> DataFrame:
    """(url): the pages that the sitemaps of some authorities name and the traversal may follow."""
    maps = rules.select(F.explode("sitemaps").alias("url")).distinct().withColumn("seq", F.lit(0).cast("long"))
    read = http.fetch_frame(http.requests_of(maps), fetcher, o.max_workers, o.timeout, o.max_bytes)
    pages = sitemap.links(read.select(F.col("headers")["content-type"].alias("content_type"), "body", F.lit(o.start_url).alias("base")))
    return pages.where(policy.may_follow(F.col("url"), o))


def crawl(spark: SparkSession, o: Options, fetcher: http.Fetcher = http.fetch_page, state: State | None = None, retry=None, breaker: health.Breaker | None = None, validators: DataFrame | None = None, circuits: DataFrame | None = None) -> Crawl:
    """Level by level from the state's queue, or from the start page.  Limits cut levels in order of discovery.

    `retry` decides on further tries (by default the options' own, with a linear wait), `breaker` is the circuit that each
    host starts with, and `validators` and `circuits` are an earlier traversal's.
    """
    state, retry = state or State(), retry or health.Linear(o.retries, o.retry_backoff)
    seen = Grown(spark.createDataFrame([(v,) for v in state.visited], "url string"), "visited")
    visited = seen.frame()
    robots = None
    validators = kept(validators if validators is not None else spark.createDataFrame([], "url string, etag string, last_modified string"), "validators")
    front = spark.createDataFrame(start_rows(o, (), state.queue), "url string, depth int, seq long")
    first = Window.partitionBy("url").orderBy("seq")
    front = kept(front.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").join(visited, "url", "left_anti"), "frontier")
    if o.respect_robots and o.include_sitemap:
        robots, new = robots_for(spark.createDataFrame([(urls.page_identity(o.start_url),)], "url string"), None, o, fetcher)
        front = _with_pages(front, visited, sitemap_pages(new, o, fetcher))
    parts: list[DataFrame] = [results_frame(spark, state).withColumn("seq", F.lit(-1).cast("long"))]
    outcomes: list[DataFrame] = []
    total, spent = visited.count(), 0
    while True:
        level = front.where(F.col("depth") <= o.max_depth)
        new = None
        if o.respect_robots:
            robots, new = robots_for(level, robots, o, fetcher)
            level = policy.allowed_by_robots(level, robots, o.user_agent)
        else:
            level = level.withColumn("robots_ok", F.lit(True))
        room = o.max_pages - total
        level = kept(level.orderBy("seq").limit(max(room, 0)), "level")
        go = level.where("robots_ok")
        if o.request_budget is not None:
            go = go.orderBy("seq").limit(max(o.request_budget - spent, 0))
        go = kept(policy.with_delay(go.drop("robots_ok"), o.crawl_delay, robots, o.user_agent), "go")
        n, blocked = go.count(), level.where("NOT robots_ok").count()
        if n + blocked == 0:
            over = o.request_budget is not None and spent >= o.request_budget
            every = _all(outcomes) if outcomes else spark.createDataFrame([], "seq long, ts double, domain string, success boolean, status int, elapsed_ms int, bytes_read int, attempts int, conditional int")
            return Crawl(_union(parts), front.limit(0) if over else front, visited, every, validators, circuits)
        got = kept(_fetched(go, o, fetcher, validators, retry, breaker, circuits), "results")
        outcomes.append(outcomes_of(got))
        given = got.where("etag IS NOT NULL OR last_modified IS NOT NULL").select("url", "etag", "last_modified")
        validators = kept(validators.join(given.select("url"), "url", "left_anti").unionByName(given), "validators")
        if breaker is not None:
            latest = got.groupBy(urls.authority(F.col("url")).alias("domain")).agg(F.max(F.struct("seq", "state", "failures", "opened")).alias("c")).select("domain", "c.state", "c.failures", "c.opened")
            circuits = kept(latest if circuits is None else circuits.join(latest.select("domain"), "domain", "left_anti").unionByName(latest), "circuits")
        shut = level.where("NOT robots_ok").select("url", F.lit(None).cast("int").alias("status"), F.array().cast("array<string>").alias("links"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("int").alias("elapsed_ms"), F.lit(None).cast("int").alias("bytes"), "depth", F.lit("blocked by robots").alias("error"), F.lit(None).cast("double").alias("fetched_at"), F.lit(None).cast("double").alias("next_crawl_at"), F.lit(False).alias("from_cache_hint"), F.array().cast("array<string>").alias("models"), F.lit(False).alias("rendered_js"), "seq")
        own = got.select(*COLUMNS, "seq").withColumn("links", F.filter("links", lambda u: policy.may_follow(u, o)))
        parts += [own, shut]
        total, spent = total + n + blocked, spent + n
        seen.add(go.select("url").unionByName(shut.select("url")))
        visited = seen.frame()
        found = own.where(F.col("depth") < o.max_depth).select((F.col("depth") + 1).alias("depth"), F.col("seq").alias("parent"), F.posexplode("links").alias("pos", "to"))
        found = found.groupBy("to").agg(F.min(F.struct("depth", "parent", "pos")).alias("d")).select(F.col("to").alias("url"), "d.depth", "d.parent", "d.pos")
        rest = front.join(visited, "url", "left_anti")
        found = found.join(visited, "url", "left_anti").join(front.select("url"), "url", "left_anti")
        begin = (front.agg(F.max("seq")).first()[0] or 0) + 1
        front = kept(rest.unionByName(numbered(found, "depth", "parent", "pos", begin=begin).select("url", "depth", "seq")), "frontier")
        if o.include_sitemap and new is not None:
            front = _with_pages(front, visited, sitemap_pages(new, o, fetcher))


def _with_pages(front: DataFrame, visited: DataFrame, pages: DataFrame) -> DataFrame:
    """The frontier with pages at depth 0 behind it, in order of their URLs."""
    begin = (front.agg(F.max("seq")).first()[0] or 0) + 1
    pages = pages.select("url").join(visited, "url", "left_anti").join(front.select("url"), "url", "left_anti").withColumn("depth", F.lit(0))
    return kept(front.unionByName(numbered(pages, "url", begin=begin).select("url", "depth", "seq")), "frontier")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return _all([p.select(*COLUMNS, "seq") for p in parts])
