"""The registered queries of the observation engine, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import health, inventory, links, monitor, policy, traverse
from webloom.options import Options
from webloom.session import kept, shared_dir
from webloom.sources import http, manifest, sitemap, state

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- links and URLs ---


def links_extract(spark: SparkSession, d: str) -> DataFrame:
    return links.extract(table(spark, d, "pages"))


def links_normalized(spark: SparkSession, d: str) -> DataFrame:
    return links.resolved(table(spark, d, "pages"))


def links_by_host(spark: SparkSession, d: str) -> DataFrame:
    return links.by_host(links.resolved(table(spark, d, "pages")))


def urls_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.page_key(F.col("url")).alias("canonical"))


#: The lists of `links_allowed`.
INCLUDE, EXCLUDE = ("example.com", "example.net"), ("cheap-pills.example.com", "tionsh.example.net")


def links_allowed(spark: SparkSession, d: str) -> DataFrame:
    o = Options("https://example.com/", include_domains=INCLUDE, exclude_domains=EXCLUDE, same_domain=False)
    found = links.resolved(table(spark, d, "pages")).select("page_id", "pos", "url")
    return found.where(policy.may_follow(F.col("url"), o))


def links_trap(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their path doubled, as a calendar trap would, and their pairs counted against small limits."""
    u = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/a/b/a/a?x=1&y=&&z=3"), F.when(F.col("page_id") % 2 == 0, "&q=4").otherwise(""))
    rows = table(spark, d, "pages").select("page_id", u.alias("url"))
    return rows.select("page_id", policy.query_pairs(F.col("url")).alias("pairs"), policy.segment_repeats(F.col("url")).alias("repeats"), policy.is_trap(F.col("url"), 3, 3).alias("trap"))


def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/\nDisallow: /de/2\nCrawl-delay: 2\n")
    hosts = pages.select(urls.authority(F.col("url")).alias("netloc")).distinct()
    answers = hosts.select("netloc", F.when(F.col("netloc").startswith("m."), 403).otherwise(200).alias("status"), body.alias("body"), F.col("netloc").startswith("blog.").alias("failed"))
    return policy.allowed_by_robots(pages, policy.robots_table(answers), "webloom/1.0").select("page_id", "robots_ok")


def politeness_schedule(spark: SparkSession, d: str) -> DataFrame:
    return policy.planned_start(table(spark, d, "pages").select("page_id", "url", F.col("page_id").alias("seq")), 0.5).select("page_id", "start_s")


# --- page content ---


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.page("html").alias("p")).select("page_id", F.col("p.text").alias("text"))


def page_digest(spark: SparkSession, d: str) -> DataFrame:
    return page_text(spark, d).select("page_id", F.sha2("text", 256).alias("sha256"))


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.page("html").alias("p")).select("page_id", F.col("p.title").alias("title"))


def page_truncated(spark: SparkSession, d: str) -> DataFrame:
    text, longer = html.truncated(F.encode("html", "UTF-8"), 2_000)
    return table(spark, d, "pages").select("page_id", F.length(text).cast("long").alias("chars"), longer.alias("truncated"))


# --- endpoints and graph ---


def results(spark: SparkSession, d: str) -> DataFrame:
    """Pages as crawl results; every fifth at the path of a service's self-description, and of JSON type."""
    path = F.element_at(F.array(*[F.lit(p) for p in inventory.SEED_PATHS]), (F.floor(F.col("page_id") / 5) % len(inventory.SEED_PATHS)).cast("int") + 1)
    service = F.col("page_id") % 5 == 0
    url = F.when(service, F.concat(F.regexp_extract("url", "^https?://[^/?#]*", 0), path)).otherwise(F.col("url"))
    media = F.when(service, "application/json").when(F.col("page_id") % 7 == 0, F.lit(None)).otherwise("text/html; charset=utf-8")
    body = F.when(service, F.concat(F.lit('{"data": [{"id": "model-'), (F.col("page_id") % 10).cast("string"), F.lit('"}, {"id": 2}, {"name": "x"}]}')))
    return table(spark, d, "pages").select("page_id", url.alias("url"), F.lit(200).alias("status"), media.alias("content_type"), F.lit(None).cast("string").alias("error"), body.alias("body"), "html", F.col("page_id").alias("seq"))


def endpoint_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory.endpoints(results(spark, d))


def model_names(spark: SparkSession, d: str) -> DataFrame:
    return inventory.model_names(results(spark, d))


def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumn("models", html.models(F.col("body")))
    return inventory.summary(rows).select(F.array_join("model_names", ",").alias("model_names"), "total_endpoints")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return inventory.graph_nodes(results(spark, d)).withColumn("status", F.coalesce("status", F.lit(0)))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return inventory.graph_edges(results(spark, d).withColumn("links", html.links("html"))).withColumnsRenamed({"from": "src", "to": "dst"})


# --- traversal ---


def site(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A made site: region to nation to customer to order pages and back, and its edges with places."""
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    page = lambda kind, key: F.concat(F.lit(f"https://site.example/{kind}/"), F.col(key).cast("string"))
    root = F.lit("https://site.example/")
    down = r.select(root.alias("src"), page("region", "r_regionkey").alias("dst"), F.col("r_regionkey").cast("long").alias("pos"))
    down = down.unionByName(n.select(page("region", "n_regionkey").alias("src"), page("nation", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("long").alias("pos")))
    down = down.unionByName(c.select(page("nation", "c_nationkey").alias("src"), page("customer", "c_custkey").alias("dst"), F.col("c_custkey").alias("pos")))
    down = down.unionByName(o.select(page("customer", "o_custkey").alias("src"), page("order", "o_orderkey").alias("dst"), F.col("o_orderkey").alias("pos")))
    back = down.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).cast("long").alias("pos"))
    seeds = spark.createDataFrame([("https://site.example/", 0, 0)], "url string, depth int, seq long")
    return seeds, down.unionByName(back)


def bfs_depths(spark: SparkSession, d: str) -> DataFrame:
    seeds, edges = site(spark, d)
    return traverse.traverse(spark, seeds, edges, max_depth=4, max_pages=None).visited.select("url", "depth")


def bfs_limited(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 pages in order of discovery."""
    seeds, edges = site(spark, d)
    return traverse.traverse(spark, seeds, edges, max_depth=3, max_pages=60).visited.select("url", "depth")


def bfs_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What a reached page limit leaves to visit."""
    seeds, edges = site(spark, d)
    return traverse.traverse(spark, seeds, edges, max_depth=2, max_pages=10).frontier.select("url", "depth")


def crawl_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    error = F.when(F.col("page_id") % 11 == 0, "blocked by robots").when(F.col("page_id") % 13 == 0, "truncated at 2000000 bytes").when(F.col("page_id") % 17 == 0, "timed out")
    return traverse.metrics(rows.withColumns({"error": error, "from_cache_hint": F.col("page_id") % 19 == 0}))


# --- health ---


#: Microseconds since 1970 of a time without a zone, whatever the session's zone.
_MICROS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    ok, micros = F.col("event_type") != "error", F.expr(_MICROS_SQL)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), micros.alias("us"), (micros / 1e6).alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), ok.alias("success"), F.when(ok, 200).otherwise(503).alias("status"), F.floor(F.col("value") * 10).cast("int").alias("elapsed_ms"), F.lit(None).cast("int").alias("bytes_read"))


def health_domain_stats(spark: SparkSession, d: str) -> DataFrame:
    return health.domain_stats(outcomes(spark, d))


def health_status_hist(spark: SparkSession, d: str) -> DataFrame:
    return health.status_counts(outcomes(spark, d))


def health_window_rate(spark: SparkSession, d: str) -> DataFrame:
    return health.failure_window(outcomes(spark, d), cell=1000)


def health_alerts(spark: SparkSession, d: str) -> DataFrame:
    return health.alerts(outcomes(spark, d))


def health_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return health.snapshot(outcomes(spark, d))


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    return health.breaker_states(outcomes(spark, d), limit=2, timeout=3600.0)


def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    tries = outcomes(spark, d).withColumn("attempt", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])))
    status = F.when(F.col("seq") % 3 == 0, 429).otherwise(F.col("status"))
    tries = tries.withColumn("status", status)
    again = health.should_retry(F.col("attempt"), F.col("status"), ~F.col("success"))
    return tries.select("seq", "attempt", again.alias("retry"), health.backoff(F.col("attempt"), F.col("status"), jitter=False).alias("delay_s"), health.linear_backoff(F.col("attempt")).alias("linear_s"))


def recrawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).select("seq", (F.col("us") + F.lit(86_400 * 1_000_000)).alias("next_us"))


# --- monitor ---


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Each document twice: a source is its `source`, the second look adds spaces, and some first looks fail."""
    docs = table(spark, d, "documents").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    text = html.squeezed(F.when(F.col("k") == 1, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" \n"))).otherwise(F.col("text")))
    failed = (F.col("k") == 0) & (F.col("doc_id") % 7 == 0)
    rows = docs.select(F.col("source").alias("id"), (2 * F.col("doc_id") + F.col("k")).alias("run"), F.concat(F.lit("https://"), "source", F.lit(".example/")).alias("url"), F.lit(monitor.NORMALIZATION).alias("normalization"), text.alias("text"), F.when(failed, "HTTP status 503").alias("error"))
    return rows.withColumn("sha256", F.when(F.col("error").isNull(), F.sha2("text", 256)))


def monitor_states(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).drop("text")
    return monitor.states(rows).select("id", "run", "state", "sha256", "previous_sha256", "error")


def monitor_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitor.summary(monitor.states(observations(spark, d).drop("text")))


def monitor_contents(spark: SparkSession, d: str) -> DataFrame:
    return monitor.contents(observations(spark, d)).select("sha256", F.length("text").cast("long").alias("chars"))


def monitor_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(observations(spark, d), "observations")
    known = monitor.contents(rows)
    changed = monitor.states(rows.drop("text")).where("state = 'changed'").join(known, "sha256", "left")
    return monitor.changed_evidence(changed, known).where("state = 'changed'").select("id", "run", "added", "removed", "truncated")


# --- sources and state ---


def source_urls(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs as if they were to be monitored: the resource, or that it is refused."""
    return table(spark, d, "pages").select("page_id", urls.source_key("url").alias("k")).select("page_id", F.col("k.url").alias("source"), F.col("k.error").isNotNull().alias("refused"))


def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults by kind of a manifest made of all pages, some with bad ids and labels."""
    p = F.col("page_id")
    rows = table(spark, d, "pages").select(F.concat(F.when(p % 7 == 0, "-").otherwise("p"), (p - p % 2).cast("string")).alias("id"), "url", F.when(p % 11 == 0, F.repeat(F.lit("x"), F.lit(201))).otherwise("").alias("label"))
    return manifest.faults(rows).groupBy(F.substring_index("fault", ":", 1).alias("fault")).agg(F.count("*").alias("n"))


def content_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bodies of four media types: the digest of what is compared, or why nothing is."""
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "text/plain; charset=utf-8").when(k == 1, "application/problem+json").when(k == 2, "application/pdf")
    body = F.when(k == 1, F.concat(F.lit('{"b": '), F.col("doc_id").cast("string"), F.lit(', "a": [1, null]}'))).otherwise(html.squeezed(F.col("text")))
    rows = table(spark, d, "documents").select("doc_id", html.content(kind, F.lit(None).cast("string"), F.encode(body, "UTF-8")).alias("c"))
    return rows.select("doc_id", F.sha2("c.text", 256).alias("sha256"), F.col("c.error").alias("error"))


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that sitemaps name, one made of each page; those that are not sent as XML name none."""
    xml = F.concat(F.lit('<urlset xmlns="u"><url><loc> '), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url><loc>/rel/</loc><x>/no</x></urlset>"))
    media = F.when(F.col("page_id") % 3 == 0, "text/html").otherwise("application/xml")
    return sitemap.links(table(spark, d, "pages").select(media.alias("content_type"), F.encode(xml, "UTF-8").alias("body"), F.lit("https://base.example/").alias("base")))


def _robots(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(urls.authority(F.col("url")).alias("netloc")).distinct()
    body = F.concat(F.lit("Sitemap: https://"), "netloc", F.lit("/s.xml\nUser-agent: other\nCrawl-delay: 9\n\nUser-agent: *\nDisallow: /x\nCrawl-delay: 2\nsitemap: https://"), "netloc", F.lit("/t.xml\n"))
    return policy.robots_table(hosts.select("netloc", F.lit(200).alias("status"), body.alias("body"), F.lit(False).alias("failed")))


def robots_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    return _robots(spark, d).select("netloc", F.explode("sitemaps").alias("sitemap"))


def politeness_robots(spark: SparkSession, d: str) -> DataFrame:
    """When requests start where the hosts' robots ask for longer pauses than the traversal's."""
    rows = table(spark, d, "pages").select("page_id", "url", F.col("page_id").alias("seq"))
    return policy.planned_start(rows, 0.5, _robots(spark, d), "webloom/1.0").select("page_id", "start_s")


def bfs_budget(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a spent request budget left room for; nothing waits after them."""
    seeds, edges = site(spark, d)
    walk = traverse.traverse(spark, seeds, edges, max_depth=3, max_pages=None, budget=25)
    return walk.visited.select("url", "depth", F.lit(walk.frontier.count()).cast("long").alias("waiting"))


def agent_seeds(spark: SparkSession, d: str) -> DataFrame:
    starts = ("https://a.example/x/y?z", "http://b.example:8080")
    return spark.createDataFrame([(s, u) for s in starts for u in inventory.seeds(s)], "start string, url string")


def conditional_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of all pages with the validators that an earlier traversal left for some."""
    rows = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("seq"))
    known = rows.where("seq % 3 = 0").select("url", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("etag"), F.when(F.col("seq") % 2 == 0, "Mon").alias("last_modified"))
    return http.requests_of(rows, known).select("url", "seq", "etag", "last_modified")


def last_results(spark: SparkSession, d: str) -> DataFrame:
    """The result that an upsert by URL leaves, of pages read at paths that many share."""
    rows = results(spark, d).select(F.regexp_extract("url", "^https?://[^/?#]*", 0).alias("url"), "status", F.col("page_id").alias("seq"))
    return state.last_per_url(rows)


def state_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A frontier that was written with its visited pages and results, and read back."""
    rows = table(spark, d, "pages").select("url", (F.col("page_id") % 3).cast("int").alias("depth"), F.col("page_id").alias("seq"))
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    state.write_parquet(path, rows.select("url"), rows, state.results_frame(spark, state.State()))
    return state.read_parquet(spark, path)[1]


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    links_by_host, links_extract, links_normalized, urls_canonical, links_allowed, links_trap, robots_filter, politeness_schedule,
    page_text, page_digest, page_title, page_truncated, endpoint_inventory, model_names, inventory_summary, graph_nodes, graph_edges,
    bfs_depths, bfs_limited, bfs_frontier, crawl_metrics, health_domain_stats, health_status_hist, health_window_rate, health_alerts,
    health_snapshot, breaker_states, retry_schedule, recrawl_schedule, monitor_states, monitor_summary, monitor_contents, monitor_evidence,
    source_urls, manifest_faults, content_dispatch, sitemap_pages, robots_sitemaps, politeness_robots, bfs_budget, agent_seeds,
    conditional_requests, last_results, state_round_trip,
)}
