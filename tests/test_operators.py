import urllib.robotparser
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.operators import health, inventory, monitor, policy, traverse
from webloom.options import Options


def test_policy(spark):
    o = Options("https://example.com/", allow_subdomains=True, include_domains=("Example.com",), exclude_domains=("b.example.com",), max_query_params=2, max_path_repeats=2)
    cases = {"https://example.com/": True, "https://a.example.com/": True, "https://b.example.com/": False, "https://x.b.example.com/": False, "https://badexample.com/": False, "https://example.com/?a=1&b=2": True, "https://example.com/?a=1&b&c=": False, "https://example.com/x/y/x/x": False, "https://example.com/x/y/x": True, "/x": False, "https://example.com/?a&&": True}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", policy.may_follow(F.col("u"), o).alias("ok")).collect()
    assert {r.u: r.ok for r in got} == cases


ROBOTS = """# x
User-agent: Webloom
Disallow: /a/
Allow: /a/b
Disallow:

User-agent: *
User-agent: z
Allow: /p%20q
Disallow: /p
Disallow: /?
Crawl-delay: 3
Sitemap: https://h/s.xml
"""


@pytest.mark.parametrize("agent", ["webloom/1.0", "other", "z/2"])
def test_robots_agree_with_the_standard_library(spark, agent):
    theirs = urllib.robotparser.RobotFileParser()
    theirs.parse(ROBOTS.splitlines())
    rules, delays, maps = policy.parse_robots(ROBOTS)
    assert maps == ["https://h/s.xml"] and delays == {"*": 3.0, "z": 3.0}
    answers = spark.createDataFrame([("h", 200, ROBOTS, False)], "netloc string, status int, body string, failed boolean")
    pages = spark.createDataFrame([(f"https://h{p}",) for p in ("/", "", "/a/b", "/a/", "/p", "/q", "/px", "/?x", "/a")], "url string")
    got = policy.allowed_by_robots(pages, policy.robots_table(answers), agent).collect()
    assert {r.url: r.robots_ok for r in got} == {r.url: theirs.can_fetch(agent, r.url) for r in got}


def test_robots_modes(spark):
    cases = [(0, 200, False), (1, 403, False), (2, 404, False), (3, 503, False), (4, None, True), (5, 503, True), (6, None, None)]
    rows = spark.createDataFrame(cases, "k int, status int, failed boolean").orderBy("k").select(policy.robots_mode(F.col("status"), F.col("failed"))).collect()
    assert [r[0] for r in rows] == ["rules", "deny", "allow", "deny", "allow", "allow", "allow"]


def test_planned_start(spark):
    rows = spark.createDataFrame([("https://a/1", 0), ("https://b/1", 1), ("https://a/2", 2)], "url string, seq long")
    assert [r.start_s for r in policy.planned_start(rows, 2).orderBy("seq").collect()] == [0.0, 0.0, 2.0]


EDGES = [("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "c", 0), ("b", "d", 1), ("c", "r", 0), ("d", "e", 0)]


@pytest.mark.parametrize(("limits", "want", "left"), [({}, "rabcd", ""), ({"max_pages": 3}, "rab", "cd"), ({"budget": 2}, "ra", ""), ({"max_depth": 1}, "rab", ""), ({"max_pages": 2}, "ra", "b")])
def test_traverse(spark, limits, want, left):
    seeds = spark.createDataFrame([("r", 0, 0), ("r", 0, 1)], "url string, depth int, seq long")
    edges = spark.createDataFrame(EDGES, "src string, dst string, pos long")
    walk = traverse.traverse(spark, seeds, edges, **{"max_depth": 2, "max_pages": 100} | limits)
    assert "".join(r.url for r in walk.visited.orderBy("seq").collect()) == want
    found = {r.url for r in walk.frontier.collect()}
    assert set(left) <= found and not found & set(want)


def test_traverse_resumes(spark):
    seeds = spark.createDataFrame([("r", 0, 0), ("b", 1, 1)], "url string, depth int, seq long")
    edges = spark.createDataFrame(EDGES, "src string, dst string, pos long")
    walk = traverse.traverse(spark, seeds, edges, visited=spark.createDataFrame([("r",), ("a",)], "url string"))
    assert {r.url for r in walk.visited.collect()} == set("rabcd")


def test_crawl_captured(spark):
    start = "https://h/"
    pages = spark.createDataFrame([(start, 200, "text/html", bytearray(b"x" * 20), 5, 1.0), ("https://h/a", 200, "application/json", bytearray(b"{}"), 1, 2.0)], "url string, status int, content_type string, body binary, elapsed_ms int, fetched_at double")
    edges = spark.createDataFrame([(start, "https://h/a", 0), (start, "https://h/b", 1), (start, "https://o/", 2), (start, "https://h/no", 3)], "src string, dst string, pos long")
    answers = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /no", False)], "netloc string, status int, body string, failed boolean")
    got = traverse.crawl_captured(spark, pages, edges, Options(start, max_bytes=10), policy.robots_table(answers)).cache()
    assert {r.url: r.error for r in got.collect()} == {start: "truncated at 10 bytes", "https://h/a": None, "https://h/b": "not captured", "https://h/no": "blocked by robots"}
    assert traverse.metrics(got).first().asDict() == {"fetched": 3, "errors": 2, "blocked_robots": 1, "non_html": 1, "truncated": 1, "cache_hits": 0}


def test_endpoint_kinds(spark):
    cases = [("https://h/x/openapi.json", None, "api_schema"), ("https://h/V1/models", None, "model_catalog"), ("https://h/metrics", "text/html", "metrics"), ("https://h/health", None, "health"), ("https://h/.well-known/x", None, "well_known"), ("https://h/x", "Application/JSON", "json_api"), ("https://h/", "text/HTML", "web_ui"), ("https://h/?/health", None, "other")]
    rows = spark.createDataFrame([c[:2] for c in cases], "u string, t string")
    assert [r[0] for r in rows.select(inventory.kind(F.col("u"), F.col("t"))).collect()] == [c[2] for c in cases]
    assert inventory.seeds("https://h/x")[5] == "https://h/v1/models"


def test_graph(spark):
    rows = spark.createDataFrame([("https://h/a", 404, "text/html", ["https://z/"], 0), ("https://h/a", 200, None, [], 1)], "url string, status int, content_type string, links array<string>, seq long")
    assert {tuple(r) for r in inventory.graph_nodes(rows).collect()} == {("h", "host", None), ("https://h/a", "other", 200)}
    assert sorted(tuple(r) for r in inventory.graph_edges(rows).collect()) == [("h", "https://h/a", "exposes")] * 2 + [("https://h/a", "https://z/", "links_to")]


def test_breaker():
    b = health.Breaker(limit=2, timeout=10)
    for now, ok, blocked, state in [(0, False, False, "closed"), (1, False, False, "open"), (2, True, True, "open"), (11, False, False, "open"), (20, True, True, "open"), (21, True, False, "closed"), (22, False, False, "closed")]:
        assert b.blocks(now) is blocked
        if not blocked:
            b.record(ok, now)
        assert b.state == state


OUTCOMES = "seq long, ts double, domain string, success boolean, status int, elapsed_ms int, bytes_read int"


def test_health(spark):
    rows = [(k, float(k), "ab"[k % 2], k % 2 == 0, None if k == 3 else 200, 10, 5) for k in range(30)]
    df = spark.createDataFrame(rows, OUTCOMES)
    assert {r.domain: (r.requests, r.failures, r.total_elapsed_ms, r.total_bytes) for r in health.domain_stats(df).collect()} == {"a": (15, 0, 150, 75), "b": (15, 15, 0, 0)}
    assert {r.domain: r.counts for r in health.status_map(df).collect()} == {"a": {200: 15}, "b": {200: 14}}
    texts = {r.message: r.seq for r in health.alerts(df).collect()}
    assert texts["High failure rate 50% in the last 20 requests"] == 19 and texts["Domain b has 3 consecutive failures"] == 5 and len(texts) == 14
    one = health.snapshot(df).first()
    assert (one.failure_rate, one.status, one.n_alerts) == (0.5, "degraded", 14)
    assert health.snapshot(df.where("false")).first().status == "healthy"
    dealt, whole = (sorted(map(tuple, health.failure_window(df, 5, cell).collect())) for cell in (10, 1000))
    assert dealt == whole


def test_retry(spark):
    rows = spark.createDataFrame([(1, 429, True), (3, 500, True), (4, 500, True), (1, 404, True), (1, None, True), (1, None, False), (9, 503, True)], "a int, s int, e boolean")
    got = rows.select(health.should_retry(F.col("a"), F.col("s"), F.col("e")).alias("r"), health.backoff(F.col("a"), F.col("s"), jitter=False).alias("d"), health.backoff(F.col("a"), F.col("s")).alias("j")).collect()
    assert [r.r for r in got] == [True, True, False, False, True, False, False]
    assert [r.d for r in got] == [5, 4, 8, 1, 1, 1, 60] and all(r.d / 2 <= r.j < r.d for r in got)


def test_states_keep_last_good(spark):
    rows = [(0, "A", "1", None), (1, "A", None, "HTTP 503"), (2, "A", "1", None), (3, "A", "2", None), (4, "B", "2", None), (5, "A", "2", None)]
    df = spark.createDataFrame([("s", r, u, monitor.NORMALIZATION, h, e) for r, u, h, e in rows], "id string, run long, url string, normalization string, sha256 string, error string")
    assert [r.state for r in monitor.states(df).orderBy("run").collect()] == ["baseline", "error", "unchanged", "changed", "baseline", "baseline"]


def test_failure_window_takes_any_numbers(spark):
    """Numbers with gaps and repeats, over many cells, against a plain loop; and never one task for all."""
    seqs = [k * (1 if k % 3 else 10**6) for k in range(400)] + [7, 7]
    rows = sorted((s, (s * 7919) % 5 > 1) for s in seqs)
    want, size = Counter(), 20
    for k, (s, _) in enumerate(rows):
        last = [ok for _, ok in rows[max(0, k - size + 1) : k + 1]]
        want[s, len(last), last.count(False)] += 1
    frame = spark.createDataFrame(rows, "seq long, success boolean").repartition(3)
    assert Counter(map(tuple, health.failure_window(frame, size, 50).collect())) == want
    plan = health.failure_window(frame.unionByName(spark.range(10**9, 10**9 + 10**6, 5).selectExpr("id AS seq", "true AS success")))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_health_details(spark):
    rows = [(k, "a.b", k not in (3, 4, 5), 200 if k % 2 else None, 10) for k in range(6)] + [(6, "c", True, 200, 5)]
    outcomes = spark.createDataFrame(rows, "seq long, domain string, success boolean, status int, elapsed_ms int").withColumn("bytes_read", F.lit(1))
    got = health.details(outcomes)
    assert (got["total_requests"], got["total_failures"], got["failure_rate"], got["healthy"]) == (7, 3, 0.4286, False)
    assert got["alerts"] == ["Domain a.b has 3 consecutive failures"] and got["domain_stats"]["a.b"]["consecutive_failures"] == 3 and got["domain_stats"]["c"]["consecutive_failures"] == 0
    assert health.details(outcomes.where("false"))["healthy"]
