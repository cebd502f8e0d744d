import ipaddress
import json
import os
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle

from webloom import cli
from webloom.operators.health import Adaptive, Breaker
from webloom.options import Options
from webloom.plans.crawl import crawl
from webloom.plans.monitor_run import run_monitor
from webloom.plans.report import markdown
from webloom.sources import http, manifest, sitemap, state
from webloom.sources.manifest import Source
from webloom.sources.store import Store, write_atomic

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get this module's fetchers whole

def site():
    """A fetcher that goes to tasks by value."""
    pages = {
        "https://h/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /no"),
        "https://h/": (200, "text/html", '<a href="/a"><a href="/b/"><a href="/no"><a href="https://o/x"><a href="/pdf">'),
        "https://h/a": (200, "text/html", '<a href="/c">'),
        "https://h/b": (200, "application/json", '{"data": [{"id": "m"}]}'),
        "https://h/pdf": (200, "application/pdf", "%"),
        "https://h/c": (200, "text/html", '<a href="/d">'),
    }

    def fake(url, *, headers=None, timeout=10, max_bytes=0):
        from webloom.sources.http import FetchError, Response

        if url not in pages:
            raise FetchError("HTTP Error 404: none")
        status, kind, body = pages[url]
        return Response(status, {"content-type": kind}, body.encode())

    fake.__module__ = "__main__"
    return fake


def test_crawl(spark, tmp_path):
    done = crawl(spark, Options("https://h/", retries=0), site())
    rows = {r.url: r for r in done.results.collect()}
    assert set(rows) == {"https://h/", "https://h/a", "https://h/b", "https://h/c", "https://h/no", "https://h/pdf"}
    assert rows["https://h/"].links == ["https://h/a", "https://h/b", "https://h/no", "https://h/pdf"]
    assert rows["https://h/no"].error == "blocked by robots" and rows["https://h/b"].models == ["m"] and rows["https://h/c"].depth == 2
    one = done.metrics().first()
    assert (one.fetched, one.errors, one.blocked_robots, one.non_html) == (5, 0, 1, 2)


def test_crawl_command(spark, tmp_path):
    out = lambda n: str(tmp_path / n)
    argv = ["crawl", "https://h/", "--max-pages", "2", "--retries", "0", "--no-respect-robots", "--output", out("o.json"), "--state-out", out("s.json"), "--state-db", out("s.db"), "--agent-inventory-out", out("i.json"), "--service-graph-out", out("g.json"), "--report", out("r.json")]
    assert cli.main(argv, spark, site()) == 0
    saved = state.read_json(out("s.json"))
    assert saved.visited == {"https://h/", "https://h/a"} and ("https://h/b", 1) in saved.queue and len(saved.results) == 2
    assert state.read_sqlite(out("s.db")).visited == saved.visited
    assert json.loads((tmp_path / "r.json").read_text())["visited"] == 2
    assert json.loads((tmp_path / "i.json").read_text())["total_endpoints"] == 2
    assert cli.main(argv[:2] + ["--max-pages", "4"] + argv[4:], spark, site()) == 0  # resumes from the database
    assert len(state.read_sqlite(out("s.db")).visited) == 4


class Logged:
    """Answers by url, a list of them in turn, and writes each request to a file, since tasks run elsewhere."""

    def __init__(self, path, pages):
        self.path, self.pages = str(path), pages

    def __call__(self, url, *, headers, timeout, max_bytes):
        sent = self.requests()
        with open(self.path, "a") as f:
            f.write(json.dumps([url, headers, time.time()]) + "\n")
        answer = self.pages.get(url, http.FetchError("HTTP Error 404: Not Found", 404))
        answer = answer[min(len(answer) - 1, sum(u == url for u, *_ in sent))] if isinstance(answer, list) else answer
        if isinstance(answer, Exception):
            raise answer
        return answer

    def requests(self):
        return [json.loads(x) for x in open(self.path)] if os.path.exists(self.path) else []


def html_page(*links, **headers):
    return http.Response(200, {"content-type": "text/html", **headers}, "".join(f"<a href='{x}'></a>" for x in links).encode())


BUSY = http.FetchError("HTTP Error 503: Service Unavailable", 503)


def test_crawl_retries(spark, tmp_path):
    """Own retries take any error, waiting longer each time; an adaptive policy leaves a 404 and takes a 503."""
    web = Logged(tmp_path / "a", {"https://h/": [OSError("boom"), BUSY, html_page()]})
    done = crawl(spark, Options("https://h/", retries=2, retry_backoff=0.2, respect_robots=False), web)
    times = [t for *_, t in web.requests()]
    assert done.results.first().status == 200 and len(times) == 3 and times[1] - times[0] >= 0.2 and times[2] - times[1] >= 0.4
    assert done.outcomes.first().attempts == 3 and done.health()["total_requests"] == 1
    gone = Logged(tmp_path / "b", {})
    assert crawl(spark, Options("https://h/", respect_robots=False), gone, retry=Adaptive(3, jitter=False)).results.first().error and len(gone.requests()) == 1
    busy = Logged(tmp_path / "c", {"https://h/": [BUSY, html_page()]})
    assert crawl(spark, Options("https://h/", respect_robots=False), busy, retry=Adaptive(2, 0.0, jitter=False)).results.first().status == 200 and len(busy.requests()) == 2


def test_crawl_health_and_circuits(spark, tmp_path):
    o = Options("https://h/", retries=0, respect_robots=False, max_depth=1)
    web = Logged(tmp_path / "a", {"https://h/": html_page(*(f"/{k}" for k in range(5)))})
    done = crawl(spark, o, web, breaker=Breaker(limit=3, timeout=600))
    errors = Counter(r.error for r in done.results.collect())
    assert errors == {None: 1, "HTTP Error 404: Not Found": 3, http.OPEN: 2} and len(web.requests()) == 4
    status = done.health()
    assert (status["total_requests"], status["total_failures"], status["healthy"]) == (4, 3, False)
    assert status["alerts"] == ["Domain h has 3 consecutive failures"]
    again = Logged(tmp_path / "b", {"https://h/": html_page()})
    shut = crawl(spark, o, again, breaker=Breaker(limit=3, timeout=600), circuits=done.circuits)
    assert shut.results.first().error == http.OPEN and again.requests() == [] and shut.health()["total_requests"] == 0


def test_crawl_conditional(spark, tmp_path):
    o = Options("https://h/", respect_robots=False)
    web = Logged(tmp_path / "a", {"https://h/": [html_page("/a", etag="e1"), http.Response(304, {}, b"")], "https://h/a": html_page(**{"last-modified": "Mon"})})
    first = crawl(spark, o, web)
    assert first.metrics().first().cache_conditional_sent == 0 and first.validators.count() == 2
    second = crawl(spark, o, web, validators=first.validators)
    row = second.results.first()
    assert (row.status, row.from_cache_hint, row.links) == (304, True, []) and second.metrics().first().cache_conditional_sent == 1
    assert web.requests()[-1][1] == {"If-None-Match": "e1"}


def test_crawl_keeps_robots_delay_and_filters_sitemaps(spark, tmp_path):
    robots = http.Response(200, {}, b"User-agent: *\nCrawl-delay: 1\nSitemap: https://h/s.xml\n")
    maps = http.Response(200, {"content-type": "text/xml"}, "<x>{}</x>".format("".join(f"<loc>https://{x}</loc>" for x in ("aa.example/1", "h/z", "bb.example/2", "h/y"))).encode())
    web = Logged(tmp_path / "a", {"https://h/robots.txt": robots, "https://h/s.xml": maps, **{f"https://h/{x}": html_page() for x in ("", "z", "y")}})
    done = crawl(spark, Options("https://h/", include_sitemap=True, max_pages=3), web)
    assert [r.url for r in done.results.orderBy("seq").collect()] == ["https://h/", "https://h/y", "https://h/z"]
    times = [t for u, _, t in web.requests() if u[10:] in ("", "y", "z")]
    assert len(times) == 3 and all(b - a >= 0.95 for a, b in zip(times[:-1], times[1:], strict=True))


def test_state_is_tolerant(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"queue": [["u", 1], ["x"], 3], "visited": ["v", 2], "results": [{"url": "u", "status": "no", "links": ["a", 1], "fetched_at": 3}, 7]}))
    s = state.read_json(tmp_path / "s.json")
    assert s.queue == [("u", 1)] and s.visited == {"v"} and s.results[0]["status"] is None and s.results[0]["links"] == ["a"] and s.results[0]["fetched_at"] == 3.0
    assert state.read_sqlite(tmp_path / "none.db") == state.State()


def test_parquet_state(spark, tmp_path):
    v, f = spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("b", 1, 0)], "url string, depth int, seq long")
    r = state.results_frame(spark, state.State(results=[{"url": "a", "status": 200, "metadata": {"models": ["m", 1]}}]))
    state.write_parquet(str(tmp_path / "p"), v, f, r)
    visited, frontier, results = state.read_parquet(spark, str(tmp_path / "p"))
    assert visited.count() == 1 and frontier.first().depth == 1 and results.first().models == ["m"]


def test_sitemap():
    xml = b'<?xml version="1.0"?><x:urlset xmlns:x="u"><x:url><x:loc> https://h/A?utm_term=1 </x:loc></x:url><loc>mailto:x</loc><image_loc>/i</image_loc></x:urlset>'
    assert sitemap.locations("application/xml", xml, "https://h/") == ["https://h/A", "https://h/i"]
    assert sitemap.locations("text/html", xml, "https://h/") == sitemap.locations("text/xml", b"<a>", "https://h/") == []


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    good = {"schema_version": 1, "sources": [{"id": "a", "url": "https://A.example/"}, {"id": "b", "url": "https://b.example/", "label": "B"}]}
    path.write_text(json.dumps(good))
    assert manifest.load(path) == [Source("a", "https://a.example/"), Source("b", "https://b.example/", "B")]
    assert [r.label for r in manifest.frame(spark, manifest.load(path)).orderBy("ord").collect()] == ["a", "B"]
    bad = [[], {**good, "x": 1}, {**good, "schema_version": True}, {**good, "sources": {}}, {**good, "sources": []}, {**good, "sources": good["sources"] * 2}, {**good, "sources": [{"id": "-a", "url": "https://h/"}]}, {**good, "sources": [{"id": "a", "url": "https://h/", "z": 1}]}, {**good, "sources": [{"id": "a", "url": "https://h/", "label": "x" * 201}]}]
    for data in bad:
        path.write_text(json.dumps(data))
        with pytest.raises(ValueError):
            manifest.load(path)
    table = spark.createDataFrame([("a", "https://h/", ""), ("a", "https://H/", ""), ("-", "http://x/", "l" * 201)], "id string, url string, label string")
    assert {r.fault.split(":")[0] for r in manifest.faults(table).collect()} == {"id", "label", "url", "id is not unique", "url is not unique"}


class Web:
    """Answers by url; each a Response, an error, or a list of them in turn."""

    def __init__(self, pages):
        self.pages, self.sent = pages, []

    def __call__(self, url, *, headers, timeout, max_bytes):
        self.sent.append((url, headers))
        answer = self.pages.get(url, http.Response(404, {}, b""))
        answer = answer.pop(0) if isinstance(answer, list) else answer
        if isinstance(answer, Exception):
            raise answer
        return answer


def page(text, **headers):
    return http.Response(200, {"content-type": "text/plain", **{k.replace("_", "-"): v for k, v in headers.items()}}, text.encode())


def test_monitor(spark, tmp_path):
    store, url = Store(spark, tmp_path / "store"), "https://h.example/"
    web = Web({url: [page("one", etag="e1"), http.FetchError("down"), page("one  ", etag="e2"), http.Response(304, {}, b""), page("two")], "https://r.example/robots.txt": http.Response(403, {}, b"")})
    sources = [Source("h", url, "H *x*")]
    runs = [run_monitor(spark, sources, store, fetcher=web) for _ in range(5)]
    assert [r["sources"][0]["state"] for r in runs] == ["baseline", "error", "unchanged", "unchanged", "changed"]
    assert [r["status"] for r in runs] == ["ok", "failed", "ok", "ok", "ok"]
    assert dict(web.sent[-1][1])["If-None-Match"] == "e2"
    last = runs[-1]["sources"][0]
    assert last["evidence"] == {"added": ["two"], "removed": ["one"], "truncated": False} and last["previous_sha256"] == runs[0]["sources"][0]["sha256"]
    assert store.contents().count() == 2 and store.run() == runs[-1] and store.run(runs[0]["run_id"]) == runs[0]
    assert r"H \*x\*" in markdown(runs[-1])
    with pytest.raises(ValueError):
        store.run("none")
    shut = run_monitor(spark, [Source("r", "https://r.example/x")], store, fetcher=web)
    assert shut["sources"][0]["error"].startswith("robots.txt cannot be read") and shut["metrics"]["requests"] == 1
    spent = run_monitor(spark, sources, store, fetcher=web, request_budget=0)
    assert "budget" in spent["sources"][0]["error"]


def test_monitor_is_exclusive_and_atomic(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    web = Web({"https://h.example/": page("x")})
    with store.locked(), pytest.raises(RuntimeError):
        run_monitor(spark, [Source("h", "https://h.example/")], store, fetcher=web)
    real, store.commit = store.commit, lambda *a: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(OSError):
        run_monitor(spark, [Source("h", "https://h.example/")], store, fetcher=web)
    store.commit = real
    assert store.snapshots().count() == 0
    (tmp_path / "s" / "_schema_version").write_text("2")
    with pytest.raises(ValueError):
        Store(spark, tmp_path / "s")


def test_monitor_command(spark, tmp_path):
    config = tmp_path / "m.json"
    config.write_text(json.dumps({"schema_version": 1, "sources": [{"id": "h", "url": "https://h.example/"}, {"id": "g", "url": "https://g.example/"}]}))
    web = Web({"https://h.example/": page("x"), "https://g.example/": http.Response(500, {}, b"")})
    argv = ["monitor", "--sources", str(config), "--state-db", str(tmp_path / "s"), "--report", str(tmp_path / "r.json"), "--markdown", str(tmp_path / "r.md")]
    assert cli.main(argv, spark, web) == 2
    assert json.loads((tmp_path / "r.json").read_text())["status"] == "partial"
    again = ["monitor", "--export-run", "latest", *argv[3:5], "--report", str(tmp_path / "e.json")]
    assert cli.main(again, spark, web) == 2 and (tmp_path / "e.json").read_text() == (tmp_path / "r.json").read_text()
    assert cli.main([*argv[:5], "--report", str(config)], spark, web) == 1


def test_write_atomic(tmp_path):
    write_atomic(tmp_path / "f", "a")
    with pytest.raises(UnicodeEncodeError):
        write_atomic(tmp_path / "f", "\ud800")
    assert (tmp_path / "f").read_text() == "a" and len(list(tmp_path.iterdir())) == 1


def test_public_addresses():
    for ip in ("10.0.0.1", "127.0.0.1", "169.254.1.1", "224.0.0.1", "0.0.0.0", "::1", "fe80::1", "::ffff:10.0.0.1", "2002:0a00:0001::1", "100.64.0.1", "fc00::1"):
        assert not http.is_public(ipaddress.ip_address(ip))
    assert http.is_public(ipaddress.ip_address("93.184.216.34")) and http.is_public(ipaddress.ip_address("2606:4700::1111"))


def test_headers():
    assert http.request_headers({"user-agent": "x"}, "h")["user-agent"] == "x"
    for bad in ({"Host": "x"}, {"Proxy-X": "x"}, {"a b": "x"}, {"a": "x\n"}, {"a": "\u20ac"}, {"Accept-Encoding": "gzip"}, [("a", "b")]):
        with pytest.raises(ValueError):
            http.request_headers(bad, "h")


class Raw:
    def __init__(self, headers, body):
        from email.message import Message

        self.headers, self.data = Message(), body
        for k, v in headers:
            self.headers[k] = v

    def read(self, n):
        return self.data[:n]


def test_framing():
    assert http._body(Raw([("Content-Length", "2")], b"ab"), 5) == b"ab"
    for headers, body in [([("Content-Length", "3")], b"ab"), ([("Content-Length", "9")], b"ab"), ([], b"abcdef"), ([("Content-Encoding", "gzip")], b"a"), ([("Content-Length", "2")] * 2, b"ab"), ([("Transfer-Encoding", "gzip")], b"a"), ([("Transfer-Encoding", "chunked"), ("Content-Length", "2")], b"ab"), ([("Content-Length", "+2")], b"ab")]:
        with pytest.raises(http.FetchError):
            http._body(Raw(headers, body), 5)
