"""Command lines: `python -m webloom.cli crawl URL ...` and `python -m webloom.cli monitor ...`."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from webloom.options import Options
from webloom.plans import report
from webloom.plans.crawl import crawl
from webloom.plans.monitor_run import run_monitor
from webloom.sources import manifest, state
from webloom.sources.store import Store, write_atomic


def _crawl_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("start_url")
    for name, kind, default in (("max-depth", int, 2), ("max-pages", int, 100), ("timeout", float, 10), ("max-bytes", int, 2_000_000), ("crawl-delay", float, 0.0), ("retries", int, 1), ("retry-backoff", float, 0.5), ("max-workers", int, 4), ("per-host-workers", int, 2), ("request-budget", int, None), ("recrawl-after-seconds", int, 86_400), ("max-query-params", int, 15), ("max-path-repeats", int, 4)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--user-agent", default="webloom/1.0")
    for name in ("allow-external", "all-domains", "allow-subdomains", "include-sitemap", "render-js", "agent-discovery"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--respect-robots", action=argparse.BooleanOptionalAction, default=True)
    for name in ("include-domain", "exclude-domain"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("state-in", "state-out", "state-db", "report", "agent-inventory-out", "service-graph-out"):
        p.add_argument(f"--{name}")
    p.add_argument("--output", default="crawl.json")


def _monitor_arguments(p: argparse.ArgumentParser) -> None:
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--sources", help="manifest of sources")
    one.add_argument("--export-run", metavar="RUN", help="write a stored run, by id or `latest`, and read nothing")
    p.add_argument("--state-db", required=True, help="folder of the store")
    p.add_argument("--report", required=True, help="JSON report")
    p.add_argument("--markdown", help="Markdown brief")
    p.add_argument("--timeout", type=float, default=10.0)
    p.add_argument("--max-bytes", type=int, default=1_000_000)
    p.add_argument("--request-budget", type=int)


def options_of(a: argparse.Namespace) -> Options:
    same = {k: getattr(a, k) for k in Options.__dataclass_fields__ if hasattr(a, k)}
    return Options(**same, same_domain=not (a.allow_external or a.all_domains), include_domains=tuple(a.include_domain), exclude_domains=tuple(a.exclude_domain))


def run_crawl(spark: SparkSession, a: argparse.Namespace, fetcher=None) -> int:
    o = options_of(a)
    before = state.read_sqlite(a.state_db) if a.state_db else state.read_json(a.state_in) if a.state_in else None
    from webloom.sources import http

    def rendered(url: str, **more) -> http.Response:
        return http.Response(200, {"content-type": "text/html"}, http.render(url, int(1000 * o.timeout)).encode())

    done = crawl(spark, o, fetcher or (rendered if o.render_js else http.fetch_page), before)
    rows = [{**{k: v for k, v in r.items() if k not in ("models", "rendered_js", "seq")}, "metadata": ({"models": r["models"]} if r["models"] else {}) | ({"rendered_js": True} if r["rendered_js"] else {})} for r in report.rows_json(done.results.orderBy("seq"))]
    after = state.State([(r.url, r.depth) for r in done.frontier.orderBy("seq").collect()], {r.url for r in done.visited.collect()}, rows)  # bounded by max_pages
    if a.state_db:
        state.write_sqlite(a.state_db, after)
    if a.state_out:
        state.write_json(a.state_out, after)
    if a.report:
        report.dump(a.report, report.crawl_report(done))
    if a.agent_inventory_out:
        report.dump(a.agent_inventory_out, report.inventory_json(done.results))
    if a.service_graph_out:
        report.dump(a.service_graph_out, report.graph_json(done.results))
    report.dump(a.output, rows)
    print(f"{len(rows)} pages in {a.output}")
    return 0


def run_monitor_command(spark: SparkSession, a: argparse.Namespace, fetcher=None) -> int:
    """0 if all sources were read, 2 if some were not, 1 if the run or its files could not be made."""
    found = None
    try:
        paths = [Path(p).resolve() for p in (a.sources, a.state_db, a.report, a.markdown) if p]
        if len(set(paths)) < len(paths):
            raise ValueError("manifest, store and outputs have paths of their own")
        store = Store(spark, a.state_db)
        if a.export_run:
            found = store.run(a.export_run)
        else:
            found = run_monitor(spark, manifest.load(a.sources), store, fetcher=fetcher, timeout=a.timeout, max_bytes=a.max_bytes, request_budget=a.request_budget)
        report.dump(a.report, found)
        if a.markdown:
            write_atomic(a.markdown, report.markdown(found))
    except (ValueError, OSError, RuntimeError) as error:
        stored = f" (run {found['run_id']} is stored; --export-run writes it)" if found else ""
        print(f"monitor: {error}{stored}", file=sys.stderr)
        return 1
    print(f"run {found['run_id']}: {found['status']}")
    return 2 if found["summary"]["error"] else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, fetcher=None) -> int:
    top = argparse.ArgumentParser(prog="webloom")
    commands = top.add_subparsers(dest="command", required=True)
    _crawl_arguments(commands.add_parser("crawl"))
    _monitor_arguments(commands.add_parser("monitor"))
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return (run_crawl if a.command == "crawl" else run_monitor_command)(spark, a, fetcher)


if __name__ == "__main__":
    raise SystemExit(main())
