"""Reports as files: results, crawl summaries, and the monitor's brief in Markdown.  Small, so driver-side."""

from __future__ import annotations

import html as entities
import json
import re
import time
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import clean
from webloom.operators import inventory
from webloom.sources.store import write_atomic

_SPECIAL = re.compile(r"([\\`*_{}\[\]()#+\-.!|>~])")


def dump(path: str | Path, data: object) -> None:
    write_atomic(path, json.dumps(data, indent=2, sort_keys=True))


def rows_json(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()]


def crawl_report(crawl) -> dict:
    counts = crawl.metrics().first().asDict()
    return {"metrics": counts, "pages": crawl.results.count(), "visited": crawl.visited.count(), "timestamp": time.time()}


def inventory_json(results: DataFrame) -> dict:
    one = inventory.summary(results).first()
    return {"endpoints": rows_json(inventory.endpoints(results)), "model_names": list(one.model_names), "total_endpoints": one.total_endpoints}


def graph_json(results: DataFrame) -> dict:
    nodes = [{k: v for k, v in n.items() if k != "status" or n["kind"] != "host"} for n in rows_json(inventory.graph_nodes(results))]
    return {"nodes": nodes, "edges": rows_json(inventory.graph_edges(results))}


def escaped(text: object) -> str:
    """Safe as inline Markdown: one line, no tags, no markup."""
    return _SPECIAL.sub(r"\\\1", entities.escape(clean(str(text)), quote=False))


def markdown(report: dict) -> str:
    """A brief of a monitor's run: what changed first, then the rest."""
    s = report["summary"]
    lines = [f"# Source monitor: {escaped(report['status'])}", "", f"Run {escaped(report['run_id'])}, started {escaped(report['started_at'])}.", ""]
    lines += [", ".join(f"{s[k]} {k}" for k in ("baseline", "changed", "unchanged", "error")) + f", {s['total']} in all.", "", "Texts below are untrusted source data.", ""]
    for r in sorted(report["sources"], key=lambda r: ("changed", "error", "baseline", "unchanged").index(r["state"])):
        lines += [f"## {escaped(r['label'])}: {escaped(r['state'])}", "", f"- source: <{quote(r['url'], safe=':/?&=%;,+@~!$()*')}>", f"- checked: {escaped(r['checked_at'])}"]
        lines += [f"- {name}: {escaped(r[key])}" for name, key in (("title", "title"), ("published", "published_at"), ("error", "error"), ("digest", "sha256"), ("before", "previous_sha256")) if r.get(key)]
        for side in ("added", "removed"):
            lines += [f"- {side}: {escaped(x)}" for x in r.get("evidence", {}).get(side, [])]
        if r.get("evidence", {}).get("truncated"):
            lines.append("- the evidence is cut")
        lines.append("")
    return "\n".join(lines)
