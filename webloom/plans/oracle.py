"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from webloom.functions.html import WHITE
from webloom.operators.inventory import SEED_PATHS

_LINKS = """raw AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
resolved AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, raw, regexp_extract(base, '^https?://[^/?#]*') || CASE WHEN rtrim(raw, '/') = '' THEN '/' ELSE rtrim(raw, '/') END AS url FROM raw)"""
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PAIRS = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '')"
_KEPT = f"list_sort(list_filter({_PAIRS}, lambda p: lower(split_part(p, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid')))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

_CANONICAL = f"regexp_extract(url, '^[a-z]+://[^/?#]*') || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE rtrim({_PATH}, '/') END || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"

# page text, by the rules as they apply to these pages
_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?is)<head>.*?</head>|<nav>.*?</nav>|<header>.*?</header>|<footer>.*?</footer>', '', 'g')"
_OPEN = rf"regexp_replace(regexp_replace({_BARE}, '(?i)</?(p|div|section|article|main|li|ul|ol|br|hr|h[1-6]|tr|td|th|pre|blockquote)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"


def _decoded(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&quot;', '\"'), '&middot;', '·'), '&amp;', '&')"


_WHITE = WHITE
_TEXT = f"trim(regexp_replace({_decoded(_OPEN)}, '{_WHITE}', ' ', 'g'))"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"

_SEEDS = "[" + ", ".join(f"'{p}'" for p in SEED_PATHS) + "]"
_RESULTS = f"""results AS (SELECT page_id, page_id AS seq, html, 200 AS status, CAST(NULL AS VARCHAR) AS error,
  CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^https?://[^/?#]*') || {_SEEDS}[(page_id // 5) % {len(SEED_PATHS)} + 1] ELSE url END AS url,
  CASE WHEN page_id % 5 = 0 THEN 'application/json' WHEN page_id % 7 = 0 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type FROM pages)"""
_KIND = f"""CASE WHEN ends_with(lower({_PATH}), 'openapi.json') OR ends_with(lower({_PATH}), 'swagger.json') THEN 'api_schema' WHEN ends_with(lower({_PATH}), '/v1/models') THEN 'model_catalog'
  WHEN ends_with(lower({_PATH}), '/metrics') THEN 'metrics' WHEN ends_with(lower({_PATH}), '/health') THEN 'health' WHEN starts_with(lower({_PATH}), '/.well-known/') THEN 'well_known'
  WHEN contains(lower(content_type), 'json') THEN 'json_api' WHEN contains(lower(content_type), 'html') THEN 'web_ui' ELSE 'other' END"""

_SITE = """down AS (
  SELECT 'https://site.example/' AS src, 'https://site.example/region/' || r_regionkey AS dst, CAST(r_regionkey AS BIGINT) AS pos FROM region
  UNION ALL SELECT 'https://site.example/region/' || n_regionkey, 'https://site.example/nation/' || n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT 'https://site.example/nation/' || c_nationkey, 'https://site.example/customer/' || c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'https://site.example/customer/' || o_custkey, 'https://site.example/order/' || o_orderkey, o_orderkey FROM orders)"""
# the down edges form a tree, so a page's order of discovery is its parent's order and its own place
_TREE = _SITE + """,
walk AS (
  SELECT 'https://site.example/' AS url, 0 AS depth, CAST([] AS BIGINT[]) AS place
  UNION ALL SELECT dst, depth + 1, list_append(place, pos) FROM walk JOIN down ON src = url WHERE depth < {depth})"""

_OUT = "o AS (SELECT event_id AS seq, epoch_us(ts) AS us, 'u' || user_id AS domain, event_type <> 'error' AS success, CASE WHEN event_type <> 'error' THEN 200 ELSE 503 END AS status, CAST(floor(value * 10) AS INTEGER) AS elapsed_ms FROM events)"
_WINDOW = "w AS (SELECT seq, count(*) OVER x AS n, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER x AS BIGINT) AS failures FROM o WINDOW x AS (ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
_RUNS = """i AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY seq) AS island FROM o),
runs AS (SELECT domain, seq, row_number() OVER (PARTITION BY domain, island ORDER BY seq) AS run FROM i WHERE NOT success)"""
_ALERTS = f"""{_OUT}, {_WINDOW}, {_RUNS},
m AS (SELECT seq, 'High failure rate ' || CAST(100 * failures // n AS INTEGER) || '% in the last 20 requests' AS message FROM w WHERE n >= 20 AND failures / n >= 0.5
  UNION ALL SELECT seq, 'Domain ' || domain || ' has ' || run || ' consecutive failures' FROM runs WHERE run >= 3),
alerts AS (SELECT min(seq) AS seq, message FROM m GROUP BY message)"""

_OBS = f"""obs AS (
  SELECT source AS id, 2 * doc_id + k AS run, trim(regexp_replace(CASE WHEN k = 1 THEN '  ' || replace(text, ' ', '  ') || ' ' || chr(10) ELSE text END, '{_WHITE}', ' ', 'g')) AS text,
    CASE WHEN k = 0 AND doc_id % 7 = 0 THEN 'HTTP status 503' END AS error FROM documents, (VALUES (0), (1)) t(k)),
d AS (SELECT *, CASE WHEN error IS NULL THEN sha256(text) END AS sha256 FROM obs),
p AS (SELECT *, last_value(sha256 IGNORE NULLS) OVER (PARTITION BY id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_sha256 FROM d),
s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN previous_sha256 IS NULL THEN 'baseline' WHEN previous_sha256 = sha256 THEN 'unchanged' ELSE 'changed' END AS state FROM p)"""

ORACLE_SQL: dict[str, str] = {
    "links_extract": f"WITH {_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, raw FROM raw",
    "links_normalized": f"WITH {_LINKS} SELECT page_id, pos, raw, url FROM resolved",
    "links_by_host": f"WITH {_LINKS} SELECT {_HOST} AS host, count(*) AS n_links, count(DISTINCT url) AS n_targets, count(DISTINCT page_id) AS n_pages FROM resolved GROUP BY 1",
    "urls_canonical": f"SELECT page_id, {_CANONICAL} AS canonical FROM pages",
    "links_allowed": f"""WITH {_LINKS}, h AS (SELECT page_id, pos, url, {_HOST} AS host FROM resolved)
SELECT page_id, pos, url FROM h WHERE (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.net' OR ends_with(host, '.example.net'))
  AND NOT (host = 'cheap-pills.example.com' OR ends_with(host, '.cheap-pills.example.com') OR host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net'))""",
    "links_trap": f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') || '/a/b/a/a?x=1&y=&&z=3' || CASE WHEN page_id % 2 = 0 THEN '&q=4' ELSE '' END AS url FROM pages),
s AS (SELECT page_id, len({_PAIRS}) AS pairs, unnest(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS seg FROM u),
c AS (SELECT page_id, pairs, count(*) AS n FROM s GROUP BY page_id, pairs, seg)
SELECT page_id, CAST(pairs AS INTEGER) AS pairs, CAST(max(n) AS INTEGER) AS repeats, pairs > 3 OR max(n) > 3 AS trap FROM c GROUP BY page_id, pairs""",
    "robots_filter": f"""WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(host, 'blog.') THEN true WHEN starts_with(host, 'm.') THEN false WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') OR starts_with(path, '/de/2') THEN false ELSE true END AS robots_ok FROM u""",
    "politeness_schedule": f"SELECT page_id, CAST((row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1) * 0.5 AS DOUBLE) AS start_s FROM pages",
    "page_text": f"SELECT page_id, {_TEXT} AS text FROM pages",
    "page_digest": f"SELECT page_id, sha256({_TEXT}) AS sha256 FROM pages",
    "page_title": f"SELECT page_id, left(trim(regexp_replace({_decoded(_TITLE)}, '{_WHITE}', ' ', 'g')), 300) AS title FROM pages",
    "page_truncated": """SELECT page_id, CAST(len(list_filter(regexp_extract_all(substr(hex(encode(html)), 1, 4000), '..'), lambda x: substr(x, 1, 1) NOT IN ('8', '9', 'A', 'B'))) AS BIGINT) AS chars, strlen(html) > 2000 AS truncated FROM pages""",
    "endpoint_inventory": f"WITH {_RESULTS} SELECT url, status, {_KIND} AS type, content_type, error FROM results",
    "model_names": "SELECT DISTINCT 'model-' || (page_id % 10) AS model FROM pages WHERE page_id % 5 = 0",
    "inventory_summary": "SELECT (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT 'model-' || (page_id % 10) AS m FROM pages WHERE page_id % 5 = 0)) AS model_names, count(*) AS total_endpoints FROM pages",
    "graph_nodes": f"""WITH {_RESULTS}, n AS (SELECT url AS id, {_KIND} AS kind, status, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS turn FROM results)
SELECT id, kind, status FROM n WHERE turn = 1 UNION ALL SELECT DISTINCT {_HOST}, 'host', 0 FROM results""",
    "graph_edges": f"""WITH {_RESULTS} SELECT {_HOST} AS src, url AS dst, 'exposes' AS relation FROM results
UNION ALL SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), 'links_to' FROM results""",
    "bfs_depths": f"WITH RECURSIVE {_TREE.format(depth=4)} SELECT url, depth FROM walk",
    "bfs_limited": f"WITH RECURSIVE {_TREE.format(depth=3)} SELECT url, depth FROM walk ORDER BY depth, place LIMIT 60",
    "bfs_frontier": f"WITH RECURSIVE {_TREE.format(depth=2)} SELECT url, depth FROM walk ORDER BY depth, place OFFSET 10",
    "crawl_metrics": f"""WITH {_RESULTS}, e AS (SELECT *, page_id % 11 = 0 AS blocked, CASE WHEN page_id % 11 = 0 THEN 'b' WHEN page_id % 13 = 0 THEN 't' WHEN page_id % 17 = 0 THEN 'x' END AS e FROM results)
SELECT count(*) FILTER (NOT blocked) AS fetched, count(*) FILTER (e IN ('t', 'x')) AS errors, count(*) FILTER (blocked) AS blocked_robots,
  count(*) FILTER (NOT blocked AND coalesce(content_type, '') <> '' AND NOT contains(content_type, 'text/html')) AS non_html, count(*) FILTER (e = 't') AS truncated, count(*) FILTER (page_id % 19 = 0) AS cache_hits FROM e""",
    "health_domain_stats": f"WITH {_OUT} SELECT domain, count(*) AS requests, count(*) FILTER (NOT success) AS failures, CAST(coalesce(sum(elapsed_ms) FILTER (success), 0) AS BIGINT) AS total_elapsed_ms, CAST(0 AS BIGINT) AS total_bytes FROM o GROUP BY domain",
    "health_status_hist": f"WITH {_OUT} SELECT domain, status, count(*) AS n FROM o GROUP BY domain, status",
    "health_window_rate": f"WITH {_OUT}, {_WINDOW} SELECT seq, n, failures FROM w",
    "health_alerts": f"WITH {_ALERTS} SELECT seq, message FROM alerts",
    "health_snapshot": f"""WITH {_ALERTS}, t AS (SELECT count(*) AS total_requests, count(*) FILTER (NOT success) AS total_failures, count(DISTINCT domain) AS domains_crawled FROM o)
SELECT *, round(total_failures / total_requests, 4) AS failure_rate, (SELECT count(*) FROM alerts) AS n_alerts, CASE WHEN total_failures / total_requests < 0.5 AND (SELECT count(*) FROM alerts) = 0 THEN 'healthy' ELSE 'degraded' END AS status FROM t""",
    "breaker_states": f"""WITH RECURSIVE {_OUT}, t AS (SELECT *, us / 1e6 AS ts, row_number() OVER (PARTITION BY domain ORDER BY seq) AS turn FROM o),
b AS (
  SELECT domain, CAST(0 AS BIGINT) AS turn, CAST(-1 AS BIGINT) AS seq, false AS blocked, 'closed' AS state, 0 AS failures, CAST(0 AS DOUBLE) AS opened FROM t GROUP BY domain
  UNION ALL
  SELECT domain, turn, seq, blocked, CASE WHEN blocked THEN 'open' WHEN success THEN 'closed' WHEN failures + 1 >= 2 THEN 'open' ELSE checked END,
    CASE WHEN blocked THEN failures WHEN success THEN 0 ELSE failures + 1 END, CASE WHEN NOT blocked AND NOT success AND failures + 1 >= 2 AND checked <> 'open' THEN ts ELSE opened END
  FROM (SELECT t.domain, t.turn, t.seq, t.success, t.ts, b.failures, b.opened, b.state = 'open' AND t.ts - b.opened < 3600 AS blocked, CASE WHEN b.state = 'open' AND t.ts - b.opened >= 3600 THEN 'half_open' ELSE b.state END AS checked
    FROM b JOIN t ON t.domain = b.domain AND t.turn = b.turn + 1))
SELECT domain, seq, blocked, state FROM b WHERE turn > 0""",
    "retry_schedule": f"""WITH {_OUT}, t AS (SELECT seq, success, CASE WHEN seq % 3 = 0 THEN 429 ELSE status END AS status, CAST(k AS INTEGER) AS attempt FROM o, (VALUES (1), (2), (3), (4)) v(k))
SELECT seq, attempt, attempt <= 3 AND status IN (429, 500, 502, 503, 504) AS retry, CAST(least(CASE WHEN status = 429 THEN 5.0 ELSE 1.0 END * pow(2.0, attempt - 1), 60.0) AS DOUBLE) AS delay_s, CAST(attempt * 0.5 AS DOUBLE) AS linear_s FROM t""",
    "recrawl_schedule": f"WITH {_OUT} SELECT seq, us + 86400000000 AS next_us FROM o",
    "monitor_states": f"WITH {_OBS} SELECT id, run, state, sha256, previous_sha256, error FROM s",
    "monitor_summary": f"""WITH {_OBS}, c AS (SELECT count(*) FILTER (state = 'baseline') AS baseline, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'error') AS error, count(*) AS total FROM s)
SELECT *, CASE WHEN error = total THEN 'failed' WHEN error > 0 THEN 'partial' ELSE 'ok' END AS status FROM c""",
    "monitor_contents": f"WITH {_OBS} SELECT DISTINCT sha256, length(text) AS chars FROM s WHERE error IS NULL",
    "monitor_evidence": f"""WITH {_OBS}, t AS (SELECT sha256, any_value(text) AS text FROM s WHERE error IS NULL GROUP BY sha256),
c AS (SELECT s.id, s.run, t.text AS old, s.text AS new, string_split(t.text, '') AS a, string_split(s.text, '') AS b, least(length(t.text), length(s.text)) AS most FROM s JOIN t ON t.sha256 = s.previous_sha256 WHERE state = 'changed'),
h AS (SELECT *, coalesce(list_position(list_transform(list_zip(a[1:most], b[1:most]), lambda z: z[1] <> z[2]), true) - 1, most) AS head FROM c),
l AS (SELECT *, coalesce(list_position(list_transform(list_zip(list_reverse(a)[1:most - head], list_reverse(b)[1:most - head]), lambda z: z[1] <> z[2]), true) - 1, most - head) AS tail FROM h),
e AS (SELECT *, substr(new, greatest(0, head - 60) + 1, length(new) - tail + 60 - greatest(0, head - 60)) AS more, substr(old, greatest(0, head - 60) + 1, length(old) - tail + 60 - greatest(0, head - 60)) AS less FROM l)
SELECT id, run, left(more, 400) AS added, left(less, 400) AS removed, length(more) > 400 OR length(less) > 400 AS truncated FROM e""",
    "source_urls": "SELECT page_id, CASE WHEN starts_with(url, 'https://') AND NOT contains(url, '#') THEN url END AS source, NOT (starts_with(url, 'https://') AND NOT contains(url, '#')) AS refused FROM pages",
    "manifest_faults": """WITH r AS (SELECT CASE WHEN page_id % 7 = 0 THEN '-' ELSE 'p' END || (page_id - page_id % 2) AS id, page_id % 7 = 0 AS bad_id, page_id % 11 = 0 AS bad_label, CASE WHEN starts_with(url, 'https://') AND NOT contains(url, '#') THEN url END AS url FROM pages)
SELECT * FROM (SELECT 'id' AS fault, count(*) FILTER (bad_id) AS n FROM r UNION ALL SELECT 'label', count(*) FILTER (bad_label) FROM r UNION ALL SELECT 'url', count(*) FILTER (url IS NULL) FROM r
  UNION ALL SELECT 'id is not unique', count(*) FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'url is not unique', count(*) FROM (SELECT url FROM r WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)) WHERE n > 0""",
    "content_dispatch": f"""WITH b AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 1 THEN '{{"a":[1,null],"b":' || doc_id || '}}' ELSE trim(regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g')) END AS text FROM documents),
e AS (SELECT *, CASE k WHEN 2 THEN 'Content-Type application/pdf is not supported' WHEN 3 THEN 'no Content-Type, so no baseline can be made' ELSE CASE WHEN text = '' THEN 'no content is left; the last good baseline stays' END END AS error FROM b)
SELECT doc_id, CASE WHEN error IS NULL THEN sha256(text) END AS sha256, error FROM e""",
    "sitemap_pages": f"SELECT {_CANONICAL} AS url FROM pages WHERE page_id % 3 <> 0 UNION SELECT 'https://base.example/rel' FROM pages WHERE page_id % 3 <> 0",
    "robots_sitemaps": f"WITH h AS (SELECT DISTINCT {_HOST} AS netloc FROM pages) SELECT netloc, 'https://' || netloc || s AS sitemap FROM h, (VALUES ('/s.xml'), ('/t.xml')) v(s)",
    "politeness_robots": f"SELECT page_id, CAST((row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1) * 2.0 AS DOUBLE) AS start_s FROM pages",
    "bfs_budget": f"WITH RECURSIVE {_TREE.format(depth=3)} SELECT url, depth, CAST(0 AS BIGINT) AS waiting FROM walk ORDER BY depth, place LIMIT 25",
    "agent_seeds": f"SELECT start, origin || unnest({_SEEDS}) AS url FROM (VALUES ('https://a.example/x/y?z', 'https://a.example'), ('http://b.example:8080', 'http://b.example:8080')) v(start, origin)",
    "conditional_requests": "SELECT url, min(page_id) AS seq, CASE WHEN min(page_id) % 3 = 0 THEN 'e' || min(page_id) END AS etag, CASE WHEN min(page_id) % 6 = 0 THEN 'Mon' END AS last_modified FROM pages GROUP BY url",
    "last_results": "SELECT regexp_extract(url, '^https?://[^/?#]*') AS url, 200 AS status, max(page_id) AS seq FROM pages GROUP BY 1",
    "state_round_trip": "SELECT url, CAST(page_id % 3 AS INTEGER) AS depth, page_id AS seq FROM pages",
}
