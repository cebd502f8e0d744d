"""DuckDB SQL of the queries of this subpackage that SQL can express, written without a look at how operators work."""

from __future__ import annotations

_SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT r, doc_id, unnest(regexp_extract_all(hex(raw), '..')) AS x, unnest(range(octet_length(raw))) AS i FROM d),
w AS (SELECT *, CASE WHEN count(*) OVER nxt = 50 THEN string_agg(x, '') OVER nxt END AS win FROM b WINDOW nxt AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS least FROM w WHERE win IS NOT NULL GROUP BY win),
f AS (SELECT w.r, w.i, w.x, coalesce(m.least < w.doc_id, false) AS hit FROM w LEFT JOIN m ON w.win = m.win),
c AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY i) AS before FROM c),
g AS (SELECT r, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY r)
SELECT d.doc_id, octet_length(d.raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r"""

_SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (SELECT r, unnest(words) AS x, unnest(range(len(words))) AS i FROM d),
w AS (SELECT *, CASE WHEN count(*) OVER nxt = 35 THEN string_agg(x, ' ') OVER nxt END AS win FROM b WINDOW nxt AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
m AS (SELECT win FROM w WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
f AS (SELECT w.r, w.i, w.x, m.win IS NOT NULL AS hit FROM w LEFT JOIN m ON w.win = m.win),
c AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT r, sum(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r"""

_CLASSES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""


def _either(word: str) -> str:
    """A pattern for an ASCII word in either case; case folding would also take non-ASCII letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_SECRET_KINDS = [
    ("assign", rf"""(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
    ("access", "(AKIA[A-Z0-9]+)", "length(m) >= 20"),
    ("hex", "([0-9a-f]+)", "length(m) >= 24"),
    ("key_id", "([A-Z0-9]{16,})", "length(m) <= 32 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]')"),
    ("key_secret", "([A-Za-z0-9+/_=-]{32,})", "length(m) <= 128 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    ("endpoint", r"""((?:https?|s3|ftp|wss?|postgres|mysql|redis|mongodb|amqp)://[^\x20\x09-\x0D"''<>]+)""", "true"),
]
_SPANS = " UNION ALL ".join(f"""SELECT r, {rank} AS rank, '{kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY k) AS e FROM (
      SELECT r, unnest(regexp_extract_all(t, '{rx}')) AS m, unnest(regexp_extract_all(t, '{rx}', 1)) AS g, unnest(string_split_regex(t, '{rx}')) AS gap, unnest(range(len(regexp_extract_all(t, '{rx}')) + 1)) AS k FROM d))
  WHERE m IS NOT NULL AND {holds}""" for rank, (kind, rx, holds) in enumerate(_SECRET_KINDS))
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({_SPANS}),
p AS (SELECT * FROM x WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM x b WHERE b.r = x.r AND b.rank < 3 AND b.s < x.e AND x.s < b.e)),
near AS (SELECT p.r, p.rank, p.kind, p.s, p.e, bool_or(a.rank IN (1, 3)) AS by_id, bool_or(a.rank IN (0, 2, 4)) AS by_secret
  FROM p JOIN p a ON a.r = p.r AND a.rank < 5 AND a.s <= p.e + 256 AND a.e >= p.s - 256 AND (a.s <> p.s OR a.e <> p.e) WHERE p.rank >= 3 GROUP BY ALL),
o AS (SELECT r, rank, kind, s, e FROM p WHERE rank < 3 UNION ALL SELECT r, rank, kind, s, e FROM near WHERE CASE rank WHEN 3 THEN by_secret WHEN 4 THEN by_id ELSE by_id AND by_secret END),
g AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r"""

_REST = "substr(url, strpos(url, '://') + 3)"
_HAS = "strpos(url, '://') > 0"
_ARCHIVES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest"""

_URLS = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN {_HAS} THEN translate(regexp_extract({_REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN {_HAS} THEN regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN {_HAS} THEN regexp_extract({_REST}, '^[^?#]*\?([^#]*)', 1) ELSE '' END AS query, coalesce({_HAS}, false) AS has
  FROM pages),
k AS (
  SELECT *, CASE WHEN has THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(list_filter(string_split(query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))) > 0
    THEN '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))), '&') ELSE '' END END AS key
  FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN key IN (SELECT key FROM k WHERE (starts_with(md5(key), '0') OR regexp_matches(host, '(^|\.)(cheap-pills|casino-win|free-bets|spam-farm|adult-x|ads-track)\.')) AND key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": _SUFFIXES,
    "op3_warc": _ARCHIVES,
    "op4_secret_scan": _SECRETS,
    "op5_jaccard_join": _CLASSES,
    "op6_url_filter": _URLS,
    "op9_substring_dedup": _SUBSTRINGS,
}
