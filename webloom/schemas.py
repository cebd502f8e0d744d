"""Schemas of the tables that operators read and write."""

from __future__ import annotations

RESULT = "url string, status int, links array<string>, content_type string, elapsed_ms int, bytes int, depth int, error string, fetched_at double, next_crawl_at double, from_cache_hint boolean, models array<string>, rendered_js boolean"
FRONTIER = "url string, depth int, seq long"
VISITED = "url string"
OUTCOME = "seq long, ts double, domain string, success boolean, status int, elapsed_ms int, bytes_read int"
SOURCE = "id string, url string, label string, ord int"
OBSERVATION = "id string, url string, label string, run long, checked_at timestamp, status int, content_type string, content_encoding string, etag string, last_modified string, body binary, sent_validator boolean, error string"
SNAPSHOT = "id string, url string, normalization string, sha256 string, raw_sha256 string, title string, published_at string, etag string, last_modified string, last_success_at timestamp"
CONTENT = "sha256 string, text string"
ROBOTS = "netloc string, mode string, rules array<struct<agent:string,allow:boolean,path:string>>, delays map<string,double>, sitemaps array<string>"
