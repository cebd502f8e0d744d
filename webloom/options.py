"""Settings of a traversal, with its defaults (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    start_url: str
    max_depth: int = 2
    max_pages: int = 100
    same_domain: bool = True
    allow_subdomains: bool = False
    user_agent: str = "webloom/1.0"
    timeout: float = 10
    max_bytes: int = 2_000_000
    respect_robots: bool = True
    crawl_delay: float = 0.0
    include_sitemap: bool = False
    retries: int = 1
    retry_backoff: float = 0.5
    include_domains: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    max_workers: int = 4
    request_budget: int | None = None
    recrawl_after_seconds: int = 86_400
    render_js: bool = False
    max_query_params: int = 15
    max_path_repeats: int = 4
    per_host_workers: int = 2
    agent_discovery: bool = False

    def __post_init__(self) -> None:
        for name in ("max_workers", "per_host_workers"):
            object.__setattr__(self, name, max(1, getattr(self, name)))
        for name in ("include_domains", "exclude_domains"):
            object.__setattr__(self, name, tuple(d.lower() for d in getattr(self, name)))
