"""Which links a traversal may follow: traps, domains, robots rules and politeness."""

from __future__ import annotations

from urllib.parse import unquote, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import urls
from webloom.options import Options


def query_pairs(url: Column) -> Column:
    """Number of query pairs; blank values count, empty pieces do not."""
    return F.size(F.filter(F.split(urls.query_of(url), "&"), lambda p: p != ""))


def segment_repeats(url: Column) -> Column:
    """How often the path segment that occurs most does; 0 without segments."""
    parts = F.filter(F.split(F.regexp_replace(urls.path_of(url), r";[^/]*$", ""), "/"), lambda s: s != "")
    return F.coalesce(F.array_max(F.transform(F.array_distinct(parts), lambda s: F.size(F.filter(parts, lambda x: x == s)))), F.lit(0))


def is_trap(url: Column, max_query_params: int = 15, max_path_repeats: int = 4) -> Column:
    return (query_pairs(url) > max_query_params) | (segment_repeats(url) > max_path_repeats)


def in_domain(netloc: Column, domain: str) -> Column:
    """The domain itself or one below it, in any case."""
    name, own = domain.lower(), F.lower(netloc)
    return (own == name) | own.endswith("." + name)


def passes_lists(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    host = urls.authority(url)
    some = lambda names: F.reduce(F.array(*[in_domain(host, d) for d in names]), F.lit(False), lambda a, x: a | x)
    test = host != ""
    if include:
        test &= some(include)
    if exclude:
        test &= ~some(exclude)
    return test


def may_follow(url: Column, o: Options) -> Column:
    """The traversal's test of a link, without robots."""
    test = ~is_trap(url, o.max_query_params, o.max_path_repeats) & passes_lists(url, o.include_domains, o.exclude_domains)
    if o.same_domain:
        origin, host = urlparse(o.start_url).netloc, urls.authority(url)
        test &= (host == origin) | (F.lit(o.allow_subdomains) & host.endswith("." + origin))
    return test


# --- robots ---


def parse_robots(text: str) -> tuple[list[tuple[str, bool, str]], dict[str, float], list[str]]:
    """Rules (agent, allow, path) in file order, delays by agent, and sitemaps.  A group is the agents named together
    before its rules; a blank line ends it."""
    rules: list[tuple[str, bool, str]] = []
    delays: dict[str, float] = {}
    sitemaps: list[str] = []
    agents: list[str] = []
    ruled = False
    for raw in text.splitlines():
        line = raw.partition("#")[0].strip()
        if not line:
            if not raw.strip() and ruled:
                agents, ruled = [], False
            continue
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps.append(value)
        elif key == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
        elif agents and key in ("allow", "disallow"):
            ruled = True
            if value or key == "allow":
                path = urlunparse(urlparse(unquote(value)))
                rules += [(a, key == "allow" or not value, path) for a in agents]
        elif agents and key == "crawl-delay":
            ruled = True
            if value.isdigit():
                delays |= {a: float(value) for a in agents}
    return rules, delays, sitemaps


def robots_mode(status: Column, transport_error: Column) -> Column:
    """What a response for robots.txt means to a traversal: rules, allow or deny."""
    allow = F.coalesce(transport_error, F.lit(False)) | status.isNull()
    return F.when(allow, "allow").when(status.isin(401, 403) | (status >= 500), "deny").when(status >= 400, "allow").otherwise("rules")


_RULE = T.StructType([T.StructField("agent", T.StringType()), T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType())])
_ROBOTS = T.StructType([T.StructField("rules", T.ArrayType(_RULE)), T.StructField("delays", T.MapType(T.StringType(), T.DoubleType())), T.StructField("sitemaps", T.ArrayType(T.StringType()))])


@F.pandas_udf(_ROBOTS)
def robots_rules(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_robots(x or "") for x in text], columns=["rules", "delays", "sitemaps"])


def robots_table(responses: DataFrame) -> DataFrame:
    """(netloc, status, body, failed) to one row of rules per authority."""
    return responses.withColumn("r", robots_rules("body")).select("netloc", robots_mode(F.col("status"), F.col("failed")).alias("mode"), "r.rules", "r.delays", "r.sitemaps")


def allowed_by_robots(pages: DataFrame, robots: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """`pages` with a boolean `robots_ok`: the first rule of the agent's group whose path begins the URL's decides.

    `robots` has one row per authority; it is joined as Spark chooses, since authorities grow with the crawl.
    """
    own = agent.partition("/")[0].lower()
    target = F.concat(F.when(urls.path_of(F.col(url_col)) == "", "/").otherwise(urls.path_of(F.col(url_col))), F.regexp_extract(url_col, r"^[^?#]*(\?[^#]*)", 1))
    named = F.filter("rules", lambda r: (r["agent"] != "*") & F.contains(F.lit(own), r["agent"]))
    first = F.filter("rules", lambda r: r["agent"] == F.get(named, F.lit(0))["agent"])
    group = F.when(F.size(named) > 0, first).otherwise(F.filter("rules", lambda r: r["agent"] == "*"))
    hit = F.get(F.filter(group, lambda r: (r["path"] == "*") | F.startswith(target, r["path"])), F.lit(0))
    verdict = F.when(F.col("mode") == "deny", False).when(F.col("mode") == "allow", True).otherwise(F.coalesce(hit["allow"], F.lit(True)))
    joined = pages.withColumn("netloc", urls.authority(F.col(url_col))).join(robots.select("netloc", "mode", "rules"), "netloc", "left")
    return joined.withColumn("robots_ok", F.coalesce(verdict, F.lit(True))).drop("mode", "rules", "netloc")


def with_delay(requests: DataFrame, delay: float, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """`requests` (url) with `delay`: the seconds between requests of its authority, its own robots' or the given, the longer."""
    rows = requests.withColumn("netloc", urls.authority(F.col("url")))
    own: Column = F.lit(float(delay))
    if robots is not None:
        rows = rows.join(robots.select("netloc", "delays"), "netloc", "left")
        said = F.coalesce(F.try_element_at("delays", F.lit(agent.partition("/")[0].lower())), F.try_element_at("delays", F.lit("*")), F.lit(0.0))
        own = F.greatest(own, said)
    return rows.withColumn("delay", own).drop("netloc", "delays")


def planned_start(requests: DataFrame, delay: float, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """`requests` (url, seq) with `start_s`: seconds by which politeness spaces the requests of one authority."""
    rows = with_delay(requests, delay, robots, agent).withColumn("netloc", urls.authority(F.col("url")))
    turn = F.row_number().over(Window.partitionBy("netloc").orderBy("seq")) - 1
    return rows.withColumn("start_s", turn * F.col("delay")).drop("netloc", "delay")
