"""Endpoints, model names and the service graph of a crawl's results."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import html, urls

#: Paths under which services describe themselves (fixed values).
SEED_PATHS = ("/.well-known/ai-plugin.json", "/.well-known/openid-configuration", "/.well-known/security.txt", "/openapi.json", "/swagger.json", "/v1/models", "/health", "/metrics")


def seeds(start_url: str) -> list[str]:
    return [urljoin(start_url, p) for p in SEED_PATHS]


def kind(url: Column, content_type: Column) -> Column:
    """The first test that holds names the endpoint."""
    path, media = F.lower(F.regexp_replace(urls.path_of(url), r";[^/]*$", "")), F.lower(F.coalesce(content_type, F.lit("")))
    ends = lambda *names: F.reduce(F.array(*[path.endswith(n) for n in names]), F.lit(False), lambda a, x: a | x)
    out = F.when(ends("openapi.json", "swagger.json"), "api_schema").when(ends("/v1/models"), "model_catalog").when(ends("/metrics"), "metrics")
    out = out.when(ends("/health"), "health").when(path.startswith("/.well-known/"), "well_known")
    return out.when(media.contains("json"), "json_api").when(media.contains("html"), "web_ui").otherwise("other")


def endpoints(results: DataFrame) -> DataFrame:
    """One row per result, repeats kept."""
    return results.select("url", "status", kind(F.col("url"), F.col("content_type")).alias("type"), "content_type", "error")


def model_names(results: DataFrame, body_col: str = "body") -> DataFrame:
    """Distinct names in the model catalogues among the bodies."""
    return results.select(F.explode(html.models(F.col(body_col))).alias("model")).distinct()


def summary(results: DataFrame) -> DataFrame:
    """One row: model_names sorted, total_endpoints."""
    return results.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))).alias("model_names"), F.count("*").alias("total_endpoints"))


def graph_nodes(results: DataFrame, seq_col: str = "seq") -> DataFrame:
    """(id, kind, status): a host once, an endpoint as its last result has it; where both share an id the endpoint wins
    only if it comes later, as it always does."""
    own = results.select(F.col("url").alias("id"), kind(F.col("url"), F.col("content_type")).alias("kind"), "status", F.col(seq_col).alias("seq"), F.lit(1).alias("rank"))
    hosts = results.select(urls.authority(F.col("url")).alias("id"), F.lit("host").alias("kind"), F.lit(None).cast("int").alias("status"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("rank")).distinct()
    last = Window.partitionBy("id").orderBy(F.desc("rank"), F.desc("seq"))
    return own.unionByName(hosts).withColumn("turn", F.row_number().over(last)).where("turn = 1").select("id", "kind", "status")


def graph_edges(results: DataFrame) -> DataFrame:
    """(from, to, relation), repeats kept; a link's target need not be a node."""
    exposes = results.select(urls.authority(F.col("url")).alias("from"), F.col("url").alias("to"), F.lit("exposes").alias("relation"))
    linked = results.select(F.col("url").alias("from"), F.explode("links").alias("to"), F.lit("links_to").alias("relation"))
    return exposes.unionByName(linked)
