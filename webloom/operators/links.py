"""Pages to links: extraction, resolution, and counts by host."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import html, urls
from webloom.session import small_batches

_LINK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("url", T.StringType())])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, raw): one row per link, in document order."""
    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col), F.posexplode(html.links(F.col(html_col))).alias("pos", "raw"))


@F.pandas_udf(T.ArrayType(_LINK))
def _resolved_exact(base: pd.Series, pos: pd.Series, link: pd.Series, page: pd.Series) -> pd.Series:
    """The one link, or all of a page that only the parser reads, each with the page it names; null without either."""

    def one(base: str | None, pos: float | None, link: str | None, page: str | None) -> list[tuple[int, str, str]] | None:
        if link is None and page is None:
            return None
        found = enumerate(html.links_of(page)) if link is None else [(int(pos), link)]
        return [(k, raw, url) for k, raw in found if (url := urls.resolve(base or "", raw)) is not None]

    return pd.Series([one(*x) for x in zip(base, pos, link, page, strict=True)], dtype=object)


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, pos, raw, url): links that name a page, as its identity.  What cannot be parsed is dropped with the rest.

    Pages that are not plain and links that are not meet one UDF, so that a task has one worker; it sees nulls for the rest.
    """
    small_batches(pages.sparkSession)
    read = pages.select(F.col(id_col), F.col(url_col).alias("base"), F.col(html_col).alias("page"), html.links_fast(F.col(html_col)).alias("fast"))
    found = read.select(id_col, "base", F.when(F.col("fast").isNull(), F.col("page")).alias("page"), F.posexplode_outer("fast").alias("pos", "raw"))
    found = found.where("raw IS NOT NULL OR page IS NOT NULL").withColumn("url", urls.resolve_fast(F.col("base"), F.col("raw")))
    odd = lambda c: F.when(F.col("url").isNull(), F.col(c))
    more = _resolved_exact(odd("base"), odd("pos"), odd("raw"), "page")
    own = F.array(F.struct("pos", "raw", "url"))
    return found.withColumn("more", more).select(id_col, F.inline(F.coalesce("more", own)))


def by_host(links: DataFrame) -> DataFrame:
    """(host, n_links, n_targets, n_pages)."""
    return links.groupBy(urls.authority(F.col("url")).alias("host")).agg(F.count("*").alias("n_links"), F.count_distinct("url").alias("n_targets"), F.count_distinct("page_id").alias("n_pages"))
