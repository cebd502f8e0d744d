"""Sitemaps: every element whose name ends with `loc`, in any namespace, as a page."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.urls import resolve


def locations(content_type: str | None, body: bytes | None, base: str) -> list[str]:
    """Pages that a sitemap names; none of what is no XML.  Entries of an index are pages too, not followed."""
    if "xml" not in (content_type or "") or not body:
        return []
    try:
        elements = ElementTree.fromstring(bytes(body)).iter()
    except ElementTree.ParseError:
        return []
    found = (resolve(base, e.text.strip()) for e in elements if isinstance(e.tag, str) and e.tag.endswith("loc") and e.text)
    return [x for x in found if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def pages_of(content_type: pd.Series, body: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([locations(*x) for x in zip(content_type, body, base, strict=True)], dtype=object)


def links(sitemaps: DataFrame) -> DataFrame:
    """(url): distinct pages of sitemaps (content_type, body, base)."""
    return sitemaps.select(F.explode(pages_of("content_type", "body", "base")).alias("url")).distinct()
