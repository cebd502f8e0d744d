"""The manifest of monitored sources: read strictly, validated on the driver (25 rows at most)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.urls import source_identity

MAX_SOURCES = 25
#: Fields of a manifest and of a source, and whether each must be there.
MANIFEST = {"schema_version": True, "sources": True}
SOURCE = {"id": True, "url": True, "label": False}
_ID = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}")


@dataclass(frozen=True)
class Source:
    id: str
    url: str
    label: str = ""


def faults_of(id: object, url: object, label: object) -> tuple[str | None, list[str]]:
    """(resource, faults) of one source, whether it stands in a file or in a table; no resource where the URL is at fault."""
    said = []
    if not (isinstance(id, str) and _ID.fullmatch(id)):
        said.append("id: 1 to 64 letters, digits, underscores or hyphens, of which the first is a letter or digit")
    if not (isinstance(label, str) and len(label) <= 200):
        said.append("label: a string of 200 characters at most")
    try:
        return source_identity(url), said
    except ValueError as error:
        return None, [*said, f"url: {error}"]


def _fields(value: object, known: dict[str, bool], what: str) -> dict:
    """The value, if it is an object with all the fields that must be there and no unknown one."""
    held = set(value) if isinstance(value, dict) else {None}
    if held - set(known) or {k for k, must in known.items() if must} - held:
        raise ValueError(f"{what} is an object of {', '.join(known)}")
    return value


def validated(sources: list[Source]) -> list[Source]:
    """The sources under their identities; raises ValueError for what may not be monitored."""
    if len(sources) not in range(1, MAX_SOURCES + 1):
        raise ValueError(f"a manifest has 1 to {MAX_SOURCES} sources")
    judged = [(s, *faults_of(s.id, s.url, s.label)) if isinstance(s, Source) else (s, None, ["not a source"]) for s in sources]
    said = [fault for _, _, faults in judged for fault in faults]
    said += [f"{name} is not unique" for name, of in (("id", lambda j: j[0].id), ("url", lambda j: j[1])) if not said and len(set(map(of, judged))) < len(judged)]
    if said:
        raise ValueError(said[0])
    return [replace(s, url=url) for s, url, _ in judged]


def load(path: str | Path) -> list[Source]:
    data = _fields(json.loads(Path(path).read_text(encoding="utf-8")), MANIFEST, "a manifest")
    if data["schema_version"] is True or data["schema_version"] != 1 or isinstance(data["schema_version"], float):
        raise ValueError("schema_version: only 1 is read")
    if not isinstance(data["sources"], list):
        raise ValueError("sources: a list")
    return validated([Source(**_fields(item, SOURCE, "a source")) for item in data["sources"]])


def frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(id, url, label, ord); a source without a label is called by its id."""
    rows = spark.createDataFrame([(s.id, s.url, s.label, k) for k, s in enumerate(sources)], "id string, url string, label string, ord int")
    return rows.withColumn("label", F.when(F.col("label") == "", F.col("id")).otherwise(F.col("label")))


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("faults", T.ArrayType(T.StringType()))]))
def _judged(id: pd.Series, url: pd.Series, label: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([faults_of(*x) for x in zip(id, url, label, strict=True)], columns=["url", "faults"])


def faults(sources: DataFrame) -> DataFrame:
    """(id, fault) of a manifest of any size held as a table (id, url, label); a null label is none."""
    rows = sources.select("id", _judged("id", "url", F.coalesce("label", F.lit(""))).alias("j"))
    own = rows.select("id", F.explode("j.faults").alias("fault"))
    for name, key in (("id", F.col("id")), ("url", F.col("j.url"))):
        again = rows.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1")
        own = own.unionByName(again.select("id", F.lit(f"{name} is not unique").alias("fault")))
    return own
