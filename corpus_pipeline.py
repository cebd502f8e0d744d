"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Quality rules reject documents; the Jaccard join keeps one of each class of near-duplicates; decontamination drops
documents that hold benchmark items; the secret scan masks what it finds in the texts; packing deals the token pieces of
all texts into sequences.  A stage's result is written as Parquet to the shared folder and read as the next one's docs.

Defined results of the stages: a null or empty text fails the base rules, and so leaves in the first stage; alone, the
later stages keep it.  Rows of a null id are judged like others, link with nothing and are never merged.  Rows that repeat
an id share its fate in the second stage, and are judged each in the others.  Without labels only the base rules reject;
without a benchmark nothing is contaminated; an empty table gives an empty table.  Texts of any length are read whole.  All
but the last stage return the columns they were given, whatever else these are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, jaccard_join, packing, quality_rules, secrets
from webloom.llm.common import stage
from webloom.llm.queries import packed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base checks nor the learned rules reject."""
    rules, name = quality_rules.fit(docs, table(spark, sf_dir, "labels")), "__stats"
    while name in docs.columns:
        name += "_"
    judged = quality_rules.with_statistics(docs, name=name)
    return judged.where(~quality_rules.base_failed(name) & ~quality_rules.rejected(rules, name)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked, and n_chars as the texts are now."""
    masked = secrets.redact(docs)
    count = F.length("text").cast(masked.schema["n_chars"].dataType) if "n_chars" in masked.columns else None
    return masked if count is None else masked.withColumn("n_chars", F.coalesce(count, F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, with sequence and offset."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret masking", mask_secrets),
    ("packing", pack),
]

#: Learning, tokens and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
