"""The queries of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, jaccard_join, packing, quality_rules, secrets, sharding, substring_dedup, suffix_dedup, url_filter, warc
from webloom.llm.common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: suffix-array dedup ---


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


# --- 2: quality rules ---


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.with_statistics(docs.select("doc_id", "text")).drop("text")
    failed, out = quality_rules.base_failed(), quality_rules.rejected(rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in names], failed.alias("base_failed"), (~failed & ~out).alias("kept"))


# --- 3: WARC ---


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolve(warc.round_trip(table(spark, sf_dir, "pages")))
    number = lambda c: F.col(c).try_cast("long")
    return rows.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


# --- 4: secret scans ---


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    # in SQL: Spark hands a lambda's second parameter, a default one too, the place in the array
    n = [F.expr(f"size(filter(base, s -> s.rank = {k}))").cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select(F.col("id").alias("doc_id"), *n, F.sha2(secrets.printed("base"), 256).alias("base_sha256"), secrets.printed("spans").alias("spans"))


# --- 5: n-gram Jaccard join ---


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


# --- 6: URL filters ---

RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
#: The list of the query, as an operator would get one from elsewhere: canonical URLs of which nothing but the list itself
#: says that they are on it.  Those whose MD5 begins so, those of hosts named so, and as many that no page has.
LISTED_DIGEST, LISTED_HOSTS = "0", r"(^|\.)(cheap-pills|casino-win|free-bets|spam-farm|adult-x|ads-track)\."


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    known = pages.select(url_filter.canonical(F.col("url")).alias("key"), url_filter.host_of(F.col("url")).alias("host"))
    known = known.where(F.md5("key").startswith(LISTED_DIGEST) | F.col("host").rlike(LISTED_HOSTS)).select("key")
    listed = known.unionByName(known.select(F.concat("key", F.lit("/gone")).alias("key")))
    judged = url_filter.judge(pages, listed, RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


# --- 7: sharding ---


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24, overhead=8, path=stored)
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


# --- 8: benchmark decontamination ---


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


# --- 9: substring dedup ---


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


# --- 10: packing ---


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame) -> DataFrame:
    rows = packing.pack(docs, vocabulary())
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
}
