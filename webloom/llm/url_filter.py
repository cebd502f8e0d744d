"""URL filters: domain and path rules, and a list of canonical URLs behind a blocked Bloom filter.

A blocked Bloom filter keeps all bits of a key in one 256-bit block, a row of four 64-bit words.  It passes possible
hits; an exact hash join with the list removes the false positives among them.  The filter has as many blocks as the
list needs.  Up to `max_blocks` of them are broadcast; a larger filter is joined by block, which only shuffles.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is never listed; a url of any
length is judged whole; of rules of one length that both fit, the one whose text is last in order decides; repeated rows
are judged each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query keys that never identify a page (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without `www.`, path without end slashes, and the query without tracking keys, sorted; null without `://`."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits: its host or a subdomain, and a path that starts with its path."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block in use: block and its four words.  `keys` has one column, key."""
    words = [m.alias(f"m{j}") for j, m in enumerate(_bits("key"))]
    return keys.select(block_of(F.col("key"), n_blocks).alias("block"), *words).groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)])


def _bits(key: str) -> list[Column]:
    # shiftleft's Python form takes a constant count only, so the four bits are set in SQL
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 7), {6 * j}) & 63 as int))") for j in range(4)]


def listed_keys(pages: DataFrame, listed: DataFrame, key_col: str = "key", bits_per_key: int = 16, max_blocks: int = 1 << 15) -> DataFrame:
    """`pages` with a boolean column `listed`: its `key_col` is in `listed` (one column, key).  Null keys are not.

    Blocks are rows of 40 bytes; possible hits go to a hash join with the list.
    """
    keys = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n_blocks = max(1, -(-keys.count() * bits_per_key // 256))
    filters = sized(bloom(keys, n_blocks), n_blocks, 40, 40 * max_blocks)
    fits = [F.col(f"w{j}").bitwiseAND(m) == m for j, m in enumerate(_bits(key_col))]
    probed = pages.withColumn("block", block_of(F.col(key_col), n_blocks)).join(filters, "block", "left")
    maybe = F.coalesce(F.col(key_col).isNotNull() & fits[0] & fits[1] & fits[2] & fits[3], F.lit(False))
    probed = probed.withColumn("maybe", maybe).select(*pages.columns, "maybe")
    hits = probed.where("maybe").drop("maybe")
    exact = hits.join(keys.select(F.col("key").alias("hit")), F.col(key_col) == F.col("hit"), "left").withColumn("listed", F.col("hit").isNotNull()).drop("hit")
    return probed.where(~F.col("maybe")).drop("maybe").withColumn("listed", F.lit(False)).unionByName(exact)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", **bloom_options) -> DataFrame:
    """(id, host, path, rule, verdict): the longest fitting rule's verdict, else block where the canonical URL is listed."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    rows = listed_keys(rows, listed, **bloom_options)
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "key", "listed")
