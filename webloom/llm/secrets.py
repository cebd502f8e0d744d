"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns report on their own.  Weak parts (upper-case identifiers, mixed tokens, endpoints) are too common to
report alone: an interval join within a scope of `SCOPE` code points reports an identifier only near a secret, a secret
only near an identifier, and an endpoint only near both.  Parts meet in cells of one scope's length, so a cell holds a
bounded number of them and no pair of far parts is formed.

Spans count code points, end exclusive.  Defined results: a null text is empty and has no spans; spans that start together
are ordered by kind, then end; repeated rows get the same spans each; a text of any length is scanned whole; empty tables
give empty results; other columns pass through `redact` untouched and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import sized, stage

#: The base patterns (fixed values).  A match of the last two below its least length is no match of the shorter form.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The weak parts.
WEAK_ID = r"[A-Z0-9]{16,}"
WEAK_SECRET = r"[A-Za-z0-9+/_=-]{32,}"
ENDPOINT = r"(?:https?|s3|ftp|wss?|postgres|mysql|redis|mongodb|amqp)://[^\x20\x09-\x0D\"'<>]+"
#: Kinds in the order in which equal starts sort.
KINDS = ("assign", "access", "hex", "key_id", "key_secret", "endpoint")
SPAN = "array<struct<start:int,rank:int,end:int>>"
SCOPE = 256


def _matches(text: str, pattern: str, rank: int, holds: str = "true", group: str = "x.m") -> str:
    """SQL for the spans of a pattern's matches: what a split leaves between them gives their places.

    `holds` tests x.m, the match, and x.g, the group that `group` names.
    """
    rx = "r'" + pattern.replace("'", r"\x27") + "'"
    found = f"regexp_extract_all({text}, {rx}, 0)"
    groups = f"regexp_extract_all({text}, {rx}, 1)" if group == "x.g" else found
    walk = f"""aggregate(transform(arrays_zip({found}, {groups}, slice(split({text}, {rx}, -1), 1, size({found}))), z -> named_struct('m', z.`0`, 'g', z.`1`, 'gap', z.`2`)),
      named_struct('at', 0, 'out', cast(array() AS {SPAN})),
      (s, x) -> named_struct('at', s.at + length(x.gap) + length(x.m), 'out',
        if({holds}, concat(s.out, array(named_struct('start', s.at + length(x.gap), 'rank', {rank}, 'end', s.at + length(x.gap) + length(x.m)))), s.out)),
      s -> s.out)"""
    return f"if({text} rlike {rx}, {walk}, cast(array() AS {SPAN}))"


def base_spans(text: str) -> Column:
    parts = [_matches(text, ASSIGN, 0, "length(x.g) >= 6", "x.g"), _matches(text, ACCESS, 1), _matches(text, HEX, 2)]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def weak_spans(text: str) -> Column:
    mixed = "length(x.m) <= 128 AND x.m rlike '[0-9]' AND x.m rlike '[A-Z]' AND x.m rlike '[a-z]'"
    parts = [_matches(text, WEAK_ID, 3, "length(x.m) <= 32 AND x.m rlike '[0-9]' AND x.m rlike '[A-Z]'"), _matches(text, WEAK_SECRET, 4, mixed), _matches(text, ENDPOINT, 5)]
    return F.expr(f"concat({', '.join(parts)})")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """k1 and k2 stand for (id, text): equal rows have equal spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(F.col(id_col), text).alias("__k1"), F.xxhash64(text, F.lit(1)).alias("__k2"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(__k1, __k2, __linked): the weak spans that complementary parts confirm, for the documents that have some."""
    rows = _keyed(docs, id_col, text_col).where(F.expr(f"__text rlike r'{WEAK_ID}' OR __text rlike r'{WEAK_SECRET}'"))
    rows = rows.select("__k1", "__k2", base_spans("__text").alias("base"), weak_spans("__text").alias("weak"))
    rows = rows.where(F.size("weak") > 0).dropDuplicates(["__k1", "__k2"])
    free = F.expr("filter(weak, w -> not exists(base, b -> b.start < w.end AND w.start < b.end))")
    parts = rows.withColumn("weak", free).select("__k1", "__k2", F.explode(F.concat("base", "weak")).alias("s")).select("__k1", "__k2", "s.start", "s.rank", "s.end")
    role = F.when(F.col("rank").isin(1, 3), "id").when(F.col("rank").isin(0, 2, 4), "secret")
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope).cast("int"), F.floor(hi / scope).cast("int")))
    anchors = parts.where(role.isNotNull()).select("__k1", "__k2", role.alias("role"), F.col("start").alias("a0"), F.col("end").alias("a1"), cells(F.col("start"), F.col("end")).alias("cell"))
    probes = parts.where(F.col("rank") >= 3).select("__k1", "__k2", "start", "rank", "end", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("cell"))
    near = (F.col("a0") <= F.col("end") + scope) & (F.col("a1") >= F.col("start") - scope) & ((F.col("a0") != F.col("start")) | (F.col("a1") != F.col("end")))
    met = probes.join(anchors, ["__k1", "__k2", "cell"]).where(near).groupBy("__k1", "__k2", "start", "rank", "end").agg(F.bool_or(F.col("role") == "id").alias("by_id"), F.bool_or(F.col("role") == "secret").alias("by_secret"))
    kept = met.where(F.when(F.col("rank") == 3, F.col("by_secret")).when(F.col("rank") == 4, F.col("by_id")).otherwise(F.col("by_id") & F.col("by_secret")))
    return kept.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).cast(SPAN).alias("__linked"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, scope: int, *more: Column) -> DataFrame:
    extra = stage(linked(docs, id_col, text_col, scope), "linked")
    rows = _keyed(docs, id_col, text_col, *more).withColumn("__base", base_spans("__text"))
    return rows.join(sized(extra, extra.count(), 400), ["__k1", "__k2"], "left").withColumn("__all", F.expr(f"array_sort(concat(__base, coalesce(__linked, cast(array() AS {SPAN}))))"))


def printed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({kinds}[s.rank], ':', s.start, ':', s.end)), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, spans): base spans, and all spans, each sorted by start and kind."""
    return _with_spans(docs, id_col, text_col, scope).select(F.col("__id").alias("id"), F.col("__base").alias("base"), F.col("__all").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each span of its text, overlapping ones as one, replaced by `mark`."""
    rows = _with_spans(docs, id_col, text_col, scope, *[F.col(c) for c in docs.columns])
    walk = f"""aggregate(__all, named_struct('at', 0, 'out', ''),
      (s, x) -> named_struct('at', greatest(s.at, x.end), 'out',
        if(x.start >= s.at, concat(s.out, substring(__text, s.at + 1, x.start - s.at), '{mark}'), s.out)),
      s -> concat(s.out, substring(__text, s.at + 1)))"""
    text = F.expr(f"if(size(__all) = 0, `{text_col}`, {walk})")
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
