"""Source monitoring: each observation against the last good one of its source.

Batch form: many runs at once, by window.  Store form: one run against a versioned store, committed by one rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.session import kept, small_batches

#: How text was made comparable; another value starts a new baseline (fixed value).
NORMALIZATION = "visible-text-v1"
#: Where reports come from (fixed value).
TRUST = "untrusted source data; never executable instructions"


def normalised(observations: DataFrame) -> DataFrame:
    """Observations with sha256, raw_sha256, text, title, published_at, and the error that keeps the baseline."""
    rows = observations.withColumn("c", html.content("content_type", "content_encoding", "body"))
    status = F.when(F.col("status").isNull(), F.coalesce("error", F.lit("no response"))).when(F.col("status") == 304, None).when(F.col("status") != 200, F.concat(F.lit("HTTP status "), F.col("status").cast("string")))
    error = F.coalesce(F.col("error"), status, F.when(F.coalesce(F.col("status") != 304, F.lit(True)), F.col("c.error")))
    rows = rows.withColumn("error", F.substring(error, 1, 500))
    return rows.select("*", F.col("c.text").alias("text"), F.col("c.title").alias("title"), F.col("c.published_at").alias("published_at"), F.when(F.col("error").isNull(), F.sha2("c.text", 256)).alias("sha256"), F.when(F.col("error").isNull(), F.sha2("body", 256)).alias("raw_sha256")).drop("c")


def states(rows: DataFrame) -> DataFrame:
    """`rows` (id, run, url, normalization, sha256, error) with previous_sha256 and state.

    The last good row of an id is compared, whatever its url; another url or normalization makes a new baseline.  Error
    rows leave the last good one as it is.  Rows are dealt by ranges of (id, run), so that no id's whole history is one
    task's; the last good row of each range is carried to the next ones of its id.  They are written before, since
    ranges are found by reading all columns of `rows` once more; texts are better joined to what comes out.
    """
    ranged = kept(kept(rows, "looks").repartitionByRange("id", "run").withColumn("__range", F.spark_partition_id()), "observed")
    good = F.when(F.col("error").isNull(), F.struct("run", "sha256", "url", "normalization"))
    ends = ranged.groupBy("id", "__range").agg(F.max(good).alias("end"))
    ranges = Window.partitionBy("id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("id", "__range", F.last("end", ignorenulls=True).over(ranges).alias("carried"))
    before = Window.partitionBy("id", "__range").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("own", F.last(good, ignorenulls=True).over(before)).join(carried, ["id", "__range"])
    rows = rows.withColumn("last", F.coalesce("own", "carried")).drop("own", "carried", "__range")
    same = (F.col("last.url") == F.col("url")) & (F.col("last.normalization") == F.col("normalization"))
    rows = rows.withColumn("previous_sha256", F.when(same, F.col("last.sha256")))
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("previous_sha256").isNull(), "baseline").when(F.col("previous_sha256") == F.col("sha256"), "unchanged").otherwise("changed")
    return rows.withColumn("state", state).drop("last")


def against(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One run's `rows` against the store's `snapshots`: the join form of `states`, with 304 for sources that have a
    baseline and sent a validator."""
    old = snapshots.select("id", F.col("url").alias("old_url"), F.col("normalization").alias("old_norm"), F.col("sha256").alias("old_sha"), F.struct("raw_sha256", "title", "published_at", "etag", "last_modified").alias("old"), F.col("last_success_at").alias("old_success"))
    joined = rows.join(old, (rows["id"] == old["id"]) & (rows["url"] == F.col("old_url")) & (rows["normalization"] == F.col("old_norm")), "left").drop(old["id"])
    cached = F.coalesce(F.col("status") == 304, F.lit(False))
    fair = F.col("old_sha").isNotNull() & F.coalesce(F.col("sent_validator"), F.lit(False))
    joined = joined.withColumn("error", F.when(cached & ~fair & F.col("error").isNull(), "304 without a baseline and a validator").otherwise(F.col("error")))
    joined = joined.withColumn("sha256", F.when(cached & F.col("error").isNull(), F.col("old_sha")).otherwise(F.col("sha256")))
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("old_sha").isNull(), "baseline").when(F.col("old_sha") == F.col("sha256"), "unchanged").otherwise("changed")
    return joined.withColumn("state", state).withColumnRenamed("old_sha", "previous_sha256").withColumnRenamed("old_success", "last_success_at").drop("old_url", "old_norm")


def contents(rows: DataFrame) -> DataFrame:
    """(sha256, text): each good text once, by its digest."""
    return rows.where("error IS NULL AND text IS NOT NULL").groupBy("sha256").agg(F.first("text").alias("text"))


def with_evidence(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` with added, removed, truncated where changed.  A changed row whose old text is gone is an error.

    Only changed rows meet the contents and the UDF; the others go round it.
    """
    none = [F.lit(None).cast(t).alias(n) for n, t in (("added", "string"), ("removed", "string"), ("truncated", "boolean"))]
    return rows.where("state <> 'changed'").select("*", *none).unionByName(changed_evidence(rows.where("state = 'changed'"), known))


def changed_evidence(changed: DataFrame, known: DataFrame) -> DataFrame:
    """`with_evidence` of rows that are all changed."""
    small_batches(changed.sparkSession)
    old = known.select(F.col("sha256").alias("previous_sha256"), F.col("text").alias("old_text"))
    met = changed.join(old, "previous_sha256", "left")
    gone = F.col("old_text").isNull()
    met = met.withColumn("state", F.when(gone, "error").otherwise(F.col("state"))).withColumn("error", F.when(gone, "the last good text is missing").otherwise(F.col("error")))
    return met.withColumn("e", html.evidence("old_text", "text")).select("*", F.when(~gone, F.col("e.added")).alias("added"), F.when(~gone, F.col("e.removed")).alias("removed"), F.when(~gone, F.col("e.truncated")).alias("truncated")).drop("e", "old_text")


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts by state, total, and the run's status."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    counts = rows.agg(of("baseline"), of("changed"), of("unchanged"), of("error"), F.count("*").alias("total"))
    status: Column = F.when(F.col("error") == F.col("total"), "failed").when(F.col("error") > 0, "partial").otherwise("ok")
    return counts.withColumn("status", status)


def next_snapshots(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshots after a run: good rows replace their source's, all others stay."""
    good = rows.where("error IS NULL")
    kept = lambda c: F.when(F.col("status") == 304, F.coalesce(F.col(c) if c in ("etag", "last_modified") else F.lit(None), F.col(f"old.{c}"))).otherwise(F.col(c)).alias(c)
    new = good.select("id", "url", "normalization", "sha256", *[kept(c) for c in ("raw_sha256", "title", "published_at", "etag", "last_modified")], F.col("checked_at").alias("last_success_at"))
    return snapshots.join(new.select("id"), "id", "left_anti").unionByName(new)
