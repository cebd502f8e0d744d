"""The session's shared folder, and results written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that Spark hands to a worker at a time, unless the session says otherwise: texts are long.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker and Spark hold of a partition of texts at a time, where the session has no bound of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; where the session leaves it unset, a folder in the
    warehouse, which they share too."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/webloom-shared")
    return sc._jsc.sc().getCheckpointDir().get()


def numbered(df: DataFrame, *order: str, begin: int = 0, name: str = "seq") -> DataFrame:
    """`df` with a column `name`: begin, begin + 1, ... in order.  Ranges are sorted in parallel, and rows take their
    places in them as they are written; only the counts of the ranges come to the driver, so no task sees all rows."""
    spark = df.sparkSession
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "ranges")
    own, turn = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    rows, at = [], begin
    for key, n in sorted((r[0], r[1]) for r in ranged.groupBy(own).count().collect()):
        rows.append((key, at))
        at += n
    starts = spark.createDataFrame(rows, "__range long, __at long")
    return ranged.withColumn("__range", own).join(F.broadcast(starts), "__range").withColumn(name, F.col("__at") + turn).drop("__range", "__place", "__at")


class Grown:
    """A table in the shared folder to which rows are added, each time as files of their own."""

    def __init__(self, first: DataFrame, name: str) -> None:
        self.spark, self.schema, self.parts = first.sparkSession, first.schema, []
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        self.parts.append(f"{self.path}/part={len(self.parts)}")
        rows.select(*self.schema.names).write.parquet(self.parts[-1])

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors, and runs the plan once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
