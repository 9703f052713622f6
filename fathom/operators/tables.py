"""Helpers for tables whose size decides a join."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join up to this size is broadcast.
BROADCAST_BYTES = 8 << 20


def small(frame: DataFrame, row_bytes: int) -> DataFrame:
    """frame, marked for broadcast if its rows, counted, stay within BROADCAST_BYTES at about row_bytes each."""
    most = BROADCAST_BYTES // max(1, row_bytes)
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """frame, written as Parquet in the shared folder and read back: computed once, kept when executors are lost."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, name: str, *order: str, running: str | None = None, by: str | None = None) -> DataFrame:
    """frame with name: the place of each row in the order, from 0, counted in ranges of it.

    With by, which must lead the order, places count within each value of it. With
    running, that number column becomes its running sum, within each value of by
    too. Rows that agree in the whole order stand in any sequence. Only a count
    per range and value of `by` is summed up in one place.
    """
    keys = [*([by] if by else []), "_part"]
    # Ids of sorted ranges count the range in the upper bits and the row in the lower ones.
    d = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_nth", F.monotonically_increasing_id())
    d = d.withColumns({"_part": F.shiftright("_nth", 33), "_nth": F.col("_nth").bitwiseAND((1 << 33) - 1)})
    if running:
        whole = Window.partitionBy(*keys).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(running, F.sum(running).over(whole))
    d = stored(d, "numbered")
    counts = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"), *([F.max(running).alias("_sum")] if running else []))
    earlier = Window.partitionBy(*keys[:-1]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_sum" if running else "_n").over(earlier), F.lit(0)).alias("_start")
    own = counts.select(*[F.col(k).alias(f"_own_{k}") for k in keys], "_first", start)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys])
    out = d.join(small(own, 32), same)
    gone = ["_part", "_start", "_first", "_nth", *own.columns]
    if running:
        return out.withColumns({running: F.col(running) + F.col("_start"), name: F.col("_nth")}).drop(*gone)
    return out.withColumn(name, (F.col("_nth") - F.col("_first") + F.col("_start")).cast("long")).drop(*gone)
