"""Scans along sessions in segments.

A session's frames are cut by pos into segments of bounded size. Each segment is
reduced to what goes over its end (a count, an open run, a last label, the last
clocks); these carries, of which a session has few, are scanned in order, and
the result is applied to the segment's rows. So no session is one task, whatever
its share of the rows, and rows with gaps in pos count as they follow each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a segment.
SEGMENT = 2048


def cut(frames: DataFrame, size: int | None = None) -> DataFrame:
    """frames with _segment, the part of the session that holds pos."""
    return frames.withColumn("_segment", F.floor(F.col("pos") / (size or SEGMENT)))


def attach(rows: DataFrame, carries: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of carries, one row per keys, which may be null."""
    own = carries.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *[c for c in carries.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys])
    return rows.join(own, same).drop(*[f"_own_{k}" for k in keys])


def ranked(frames: DataFrame, name: str, *keys: str) -> DataFrame:
    """frames with name: the number of rows of the same keys before each, by pos. keys: session, and what else parts its rows."""
    keys = keys or ("session",)
    d = cut(frames)
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carries = d.groupBy(*keys, "_segment").agg(F.count("*").alias("_n"))
    carries = carries.select(*keys, "_segment", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_segment").orderBy("pos")) - 1
    d = attach(d.withColumn(name, nth), carries, *keys, "_segment")
    return d.withColumn(name, F.col(name) + F.col("_before")).drop("_segment", "_before")


def runs(frames: DataFrame) -> DataFrame:
    """Contiguous runs of a label: session, label, start (its first pos), length (its rows).

    The first and the last run of a segment may go on in its neighbours: these two
    a segment are joined along the session, all others are whole already.
    """
    inside = Window.partitionBy("session", "_segment").orderBy("pos")
    d = cut(frames.select("session", "pos", "label"))
    d = d.withColumn("_first", F.row_number().over(inside) == 1)
    d = d.withColumn("_opens", F.col("_first") | ~F.col("label").eqNullSafe(F.lag("label").over(inside)))
    d = d.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(inside))
    d = d.groupBy("session", "_segment", "_run").agg(F.first("label").alias("label"), F.min("pos").alias("start"), F.count("*").alias("length"))
    last = F.max("_run").over(Window.partitionBy("session", "_segment"))
    # What touches a border goes by session, the rest stays in its segment.
    d = d.withColumn("_within", F.when((F.col("_run") > 1) & (F.col("_run") < last), F.col("_segment")))
    along = Window.partitionBy("session", "_within").orderBy("start")
    goes_on = F.col("_within").isNull() & (F.lag("_segment").over(along) < F.col("_segment")) & F.col("label").eqNullSafe(F.lag("label").over(along))
    d = d.withColumn("_opens", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    d = d.withColumn("_island", F.sum("_opens").over(along)).groupBy("session", "_within", "_island")
    return d.agg(F.first("label").alias("label"), F.min("start").alias("start"), F.sum("length").alias("length")).select("session", "label", "start", "length")


def clock_before(frames: DataFrame, name: str, n: int) -> DataFrame:
    """frames with name, the t_ms of the first of the n rows that end with each, and _rows, how many these are."""
    inside = Window.partitionBy("session", "_segment").orderBy("pos")
    d = cut(frames)
    latest = F.slice(F.sort_array(F.collect_list(F.struct("pos", "t_ms")), asc=False), 1, n - 1)
    carries = d.groupBy("session", "_segment").agg(latest.alias("_latest"))
    # A segment at hand has one row at least, so the n - 1 rows before one lie in the n - 1 segments before it.
    before = F.flatten(F.collect_list("_latest").over(Window.partitionBy("session").orderBy("_segment").rowsBetween(-max(1, n - 1), -1)))
    carries = carries.select("session", "_segment", F.slice(F.sort_array(before, asc=False), 1, max(1, n - 1))["t_ms"].alias("_clocks"))
    d = attach(d.withColumn("_nth", F.row_number().over(inside)), carries, "session", "_segment")
    missing = F.least(F.greatest(F.lit(n) - F.col("_nth"), F.lit(0)), F.size("_clocks"))
    own = F.first("t_ms").over(inside.rowsBetween(1 - n, 0))
    d = d.withColumn(name, F.when(missing > 0, F.get("_clocks", missing - 1)).otherwise(own))
    return d.withColumn("_rows", F.least(F.col("_nth"), F.lit(n)) + missing).drop("_segment", "_nth", "_clocks")


#: Seconds of a segment of a log with elapsed times.
SECONDS = 60.0


def carried(both: DataFrame, value: str, *order: str, seconds: float = SECONDS) -> DataFrame:
    """both with value, where null, from the last row of the session before it that has one; by order, whose first column counts seconds."""
    d = both.withColumn("_segment", F.coalesce(F.floor(F.col(order[0]) / seconds), F.lit(-(1 << 62))))
    carries = d.groupBy("session", "_segment").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy("session").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carries = carries.select("session", "_segment", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("session", "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = attach(d.withColumn(value, F.last(value, ignorenulls=True).over(inside)), carries, "session", "_segment")
    return d.withColumn(value, F.coalesce(value, "_before")).drop("_segment", "_before")
