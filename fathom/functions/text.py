"""Scalar functions over texts: names, ranges, clocks. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNLABELED = "unlabeled"


def without_comment(line: Column) -> Column:
    """A line up to its first #, trimmed."""
    return F.trim(F.split_part(line, F.lit("#"), F.lit(1)))


def label_list(lines: DataFrame) -> DataFrame:
    """(nth, label): the labels of lines (nth, value), the first of equals, with unlabeled in front unless it is first already.

    Without any label: unlabeled and neutral. A vocabulary is a short file: one task orders it.
    """
    d = lines.select("nth", without_comment(F.col("value")).alias("label")).where("label <> ''")
    first = d.groupBy("label").agg(F.min("nth").alias("nth"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("nth", "label"))), lambda x: x["label"])
    every = first.agg(found.alias("x"))
    head = F.array(F.lit(UNLABELED))
    named = F.when(F.size("x") == 0, F.array(F.lit(UNLABELED), F.lit("neutral"))).when(F.col("x")[0] == UNLABELED, F.col("x")).otherwise(F.concat(head, "x"))
    return every.select(F.posexplode(named).alias("nth", "label"))


#: A whole number between blanks. Failing casts are dear, so texts are matched first.
_WHOLE = r"[\s\x00-\x1f]*[+-]?[0-9]+[\s\x00-\x1f]*"


def parse_roi(text: Column) -> Column:
    """struct(x, y, side) of "X,Y,SIDE", exactly three whole numbers; null for anything else."""
    likely = text.rlike(f"\\A{_WHOLE},{_WHOLE},{_WHOLE}\\z")
    part = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    whole = (F.size(part) == 3) & ~F.exists(part, lambda x: x.isNull())
    return F.when(likely, F.when(whole, F.struct(part[0].alias("x"), part[1].alias("y"), part[2].alias("side"))))


def parse_range(text: Column) -> Column:
    """struct(start, end) of "START:END"; null for anything else."""
    likely = text.rlike(f"\\A{_WHOLE}:{_WHOLE}\\z")
    part = F.transform(F.split(text, ":"), lambda x: F.trim(x).try_cast("int"))
    whole = (F.size(part) == 2) & ~F.exists(part, lambda x: x.isNull())
    return F.when(likely, F.when(whole, F.struct(part[0].alias("start"), part[1].alias("end"))))


def frame_filename(index: Column) -> Column:
    return F.format_string("depth/depth_%06d.png", index)


def export_name(recording: Column, label: Column, tag: Column, mesh: bool, kind: str) -> Column:
    """recording_[label_]tag_mesh.kind, or points; a null label is left out."""
    return F.concat(F.concat_ws("_", recording, label, tag, F.lit("mesh" if mesh else "points")), F.lit("." + kind))


def frame_tag(index: Column) -> Column:
    return F.format_string("frame%06d", index)


def average_tag(count: Column, first: Column) -> Column:
    return F.format_string("avg%dfrom%06d", count, first)


def iso_ms(unix_s: Column) -> Column:
    """ISO time of the session's zone with milliseconds, cut, not rounded."""
    return F.date_format(F.timestamp_micros(F.floor(unix_s * 1000).cast("long") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def iso_seconds(unix_s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(unix_s)), "yyyy-MM-dd'T'HH:mm:ss")


def frame_times_ms(device_ms: Column, host_s: Column) -> Column:
    """The device's clock in ms, else the host's in s times 1000, else null; both are texts."""
    return F.coalesce(device_ms.try_cast("double"), host_s.try_cast("double") * 1000)
