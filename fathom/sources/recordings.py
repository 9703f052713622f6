"""Recordings on disk: a folder per session with metadata.json, a log of frames and 16-bit depth images; geometry files out."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import label_list
from fathom.operators.depth import column_of
from fathom.operators.tables import small
from fathom.sources.png import decode_many

#: Images that are decoded together.
DECODED = 32

#: Columns of a frame log, by name; their order in the file doesn't matter, and label and trial_id may be absent.
LOG = "frame_index filename device_timestamp_ms host_time_unix host_time_iso label trial_id".split()
NEEDED = LOG[:2]

#: The fields of metadata.json that the operators use; others are kept out, absent ones are null.
META = (
    "program string, format_version int, labels array<string>, label_frame_counts map<string,bigint>, start_time string, end_time string, duration_seconds double,"
    " frames_saved bigint, frames_dropped bigint, frames_failed_to_write bigint, effective_fps double, writer_error string,"
    " camera struct<device:string,serial_number:string,stream:struct<width:int,height:int,fps:int,depth_format:string>,depth_scale_m_per_unit:double,"
    "depth_intrinsics:struct<width:int,height:int,fx:double,fy:double,ppx:double,ppy:double,model:string,coeffs:array<double>,note:string>>"
)


def _session(path: str):
    return F.regexp_extract(path, "([^/]+)/(?:depth/)?[^/]+$", 1)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session, path, modified) of the folders with a metadata.json, by name; none at all is an error."""
    try:
        d = spark.read.format("binaryFile").load(f"{root}/*/metadata.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no recordings found in {root}") from error
    d = d.select(_session("path").alias("session"), F.regexp_replace("path", "/metadata.json$", "").alias("path"), F.col("modificationTime").alias("modified"))
    return d.orderBy("session")


def newest_recording(spark: SparkSession, root: str) -> str:
    """The name of the recording that changed last, the later name of equals."""
    return sessions(spark, root).agg(F.max_by("session", F.struct("modified", "session"))).first()[0]


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """session, the fields of META, fps (30 where absent or 0) and depth_scale (0.0001 where absent); files that aren't JSON give no row."""
    d = spark.read.schema(META).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/metadata.json")
    fps = F.coalesce(F.nullif(F.col("camera.stream.fps"), F.lit(0)), F.lit(30)).cast("double")
    scale = F.coalesce("camera.depth_scale_m_per_unit", F.lit(0.0001))
    return d.select(_session("_metadata.file_path").alias("session"), "*", fps.alias("fps"), scale.alias("depth_scale"))


def frame_log(spark: SparkSession, root: str) -> DataFrame:
    """A row per logged frame: session, pos (its place in the log), the columns of LOG and trial.

    Columns go by the names in each file's header. An empty or absent label is
    unlabeled, an empty or absent trial_id 0, absent clocks are empty. A log
    without frame_index or filename is an error. A log is read by one task.
    """
    d = spark.read.text(f"{root}/*/frame_timestamps.csv", wholetext=True)
    d = d.select(_session("_metadata.file_path").alias("session"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = csv.DictReader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
                if not set(NEEDED) <= set(rows.fieldnames or ()):
                    raise ValueError(f"the log of {name} lacks one of {NEEDED}")
                every = list(rows)
                columns = [pa.array([name] * len(every), pa.string()), pa.array(np.arange(len(every), dtype=np.int32))]
                columns += [pa.array([r.get(c) or "" for r in every], pa.string()) for c in LOG]
                yield pa.RecordBatch.from_arrays(columns, names=["session", "pos", *LOG])

    d = d.mapInArrow(run, "session string, pos int, " + ", ".join(f"{c} string" for c in LOG))
    trial = F.coalesce(F.nullif("trial_id", F.lit("")).cast("int"), F.lit(0))
    label = F.coalesce(F.nullif("label", F.lit("")), F.lit("unlabeled"))
    return d.withColumns({"frame_index": F.col("frame_index").cast("int"), "label": label, "trial_id": trial, "trial": trial})


def complete_sessions(log: DataFrame, meta: DataFrame) -> DataFrame:
    """The rows of log whose session has metadata, with its fps and depth_scale."""
    return log.join(small(meta.select("session", "fps", "depth_scale"), 64), "session")


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """session, elapsed_s, frame_index, kind and value of every logged event."""
    d = spark.read.csv(f"{root}/*/events.csv", header=True, schema="elapsed_s double, frame_index int, kind string, value string", enforceSchema=False)
    return d.withColumn("session", _session("_metadata.file_path"))


def label_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(nth, label) of a vocabulary file; see label_list(). A missing file gives the least vocabulary."""
    try:
        d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("nth", "value"))
        return label_list(d)
    except AnalysisException:
        return label_list(spark.createDataFrame([], "nth int, value string"))


def previous_splits(spark: SparkSession, path: str) -> DataFrame:
    """(session, split) of the spec that an earlier build wrote; none where it is missing or isn't JSON."""
    try:
        d = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "session string, split string")
    parsed = F.from_json("value", "sessions map<string,struct<split:string>>")["sessions"]
    return d.select(F.explode(parsed).alias("session", "info")).select("session", "info.split")


def depth_frames(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(session, filename, h, w, depth) of every depth image; h, w and depth are null where it can't be read.

    With wanted (session, and filename where it has one), only those are decoded.
    """
    d = spark.read.format("binaryFile").load(f"{root}/*/depth/*.png")
    d = d.select(_session("path").alias("session"), F.concat(F.lit("depth/"), F.element_at(F.split("path", "/"), -1)).alias("filename"), "content")
    if wanted is not None:
        keys = [c for c in ("session", "filename") if c in wanted.columns]
        d = d.join(small(wanted.select(*keys), 96), keys, "left_semi").select("session", "filename", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), DECODED):
                part = batch.slice(lo, DECODED)
                made = decode_many(part.column(2).to_pylist())
                sides = [pa.array([None if x is None else x.shape[k] for x in made], pa.int32()) for k in (0, 1)]
                depth = column_of([None if x is None else x.ravel() for x in made], "array<int>")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sides, depth], names=["session", "filename", "h", "w", "depth"])

    return d.mapInArrow(run, "session string, filename string, h int, w int, depth array<int>")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path there; Spark's own folders are named file:/path."""
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    system, root = fs.FileSystem.from_uri(folder)
    return system, root.rstrip("/")


def write_files(rows: DataFrame, name: str, content: str, folder: str) -> int:
    """One file per row under folder, a path or URL that executors can write to; name is its name, content its text or bytes.

    A file is written aside first and then moved, so a task that is repeated
    leaves whole files only. Returns the number of files.
    """
    d = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for batch in batches:
            for k in range(len(batch)):
                path = f"{root}/{batch.column(0)[k].as_py()}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                aside = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(aside) as out:
                    out.write(batch.column(1)[k].as_py() or b"")
                system.move(aside, path)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return d.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """path, vertices and faces of every PLY file of a path or pattern; both null where a file isn't one."""
    from fathom.operators.export import parse_ply

    d = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"])), pa.list_(pa.struct([(f"i{k}", pa.int32()) for k in range(3)]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                try:
                    found = [x.tolist() for x in parse_ply(batch.column(1)[k].as_py())]
                except (ValueError, KeyError, IndexError):
                    found = [None, None]
                rows = [None if f is None else [dict(zip(names, x, strict=True)) for x in f] for f, names in zip(found, (("x", "y", "z"), ("i0", "i1", "i2")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([r], kind) for r, kind in zip(rows, kinds, strict=True))], names=["path", "vertices", "faces"])

    return d.mapInArrow(run, "path string, vertices array<struct<x:double,y:double,z:double>>, faces array<struct<i0:int,i1:int,i2:int>>")
