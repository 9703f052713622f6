"""The recording sink: a stream of depth images becomes recordings that `recordings` reads.

An image is written before its row is logged, and a row is logged only if its
image was written. Each micro-batch logs into a part of its own, named by its
id, so a batch that is repeated replaces itself. finish() makes the files of a
recording from all parts, at the end or at any time before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import UNLABELED, frame_filename, iso_ms
from fathom.operators.frames import capture_counts
from fathom.sources.png import encode_png16
from fathom.sources.recordings import LOG, write_files

#: What a frame of the stream holds. Times are in ms of the device and in s of the host.
FRAME = "session string, frame_index int, h int, w int, depth array<int>, device_timestamp_ms double, host_time_unix double, label string, trial_id int"
#: Images that are encoded at a time.
AT_ONCE = 16


def save_images(frames: DataFrame, root: str) -> DataFrame:
    """frames without their images, with filename and status: saved, or failed where an image can't be encoded or written.

    A frame without pixels, or whose pixels aren't h x w numbers of 16 bits, fails; the others go on.
    """
    d = frames.select(*[c for c in frames.columns if c not in ("depth", "h", "w")], frame_filename(F.col("frame_index")).alias("filename"), "h", "w", "depth")
    rest = d.columns[:-3]
    schema = d.select(*rest, F.lit("").alias("status")).schema
    session, name = rest.index("session"), rest.index("filename")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made: set[str] = set()

        def save(path: str, h: int, w: int, values: pa.ListScalar) -> str:
            aside = f"{path}.{uuid.uuid4().hex}.part"
            try:
                data = encode_png16(values.values.to_numpy(zero_copy_only=False).reshape(h, w))
                if (parent := path.rsplit("/", 1)[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(aside) as out:
                    out.write(data)
                system.move(aside, path)
            except (OSError, ValueError, TypeError, AttributeError):
                return "failed"
            return "saved"

        for batch in batches:
            for lo in range(0, len(batch), AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                keys = zip(part.column(session).to_pylist(), part.column(name).to_pylist(), part.column(len(rest)).to_pylist(), part.column(len(rest) + 1).to_pylist(), part.column(len(rest) + 2), strict=True)
                status = [save(f"{folder}/{s}/{f}", h, w, v) if f is not None and v.is_valid else "failed" for s, f, h, w, v in keys]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(status, pa.string())], names=schema.names)

    return d.mapInArrow(run, schema)


def sink(root: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch() that records frames (FRAME) under root, a path or URL that executors can write to."""

    def record(batch: DataFrame, batch_id: int) -> None:
        save_images(batch, root).write.mode("overwrite").parquet(f"{root}/_log/batch={batch_id}")

    return record


def record(stream: DataFrame, root: str, checkpoint: str) -> object:
    """Starts recording all that stream has; see sink()."""
    return stream.writeStream.foreachBatch(sink(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all parts, a row of each frame of a session: of those logged twice a saved one, then the first."""
    d = spark.read.parquet(f"{root}/_log")
    first = F.min_by(F.struct(*[c for c in d.columns if c not in ("session", "frame_index")]), F.struct(F.col("status") != "saved", F.col("batch")))
    return d.groupBy("session", "frame_index").agg(first.alias("_r")).select("session", "frame_index", "_r.*")


def finish(spark: SparkSession, root: str, meta: dict[str, object] | None = None) -> int:
    """Writes frame_timestamps.csv and metadata.json of every session recorded under root; the number of sessions.

    The log holds saved frames only, by their index. The metadata count saved and
    failed frames, and saved ones by label, and give their rate; meta adds fields to all.
    """
    d = logged(spark, root).withColumns({"label": F.coalesce(F.nullif("label", F.lit("")), F.lit(UNLABELED)), "t_ms": F.col("host_time_unix") * 1000})
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LOG if c != "host_time_iso"}
    text["host_time_iso"] = F.coalesce(iso_ms(F.col("host_time_unix")), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text["label"], F.lit('"'), F.lit('""')), F.lit('"'))
    text["label"] = F.when(text["label"].rlike('[",\r\n]'), quoted).otherwise(text["label"])
    line = F.concat_ws(",", *[text[c] for c in LOG])
    saved = d.where("status = 'saved'").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("frame_index", line.alias("line")))).alias("rows"))
    head = ",".join(LOG)
    body = F.concat(F.array_join(F.concat(F.array(F.lit(head)), F.col("rows.line")), "\n"), F.lit("\n"))
    log = saved.select(F.concat("session", F.lit("/frame_timestamps.csv")).alias("name"), body.alias("content"))
    counts = capture_counts(d.withColumn("pos", F.col("frame_index")))
    given = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    facts = F.to_json(F.struct(*given, F.coalesce("label_frames", F.create_map().cast("map<string,bigint>")).alias("label_frame_counts"), F.col("saved").alias("frames_saved"), F.lit(0).alias("frames_dropped"), F.col("failed").alias("frames_failed_to_write"), F.col("effective_fps")))
    write_files(log, "name", "content", root)
    return write_files(counts.select(F.concat("session", F.lit("/metadata.json")).alias("name"), facts.alias("content")), "name", "content", root)
