"""Small Spark helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared")
    return context.getCheckpointDir()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """frame, written as a Parquet table in the shared folder and read back; for tables that grow with the input."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        folders = {path.rsplit("/", 1)[0] for path in table.inputFiles()}
        for folder in folders:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a column that a Python worker turns into arrays at a time.
PART_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """batches, cut so that the texts or bytes of a column make up about limit at most, one row at least.

    Spark bounds a batch by its rows only; this bounds what a worker makes of it.
    """
    for batch in batches:
        if not len(batch):
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        block = (np.cumsum(sizes) - sizes) // limit
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(batch))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield batch.slice(lo, hi - lo)


#: A side of a join up to this size is broadcast.
BROADCAST_BYTES = 8 << 20


def sized(frame: DataFrame, row_bytes: int) -> DataFrame:
    """frame, a stored table, marked for broadcast if its rows of about row_bytes stay within BROADCAST_BYTES."""
    return F.broadcast(frame) if frame.count() * row_bytes <= BROADCAST_BYTES else frame


def text_key(text: object) -> object:
    """128 bits that stand for a text, as bytes; a null text is an empty one.

    The last coalesce only tells Spark that a key is never null: no filter for that parts plans that are alike.
    """
    return F.coalesce(F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(b""))


def fresh(frame: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of frame's."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
