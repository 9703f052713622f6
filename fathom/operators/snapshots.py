"""Datasets that survive a build that dies half way.

A snapshot writes everything aside: its tables in a folder of its own, and the
images of the sessions that were built in a partition of its own; sessions that
didn't change keep the files they have. A table of files says which session has
which, with lengths and digests. One rename of a small file makes the snapshot
the current one. What no current snapshot names is never read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import preprocess

#: The tables of a build that a snapshot keeps beside the images.
TABLES = "sessions refused states stats splits labels frames clips counts warnings spec".split()
_FILES = "session string, snapshot string, name string, length long, sha256 string"


def current(spark: SparkSession, path: str) -> dict | None:
    """What the current snapshot says of itself (snapshot, preproc_version); None where there is none."""
    try:
        return json.loads(spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    """(session, snapshot, name, length, sha256) of the image files under folder, whose names hold the first two."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    part = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    return d.select(part("session").alias("session"), part("snapshot").alias("snapshot"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def _files(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{path}/tables/{snapshot}/files")


def commit(built: dict[str, DataFrame], path: str) -> str:
    """Makes the tables of a build the current snapshot under path, a path or URL; the snapshot's name.

    Sessions whose action isn't build keep the files that the current snapshot names for them.
    """
    spark = built["sessions"].sparkSession
    before = current(spark, path)
    name = f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:12]}"
    for table in TABLES:
        built[table].write.parquet(f"{path}/tables/{name}/{table}")
    sessions = spark.read.parquet(f"{path}/tables/{name}/sessions").select(F.col("session").cast("string").alias("session"), "action")
    kept = spark.createDataFrame([], _FILES)
    if before:
        kept = _files(spark, path, before["snapshot"]).join(sessions.where("action <> 'build'"), "session", "left_semi")
    fresh = built["rel"].join(sessions.select("session"), "session", "left_semi").join(kept.select("session").distinct(), "session", "left_anti")
    folder = f"{path}/rel/snapshot={name}"
    # A session's images are in one file or a few, by place.
    fresh.repartition("session").sortWithinPartitions("session", "pos").write.partitionBy("session").parquet(folder)
    made = _digests(spark, folder) if not spark.read.schema("session string, pos int").parquet(folder).isEmpty() else spark.createDataFrame([], _FILES)
    kept.select(*made.columns).unionByName(made).write.parquet(f"{path}/tables/{name}/files")
    _swap(spark, path, json.dumps({"snapshot": name, "preproc_version": preprocess.VERSION}))
    return name


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Writes CURRENT aside and renames it over the one before, at once."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    aside, target = hadoop.Path(f"{path}/CURRENT.{uuid.uuid4().hex}"), hadoop.Path(f"{path}/CURRENT")
    context = hadoop.FileContext.getFileContext(target.toUri(), conf) if "://" in path else hadoop.FileContext.getLocalFSFileContext(conf)
    system = target.getFileSystem(conf) if "://" in path else hadoop.FileSystem.getLocal(conf)
    out = system.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, target, how)


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(session): the sessions of the current snapshot of which a file is missing or differs by a byte."""
    now = current(spark, path)
    if now is None:
        return spark.createDataFrame([], "session string")
    there = _digests(spark, f"{path}/rel").withColumnsRenamed({"length": "_length", "sha256": "_sha256"})
    d = _files(spark, path, now["snapshot"]).join(there, ["session", "snapshot", "name"], "left")
    return d.where(F.col("_length").isNull() | (F.col("_length") != F.col("length")) | (F.col("_sha256") != F.col("sha256"))).select("session").distinct()


def load(spark: SparkSession, path: str, verify: bool = True, strict: bool = True) -> dict[str, DataFrame] | None:
    """The tables of the current snapshot, as build() takes them for an earlier one; None where there is none.

    With verify, all image files are read, and sessions with a broken one are left
    out of sessions, states, stats and rel, so that a build makes them anew. With
    strict, a snapshot of another version of the preprocessing is an error.
    """
    now = current(spark, path)
    if now is None:
        return None
    if strict and now["preproc_version"] != preprocess.VERSION:
        raise ValueError(f"the dataset was built with preprocessing {now['preproc_version']}, this is {preprocess.VERSION}: build it again")
    out = {table: spark.read.parquet(f"{path}/tables/{now['snapshot']}/{table}") for table in TABLES}
    files = _files(spark, path, now["snapshot"]).select("session", "snapshot").distinct()
    rel = spark.read.schema("pos int, rel array<float>, snapshot string, session string").option("basePath", f"{path}/rel").parquet(f"{path}/rel")
    out["rel"] = rel.join(files, ["session", "snapshot"], "left_semi").select("session", "pos", "rel")
    if verify and not (bad := broken(spark, path)).isEmpty():
        for table in ("sessions", "states", "stats", "rel"):
            out[table] = out[table].join(bad, "session", "left_anti")
    return out
