"""PLY files as a data source: spark.read.format("ply") and write.format("ply"), after register()."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from fathom.operators.export import parse_ply, ply_bytes
from fathom.sources.recordings import opened

#: Bytes of files that one task reads, about.
PARTITION_BYTES = 64 << 20
#: Bytes of files, and files, of a batch at most, but for one file over it.
BATCH_BYTES, BATCH_FILES = 4 << 20, 1024
#: Files that the commit moves at a time.
MOVES = 16

VERTICES = "vertices array<struct<x:double,y:double,z:double>>"
FACES = "faces array<struct<i0:int,i1:int,i2:int>>"
_KINDS = [pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"])), pa.list_(pa.struct([(f"i{k}", pa.int32()) for k in range(3)]))]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


class PlySource(DataSource):
    """Reads path, vertices and faces of each .ply file of a folder and its subfolders, path being relative to the folder.

    With option sequence, also nth, the place of a file's name in its own folder,
    from 0. A file that can't be read has nulls, or with option failFast fails the
    query. Files still being written aren't seen.

    Writes a file per row: column name is the file's, with subfolders if it has
    any; its content are the bytes of a column ply, or else the columns vertices,
    faces and normals, the last two if they are there; option binary (true) tells
    the kind. All files appear at the commit, or none: a row without a usable name,
    a name twice, or in append mode one that is there already, fails the whole
    write. In overwrite mode the .ply files that were there before go.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def flag(self, name: str, default: bool = False) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("format ply needs a path")
        return self.options["path"]

    def schema(self) -> str:
        return f"path string, {'nth int, ' if self.flag('sequence') else ''}{VERTICES}, {FACES}"

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.folder(), self.flag("sequence"), self.flag("failFast"), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        missing = [] if "ply" in schema.names else [c for c in ("vertices",) if c not in schema.names]
        if "name" not in schema.names or missing:
            raise ValueError(f"format ply writes columns name and ply, or name and vertices; there are {schema.names}")
        return PlyWriter(self.folder(), self.flag("binary", True), overwrite)


@dataclass
class Files(InputPartition):
    """(path, place in its folder) of each file of a task."""

    files: list[tuple[str, int]]


class PlyReader(DataSourceReader):
    def __init__(self, folder: str, sequence: bool, fail_fast: bool, partition_bytes: int) -> None:
        self.folder, self.sequence, self.fail_fast, self.partition_bytes = folder, sequence, fail_fast, partition_bytes

    def partitions(self) -> list[Files]:
        """Tasks of files up to partition_bytes together, one file at least; only names and sizes are listed here."""
        system, root = opened(self.folder)
        out, room, places = [], 0, {}
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            path = info.path[len(root) + 1 :]
            if info.type != fs.FileType.File or not path.endswith(".ply") or path.startswith("_"):
                continue
            folder = path.rpartition("/")[0]
            places[folder] = places.get(folder, -1) + 1
            if not out or room < info.size:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].files.append((path, places[folder]))
            room -= info.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.folder)
        rows, held = [], 0
        for path, nth in partition.files:
            with system.open_input_stream(f"{root}/{path}") as file:
                data = file.read()
            try:
                found = parse_ply(data)
            except (ValueError, KeyError, IndexError, OverflowError) as error:
                if self.fail_fast:
                    raise ValueError(f"no PLY file: {path}") from error
                found = (None, None)
            rows.append((path, nth, *found))
            held += len(data)
            if held >= BATCH_BYTES or len(rows) == BATCH_FILES:
                yield self.batch_of(rows)
                rows, held = [], 0
        if rows:
            yield self.batch_of(rows)

    def batch_of(self, rows: list[tuple]) -> pa.RecordBatch:
        paths, places, *tables = zip(*rows, strict=True)
        columns = {"path": pa.array(paths)} | ({"nth": pa.array(places, pa.int32())} if self.sequence else {})
        for name, kind, values in zip(("vertices", "faces"), _KINDS, tables, strict=True):
            fields = kind.value_type
            whole = np.concatenate([np.zeros((0, 3), fields.field(0).type.to_pandas_dtype()), *[v for v in values if v is not None]])
            parts = [pa.array(np.ascontiguousarray(whole[:, k])) for k in range(3)]
            ends = pa.array(np.cumsum([0, *(0 if v is None else len(v) for v in values)]), pa.int32())
            missing = pa.array([v is None for v in values])
            columns[name] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, [f.name for f in fields]), mask=missing)
        return pa.RecordBatch.from_pydict(columns)


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task's files, and their names."""

    folder: str
    names: list[str]


class PlyWriter(DataSourceArrowWriter):
    """Tasks write into folders of their own below _staging; the commit moves the files of the attempts that count.

    What a lost or repeated attempt left goes with the folder of the job.
    """

    def __init__(self, folder: str, binary: bool, overwrite: bool) -> None:
        self.folder, self.binary, self.overwrite = folder, binary, overwrite
        self.staging = f"_staging/{uuid.uuid4().hex}"

    def content(self, batch: pa.RecordBatch, row: int) -> bytes:
        if "ply" in batch.schema.names:
            return batch.column("ply")[row].as_py() or b""

        def table_of(name: str) -> np.ndarray | None:
            cell = batch.column(name)[row] if name in batch.schema.names else None
            if cell is None or not cell.is_valid:
                return None
            return np.column_stack([part.to_numpy(zero_copy_only=False) for part in cell.values.flatten()])

        vertices = table_of("vertices")
        return ply_bytes(np.zeros((0, 3)) if vertices is None else vertices, table_of("faces"), table_of("normals"), None, self.binary)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.folder)
        own = f"{self.staging}/{uuid.uuid4().hex}"
        names: list[str] = []
        for batch in iterator:
            for row in range(len(batch)):
                name = batch.column("name")[row].as_py()
                if not name or not name.endswith(".ply") or name.startswith(("/", "_")) or ".." in name.split("/"):
                    raise ValueError(f"no name of a PLY file: {name}")
                path = f"{root}/{own}/{len(names)}"
                if not names:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(self.content(batch, row))
                names.append(name)
        return Staged(own, names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.folder)
        moves = [(f"{root}/{m.folder}/{k}", f"{root}/{name}") for m in messages if m for k, name in enumerate(m.names)]
        targets = {target for _, target in moves}
        there = {i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(".ply")}
        if len(targets) < len(moves):
            raise ValueError(f"{len(moves) - len(targets)} names of PLY files stand in several rows")
        if not self.overwrite and targets & there:
            raise ValueError(f"{len(targets & there)} PLY files are there already, {min(targets & there)} is one")
        for parent in {target.rpartition("/")[0] for target in targets}:
            system.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
            if self.overwrite:
                list(pool.map(system.delete_file, there - targets))
        self.clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clean()

    def clean(self) -> None:
        system, root = opened(self.folder)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")
        staged = fs.FileSelector(f"{root}/_staging", allow_not_found=True)
        if system.get_file_info(staged.base_dir).type == fs.FileType.Directory and not system.get_file_info(staged):
            system.delete_dir(staged.base_dir)
