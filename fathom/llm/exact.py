"""Exact duplicates by a content sort.

Sampled splitters cut the order of (first bytes, hash, id) into ranges, an
external sort places equal texts next to each other, and neighbours are compared
in full. Splitters hold a text's first bytes and its hash only, so the sample
stays small however long the texts are; the id is a part of the order, so the
copies of one text may fill many ranges. What goes over a range's border is
summed up by its text, of which there are two a range at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import sized, stored

#: Bytes of a text that splitters hold.
PREFIX = 64


class Runs:
    """The runs of equal texts in one sorted range; the ids of the run at hand are held until it ends, no texts but one."""

    def __init__(self, part: int, names: list[str], id_type: pa.DataType) -> None:
        types = [id_type, id_type, pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()]
        self.schema = pa.schema([pa.field(n, t) for n, t in zip(names, types, strict=True)])
        self.part, self.leads = part, True
        self.held: list[pa.Array] = []
        self.text: bytes | None = None
        self.digest: bytes | None = None

    def _rows(self, ids: pa.Array, starts: np.ndarray, digests: pa.Array, border: int | None = None) -> pa.RecordBatch:
        """Rows of whole runs that begin at starts, the first of each staying; a run at a border tells its text once."""
        n, sizes = len(ids), np.diff(np.append(starts, len(ids)))
        first = np.zeros(n, bool)
        first[starts] = True
        run = pa.array(np.repeat(np.arange(len(starts)), sizes))
        edge = pa.nulls(n, pa.int64()) if border is None else pa.array(np.full(n, border), pa.int64())
        content = pa.nulls(n, pa.binary()) if border is None else pa.array([self.text, *[None] * (n - 1)], pa.binary())
        keep = ids.take(pa.array(np.repeat(starts, sizes)))
        return pa.RecordBatch.from_arrays([ids, keep, pa.array(np.repeat(sizes, sizes)), pa.array(first), digests.take(run), edge, content], schema=self.schema)

    def _hold(self, ids: pa.Array, text: pa.Scalar, digest: pa.Scalar) -> None:
        self.held, self.text, self.digest = [ids], text.as_py(), digest.as_py()

    def close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows of the held run; a range's first and last runs touch its borders."""
        if self.held:
            border = 2 * self.part + (not self.leads) if self.leads or last else None
            yield self._rows(pa.concat_arrays(self.held), np.zeros(1, np.int64), pa.array([self.digest], pa.binary()), border)
            self.held, self.leads = [], False

    def take(self, ids: pa.Array, text: pa.Array, digest: pa.Array) -> Iterator[pa.RecordBatch]:
        """The rows of all runs that end within the next stretch of a range, which isn't empty."""
        goes_on = bool(self.held) and text[0].as_py() == self.text
        equal = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(not goes_on, ~equal))
        if goes_on:
            self.held.append(ids.slice(0, int(starts[0]) if len(starts) else len(ids)))
        if not len(starts):
            return
        yield from self.close()
        if self.leads and len(starts) > 1:
            self._hold(ids.slice(0, int(starts[1])), text[0], digest[0])
            yield from self.close()
            starts = starts[1:]
        lo, hi = int(starts[0]), int(starts[-1])
        if hi > lo:
            yield self._rows(ids.slice(lo, hi - lo), starts[:-1] - lo, digest.take(pa.array(starts[:-1])))
        self._hold(ids.slice(hi), text[hi], digest[hi])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, largest: bool = True) -> DataFrame:
    """A row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if normalise, by default nothing, makes the same bytes of them;
    a null text is an empty one. The row with the largest id stays (the smallest
    where largest is false), nulls after all ids; of rows that agree in text and
    id exactly one stays. An empty table gives no rows. Other columns of docs are
    not read, whatever their names.
    """
    text = normalise(F.col(text_col)) if normalise else F.col(text_col)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("body"))
    d = d.withColumns({"start": F.substring("body", 1, PREFIX), "digest": F.unhex(F.sha2("body", 256)), "place": F.monotonically_increasing_id()})
    order = (F.desc_nulls_last if largest else F.asc_nulls_last)("id")
    # The body needs no part in the splitters: no two texts agree in their SHA-256; the copies of one are split by id and place.
    d = d.repartitionByRange("start", "digest", order, "place").sortWithinPartitions("start", "digest", "body", order, "place")
    kind = d.schema["id"].dataType.simpleString()
    names = ["id", "keep", "size", "first", "digest", "border", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = None
        for batch in batches:
            if len(batch):
                runs = runs or Runs(TaskContext.get().partitionId(), names, batch.schema.field(0).type)
                yield from runs.take(*batch.columns)
        if runs:
            yield from runs.close(last=True)

    rows = d.select("id", "body", "digest").mapInArrow(run, f"id {kind}, keep {kind}, size long, first boolean, digest binary, border long, content binary")
    rows = stored(rows, "exact-runs")
    # Two runs a range at most stand at borders: a group here is bounded by the number of ranges, not of copies.
    ends = rows.where(F.col("content").isNotNull()).groupBy("content")
    ends = ends.agg(F.collect_list("border").alias("at"), F.sum("size").alias("whole"), F.min("border").alias("lead"), F.min_by("keep", "border").alias("stays"))
    ends = stored(ends.select(F.explode("at").alias("border"), "whole", "lead", "stays"), "exact-borders")
    leads = F.coalesce(F.col("border") == F.col("lead"), F.lit(True))
    return rows.join(sized(ends, 64), "border", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("border").isNull(), F.col("keep")).otherwise(F.col("stays")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("first") & leads).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
