"""Stable assignment of whole sessions to train, val and test."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.tables import numbered, small

#: In the order in which equal needs are met.
NAMES = ("test", "val", "train")


class Fold:
    """The splits of one new session after another, from the counts of those that have one."""

    def __init__(self, counts: dict[str, int], val: float, test: float) -> None:
        self.share = {"test": max(0.0, test), "val": max(0.0, val)}
        self.share["train"] = max(0.0, 1.0 - self.share["test"] - self.share["val"])
        self.counts = [counts[s] for s in NAMES]
        self.total = sum(self.counts)
        self.at = 0

    def __next__(self) -> str:
        self.total += 1
        self.at += 1
        best, most = 2, float("-inf")
        for k, s in enumerate(NAMES):
            if self.share[s] > 0 and (need := self.share[s] - self.counts[k] / self.total) > most:
                best, most = k, need
        self.counts[best] += 1
        return NAMES[best]

    def __iter__(self) -> Fold:
        return self


def assign_splits(sessions: DataFrame, val: float = 0.2, test: float = 0.2, previous: DataFrame | None = None) -> DataFrame:
    """(session, split) for the names in sessions.session; null names have none.

    Names that previous (session, split) holds keep their split. The others, in code
    point order, go one by one to the split that is furthest below its share, test
    before val before train; a share of 0 takes none. The split of a new name
    follows from its rank and the counts of the kept ones alone: names are ranked
    in ranges, and each task counts its way to the first rank that it has.
    """
    names = sessions.select("session").where("session IS NOT NULL").distinct()
    if previous is None:
        previous = names.limit(0).withColumn("split", F.lit(""))
    kept = names.join(previous.where(F.col("split").isin(*NAMES)).dropDuplicates(["session"]), "session", "left")
    counts = {s: 0 for s in NAMES} | {r["split"]: r["n"] for r in kept.where("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n")).collect()}
    ranked = numbered(kept.where("split IS NULL").select("session"), "rank", "session")
    ranked = ranked.sortWithinPartitions("rank")
    schema = ranked.select("session").withColumn("split", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(counts, val, test)
        for batch in batches:
            split = []
            for rank in batch.column(1).to_pylist():
                while fold.at < rank:
                    next(fold)
                split.append(next(fold))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.string())], names=["session", "split"])

    return kept.where("split IS NOT NULL").unionByName(ranked.mapInArrow(run, schema))


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows with the split of their session."""
    return rows.join(small(splits, 64), "session")


def of_split(rows: DataFrame, split: str | None) -> DataFrame:
    """The rows of a split; None and "all" are all."""
    return rows if split in (None, "all") else rows.where(F.col("split") == split)
