"""Hard negatives by Kronecker-packed products.

Vectors are whole numbers. In a block of anchors by rows, several rows'
components, made positive by a bias, go into separate fields of one wide
number, so one multiplication by an anchor's component serves all of them, and
the sums in the fields never run into each other. Unpacking gives exact scores.
Two rounds go over all blocks: the first finds each anchor's positives, the
second the rows of other labels in the window that a positive's score opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.stage import stored

#: Rows and anchors of a block, about; anchors that are scored at a time.
ROWS, ANCHORS, SLICE = 8192, 2048, 256


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered anchors and rows, exactly, as 64-bit numbers (an error where one is beyond them).

    A field is as wide as the greatest biased product can be. Fields are packed
    into doubles, which hold whole numbers up to 2^53, if two of them fit; wider
    ones into Python's numbers, eight at a time.
    """
    n, d = rows.shape
    if not d or not len(anchors) or not n:
        return np.zeros((len(anchors), n), np.int64)
    # Python's numbers here: biased components may have 65 bits.
    low_a, low_r = int(anchors.min()), int(rows.min())
    bits = max(1, (d * (int(anchors.max()) - low_a) * (int(rows.max()) - low_r)).bit_length())
    fields, kind = (53 // bits, np.float64) if 2 * bits <= 53 else (8, object)
    a = anchors.astype(kind) - low_a
    r = np.zeros((-(-n // fields) * fields, d), kind)
    r[:n] = rows.astype(kind) - low_r
    wide = sum(r[k::fields] * (1 << bits * k) for k in range(fields))
    product = a @ wide.T
    if kind is np.float64:
        product = product.astype(np.int64)
    out = np.empty((len(a), len(r)), product.dtype)
    for k in range(fields):
        out[:, k::fields] = (product >> (bits * k)) & ((1 << bits) - 1)
    sums_a, sums_r = (anchors.astype(product.dtype).sum(axis=1) - d * low_a, rows.astype(product.dtype).sum(axis=1) - d * low_r)
    out = out[:, :n] + (low_r * sums_a)[:, None] + (low_a * sums_r)[None, :] + d * low_a * low_r
    return out.astype(np.int64)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, shorter ones filled up by zeros."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _first(group: np.ndarray, limit: int) -> np.ndarray:
    """Which places of a sorted group are among the first `limit` of their value."""
    return np.arange(len(group)) - np.searchsorted(group, group) < limit


def _slices(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """(lo, hi, ids, labels, scores) per slice of the anchors in left; the rows of right in the order of their ids."""
    right = right.sort_by("id")
    width = max((t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for t in (left, right)), default=0)
    a, r = matrix(left.column("v"), width), matrix(right.column("v"), width)
    ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
    for lo in range(0, len(a), SLICE):
        yield lo, min(len(a), lo + SLICE), ids, labels, packed_products(a[lo : lo + SLICE], r)


def _positives(left: pa.Table, right: pa.Table, limit: int) -> list[np.ndarray]:
    """anchor, positive_id, score: the best rows of each anchor's label but the anchor itself."""
    number, own, label = (left.column(c).to_numpy() for c in ("anchor", "id", "label"))
    out = []
    for lo, hi, ids, labels, score in _slices(left, right):
        fits = (labels == label[lo:hi, None]) & (ids != own[lo:hi, None])
        score = np.where(fits, score, np.iinfo(np.int64).min)
        least = np.partition(score, len(ids) - limit, axis=1)[:, len(ids) - limit] if len(ids) > limit else score.min(axis=1)
        k, j = np.nonzero(fits & (score >= least[:, None]))
        order = np.lexsort((j, -score[k, j], k))
        k, j = k[order], j[order]
        k, j = k[_first(k, limit)], j[_first(k, limit)]
        out.append((number[lo + k], ids[j], score[k, j]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _negatives(left: pa.Table, right: pa.Table, limit: int, percent: int) -> list[np.ndarray]:
    """anchor, nth, negative_id, score: the best rows of other labels in the window of each of an anchor's positives."""
    number, label = left.column("anchor").to_numpy(), left.column("label").to_numpy()
    high = matrix(left.column("scores"), max(left.column("scores").combine_chunks().value_lengths().to_numpy().max(initial=0), 1))
    given = np.arange(high.shape[1]) < left.column("scores").combine_chunks().value_lengths().to_numpy()[:, None]
    low = -(-percent * high // 100)
    low[~given], high[~given] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    out = []
    for lo, hi, ids, labels, score in _slices(left, right):
        fits = (labels != label[lo:hi, None]) & (score >= low[lo:hi].min(axis=1)[:, None]) & (score <= high[lo:hi].max(axis=1)[:, None])
        k, j = np.nonzero(fits)
        order = np.lexsort((j, -score[k, j], k))
        k, j = k[order], j[order]
        s = score[k, j]
        for nth in range(high.shape[1]):
            inside = (s >= low[lo + k, nth]) & (s <= high[lo + k, nth])
            at = np.flatnonzero(inside)[_first(k[inside], limit)]
            out.append((number[lo + k[at]], np.full(len(at), nth), ids[j[at]], s[at]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _blocks(anchors: DataFrame, rows: DataFrame, parts: int, blocks: int, schema: str, work: Callable[[pa.Table, pa.Table], list[np.ndarray]]) -> DataFrame:
    """work's rows over every pair of a block of anchors and a part of the rows.

    Blocks and parts are cut by a running number, so no key makes one larger than others.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"part": every(parts), "block": F.pmod("anchor", F.lit(blocks)).cast("int")})
    right = rows.withColumns({"block": every(blocks), "part": F.pmod("place", F.lit(parts)).cast("int")})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        return pa.table(dict(zip(names, (pa.array(x, pa.int64()) for x in work(left, right)), strict=True)))

    names = [field.split()[0] for field in schema.split(", ")]
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, schema)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of which is_anchor holds.

    A component x counts as floor(scale * x). An anchor's positives are the rows of
    its label with the highest inner products, `positives` of them at most; a
    positive's negatives the rows of other labels with the highest ones from percent
    % of the positive's up to the positive's. Equal scores go by ascending id.

    Rows without id or label, without a vector, or with a component that is null or
    not finite take no part; a missing component of a shorter vector counts 0.
    Rows that repeat an id are rows of their own, but none is a positive of an
    anchor of its id; anchors that agree in all are answered once. Scores beyond 64
    bits are an error. An empty table gives no rows. Other columns aren't read.
    """
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    valid = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(whole, F.lit(False))
    d = rows.where(valid).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * float(scale))).alias("v"), is_anchor.alias("leads"))
    d = stored(d.withColumn("place", F.monotonically_increasing_id()), "negatives-rows")
    anchors = d.where("leads").groupBy("id", "label", "v").agg(F.min("place").alias("anchor"))
    anchors = stored(anchors, "negatives-anchors")
    parts, blocks = max(1, -(-d.count() // ROWS)), max(1, -(-anchors.count() // ANCHORS))
    everyone = d.select("id", "label", "v", "place")
    best = lambda key, score, other: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), other))
    held = _blocks(anchors, everyone, parts, blocks, "anchor long, positive_id long, positive_score long", lambda a, r: _positives(a, r, positives))
    held = held.withColumn("nth", best(["anchor"], "positive_score", "positive_id") - 1).where(F.col("nth") < positives)
    held = stored(held, "negatives-positives")
    # A row per positive of an anchor, five or so: the group is bounded by `positives`.
    opened = held.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("s"))
    opened = anchors.join(opened.select("anchor", F.col("s.positive_score").alias("scores")), "anchor")
    found = _blocks(opened, everyone, parts, blocks, "anchor long, nth long, negative_id long, negative_score long", lambda a, r: _negatives(a, r, negatives, percent))
    found = found.withColumn("rank", best(["anchor", "nth"], "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    named = held.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
