"""Ranked lexical search, reversed: the items' terms are a small inverted index, and the documents stream through it.

A document is read once, into the counts of those of its terms that some item
has. From these come the statistics of all documents, and then the scores: each
task keeps a bounded heap for each item, and the heaps are merged. Items beyond
a bound of their terms are searched block by block, so the index sent to the
tasks is bounded, however many items there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes, discard, stored

#: Fixed value: what a term is; all beyond ASCII and the ASCII letters and digits.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Pairs of item and term in an index; one item with more makes an index of its own.
POSTINGS = 1 << 17
#: Cells of documents by items, and pairs of document and posting, that are scored at a time.
CELLS = 1 << 21


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased."""
    return TERM.findall((text or b"").lower())


@dataclass
class Index:
    """Terms of some items: the items that hold term t are item[start[t] : start[t + 1]], each `times` often."""

    vocabulary: list[bytes]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, postings: list[tuple[int, bytes, int]]) -> Index:
        """From (number of an item, term, times)."""
        numbers, item = np.unique([p[0] for p in postings], return_inverse=True)
        vocabulary = sorted({bytes(p[1]) for p in postings})
        place = {t: k for k, t in enumerate(vocabulary)}
        term = np.array([place[bytes(p[1])] for p in postings], np.int64)
        order = np.lexsort((item, term))
        start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        return cls(vocabulary, start, item[order].astype(np.int64), np.array([p[2] for p in postings], np.int64)[order], numbers)


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(number, term, times) of items with the column number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            found = [(n, t, c) for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, c in Counter(terms(text)).items()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "term", "times"])

    return items.select("number", F.col(text_col).cast("binary")).mapInArrow(run, "number long, term binary, times long")


def term_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, term, times) per document: its number of terms, and the places in vocabulary of those it holds with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(sent.value)}
        for batch in by_bytes(batches, 1):
            n, ends, found, times = [], [0], [], []
            for text in batch.column(1).to_pylist():
                every = terms(text)
                n.append(len(every))
                held = Counter(every)
                known = [t for t in held if t in place]
                found += [place[t] for t in known]
                times += [held[t] for t in known]
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "term", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, n long, term array<int>, times array<int>")


class Heaps:
    """The best k documents of each item so far, as rows (item, score, no_id, id) in their order."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.rows = k, [np.zeros(0, np.int64) for _ in range(4)]
        self.least = np.ones(items, np.int64)

    def push(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """scores: documents by items. A document that can't be among the best isn't looked at."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        new = (item, scores[doc, item], no_id[doc].astype(np.int64), ids[doc])
        item, score, none, own = (np.concatenate(pair) for pair in zip(self.rows, new, strict=True))
        order = np.lexsort((own, none, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, nth = order[nth < self.k], item[nth < self.k], nth[nth < self.k]
        self.rows = [item, score[order], none[order], own[order]]
        full = nth == self.k - 1
        self.least[item[full]] = self.rows[1][full]


def scored(index: Index, weight: np.ndarray, size: np.ndarray, ends: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Documents by items: the sum over an item's terms, repeats included, of weight * ((10^9 * tf) div (1000 * tf + 12 * size))."""
    out = np.zeros((len(size), len(index.numbers)), np.int64)
    doc = np.repeat(np.arange(len(size)), np.diff(ends))
    worth = weight[term] * (1_000_000_000 * times // (1000 * times + 12 * size[doc]))
    many = (index.start[1:] - index.start[:-1])[term]
    edges = np.append(np.flatnonzero(np.diff((np.cumsum(many) - many) // CELLS, prepend=-1)), len(term))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        n = many[lo:hi]
        posting = np.arange(n.sum()) + np.repeat(index.start[term[lo:hi]] - (np.cumsum(n) - n), n)
        np.add.at(out.ravel(), np.repeat(doc[lo:hi] * out.shape[1], n) + index.item[posting], np.repeat(worth[lo:hi], n) * index.times[posting])
    return out


def best(counts: DataFrame, index: Index, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(number, id, score): of each task, the best k documents of each item."""
    sent = counts.sparkSession.sparkContext.broadcast((index, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = sent.value
        heaps = Heaps(len(index.numbers), k)
        rows = max(1, CELLS // len(index.numbers))
        for batch in batches:
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                none = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).cast(pa.int64()).to_numpy()
                size = 75 + 25 * part.column(1).to_numpy() * documents // total
                ends = np.append(0, np.cumsum(part.column(2).value_lengths().to_numpy()))
                term, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                heaps.push(scored(index, weight, size, ends, term, times), ids, none)
        item, score, none, ids = heaps.rows
        columns = [pa.array(index.numbers[item]), pa.array(ids, mask=none.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["number", "id", "score"])

    return counts.mapInArrow(run, "number long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of docs with the highest scores above 0 of each row of items.

    Terms are those of terms(); with N documents that have one, L terms in all of
    them, a document's n and a term's df and tf, a term weighs floor(1000 * ln((2N +
    2) / (2df + 1))), a document's size is 75 + (25 * n * N) div L, and scores are
    as in scored(), in 64 bits. Equal scores go by ascending id, a null id last.

    Ids are whole numbers or null. Null and empty texts, of documents and items,
    have no terms and no places. Rows that repeat are rows of their own: a document
    twice takes two places, an item twice has its ranks twice. Without documents
    or items there are no rows. Other columns aren't read, whatever their names.
    """
    spark = docs.sparkSession
    items = stored(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item"), F.col(item_text).alias("text")), "search-items")
    postings = stored(item_terms(items, "text"), "search-postings")
    n = postings.count()
    blocks = 1 if n <= POSTINGS else 2 * math.ceil(n / POSTINGS)
    out = None
    for block in range(blocks):
        own = postings.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        index = Index.of([tuple(r) for r in own.toLocalIterator()])
        if not index.vocabulary:
            continue
        counts = stored(term_counts(docs, id_col, text_col, index.vocabulary), "search-counts")
        documents, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            break
        holding = counts.select(F.explode("term").alias("term")).groupBy("term").count()
        df = np.zeros(len(index.vocabulary), np.int64)
        for r in holding.toLocalIterator():
            df[r["term"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = stored(best(counts, index, weight, documents, total, k), "search-best")
        discard(counts)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "number long, id long, score long")
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).join(items, "number")
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
