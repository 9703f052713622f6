"""Packing documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of them, whose
size the capacity bounds, says all that the packing needs. Large lengths are
rounded up within groups of equal cardinality; a linear program over
configurations of the few rounded sizes is solved by column generation; the
actual lengths are substituted, and small ones go where they fit best. Spark
then gives every piece its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes

CAPACITY = 2048
#: Lengths over this share of the capacity are large.
LARGE_SHARE = 1 / 3
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 64
#: Unit of the first search for configurations.
COARSE = 16
#: Entries of the tokenizer's cache of words, in each Python worker: about 100 MB. Those that weren't met for half as many new ones are dropped.
CACHED_WORDS = 400_000
#: Words of more characters aren't cached.
LONG_WORD = 64

END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer's matches, in normalized text with ASCII white space only; none crosses white space. Arrow's \s lacks the vertical tab.
_MATCH = r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\x0b\p{L}\p{N}]+"
#: The other white space among sure characters.
_SPACES = r"[\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]"
#: Characters whose classes only the tokenizer itself judges, as it does its special strings, which begin with <|.
_UNSURE = re.compile(r"[^\x00-\u012f\u0131-\u052f\u2000-\u2064\u20a0-\u20bf\u2122]")
#: A longer text is worked on in parts of about this many characters, cut before a space; shorter ones are worked on together.
_PART = 1 << 22


# The pipeline that a tokenizer's file must declare for its matches to be looked up one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordTokenizer:
    """ids of whole texts, match by match through a cache: Arrow finds the matches and which of them differ.

    New matches, which are normalized, are mapped to bytes and go to the file's model
    by themselves. Texts with _UNSURE characters or special strings go through the tokenizer
    whole; so do all texts where its file declares another pipeline.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.to_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.space = self.to_bytes(" ")[0][0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        split = declared.get("pre_tokenizer") or {}
        specials = [t["content"] for t in declared.get("added_tokens") or []]
        self.by_match = declared.get("normalizer") == _NORMALIZER and split.get("pretokenizers") == [_SPLIT, _BYTES] and all(s.startswith("<|") for s in specials)
        self.by_match = self.by_match and not declared.get("truncation") and not declared.get("padding")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        ids, ends = [], []
        for lo in range(0, len(words), 10_000):
            ((mapped, _),) = self.to_bytes(" ".join(words[lo : lo + 10_000]))
            for word in mapped.split(self.space):
                ids += [token.id for token in self.model.tokenize(word)]
                ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        # The tokenizer's lower case knows no final sigma.
        lower = [unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower() for part in parts]
        spaced = pc.replace_substring_regex(pa.array(lower, pa.string()), _SPACES, " ")
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(spaced, _MATCH, r"\0 "))
        matches = lists.flatten().dictionary_encode()
        different = matches.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        self.known[""] = b""
        self.known.update({m: self.older[m] for m in different if m not in self.known and m in self.older})
        new = [m for m in different if m not in self.known]
        self.known.update(zip(new, self._encode(new), strict=True))
        ids = list(map(self.known.__getitem__, different))
        for m in new:
            if len(m) > LONG_WORD:
                del self.known[m]
        at, of = lists.offsets.to_numpy().tolist(), matches.indices.to_numpy().tolist()
        return [b"".join(map(ids.__getitem__, of[lo:hi])) for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; short texts are worked on together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, owners, size = [], [], 0
        for i, text in enumerate(texts):
            if not self.by_match or "<|" in text or _UNSURE.search(text):
                out[i] = [self._whole(text)]
                continue
            lo = 0
            while lo < len(text):
                hi = text.find(" ", lo + _PART)
                hi = len(text) if hi < 0 else hi
                waiting.append(text[lo:hi])
                owners.append(i)
                size += hi - lo
                lo = hi
                if size >= _PART:
                    for k, ids in zip(owners, self._joined(waiting), strict=True):
                        out[k].append(ids)
                    waiting, owners, size = [], [], 0
        for k, ids in zip(owners, self._joined(waiting), strict=True):
            out[k].append(ids)
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, in its one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents: id, piece, start, length and ids (little-endian unsigned 32-bit).

    A document's ids are those of its text, then id 0; a null text is an empty one,
    so each row gives one piece at least. Only documents over capacity are cut.
    """
    frame = docs.select(F.col(id_col), F.col(text_col))
    path = tokenizer or default_tokenizer()
    zero = F.lit(0).cast("long")
    schema = frame.select(id_col, F.lit(0).alias("piece"), zero.alias("start"), zero.alias("length"), F.lit(None).cast("binary").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = word_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for part in by_bytes(batches, 1):
            of, start, ids = [], [], []
            for i, own in enumerate(tokenize.batch([text or "" for text in part.column(1).to_pylist()])):
                own += end
                for s in range(0, len(own), 4 * capacity):
                    of.append(i)
                    start.append(s // 4)
                    ids.append(own[s : s + 4 * capacity])
            at = np.array(start, np.int64)
            columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(at // capacity, pa.int32()), pa.array(at)]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def _groups(lengths: np.ndarray, counts: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths from large to small, cut into runs of equal cardinality: a group for each length, each group's count.

    All pieces of one length stay in one group.
    """
    order = np.argsort(-lengths)
    upto = np.cumsum(counts[order])
    group = np.minimum((upto - counts[order]) * n_groups // max(1, upto[-1]), n_groups - 1)
    _, group = np.unique(group, return_inverse=True)
    out = np.empty(len(lengths), np.int64)
    out[order] = group
    return out, np.bincount(out, weights=counts).astype(np.int64)


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in a configuration of greatest value (a knapsack over whole lengths)."""
    out = np.zeros(len(sizes), np.int64)
    use = np.flatnonzero((values > 1e-12) & (sizes <= capacity))
    if not len(use):
        return out
    own, value = sizes[use], values[use][:, None]
    # best[c]: the greatest value of up to k sizes within c; the space before 0 can't be used.
    rest = np.arange(capacity + 1)[None, :] - own[:, None]
    at = np.where(rest >= 0, rest, capacity + 1)
    best = np.append(np.zeros(capacity + 1), -np.inf)
    layers = []
    for _ in range(capacity // int(own.min())):
        gain = best[at] + value
        pick = gain.argmax(axis=0)
        top = gain[pick, np.arange(capacity + 1)]
        better = top > best[:-1] + 1e-12
        if not better.any():
            break
        layers.append(np.where(better, pick, -1))
        best = np.append(np.where(better, top, best[:-1]), -np.inf)
    c = capacity
    for layer in reversed(layers):
        if layer[c] >= 0:
            out[use[layer[c]]] += 1
            c -= int(own[layer[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, covering demand with few sequences: column generation.

    Starts from configurations of one size each; the basis inverse is kept and
    updated. New configurations are sought in steps of COARSE lengths first, which
    is quick, then exactly, until the cover is within gap of the program's optimum
    or of the sum of all lengths.
    rounds bounds the steps; any stop leaves a feasible cover.
    """
    n = len(sizes)
    unit = COARSE
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    enough = (1 + gap) * float(sizes @ demand) / capacity
    for step in range(rounds):
        if x.sum() <= enough:
            break
        price = np.maximum(inverse.sum(axis=0), 0)
        column = _best_configuration(-(-sizes // unit), price, capacity // unit).astype(float)
        if price @ column <= 1 + gap:
            if unit == 1:
                break
            unit = 1
            continue
        move = inverse @ column
        up = move > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
        else:
            theta = ratio[out]
            x = x - theta * move
            x[out] = theta
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
    return [(basis[:, i].astype(np.int64), float(x[i])) for i in range(n) if x[i] > 1e-9]


class _Room:
    """Runs of equal sequences by free space; each run: lengths and how many sequences."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.runs: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(self, lengths: tuple[int, ...], count: int, free: int) -> None:
        if count <= 0:
            return
        if free not in self.runs:
            self.runs[free] = []
            insort(self.free, free)
        self.runs[free].append((lengths, count))

    def take(self, least: int) -> tuple[tuple[int, ...], int, int] | None:
        """A run with the least free space of least or more."""
        i = bisect_left(self.free, least)
        if i == len(self.free):
            return None
        free = self.free[i]
        lengths, count = self.runs[free].pop()
        if not self.runs[free]:
            del self.runs[free], self.free[i]
        return lengths, count, free


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for the pieces of a histogram, as (lengths, how many such sequences)."""
    left = {length: n for length, n in histogram.items() if n > 0}
    room = _Room()
    room.add((capacity,), left.pop(capacity, 0), 0)
    large = np.array(sorted(x for x in left if x > capacity * LARGE_SHARE), np.int64)
    if len(large):
        counts = np.array([left[int(x)] for x in large], np.int64)
        group, demand = _groups(large, counts, n_groups)
        sizes = np.array([large[group == g].max() for g in range(len(demand))])
        # Each group's pieces, large first, are handed to the configurations in turn.
        queue = [[[int(x), left[int(x)]] for x in large[group == g][::-1]] for g in range(len(demand))]
        have = demand.copy()
        for config, times in sorted(configurations(sizes, demand.astype(float), capacity), key=lambda c: -c[1]):
            used = np.flatnonzero(config)
            times = min(int(times), *(int(have[g] // config[g]) for g in used))
            while times > 0:
                # A run as long as no slot's actual length changes.
                run = min([times, *(queue[g][0][1] // int(config[g]) for g in used)])
                lengths: list[int] = []
                if run:
                    for g in used:
                        lengths += [queue[g][0][0]] * int(config[g])
                        queue[g][0][1] -= run * int(config[g])
                else:
                    run = 1
                    for g in used:
                        for _ in range(int(config[g])):
                            lengths.append(queue[g][0][0])
                            queue[g][0][1] -= 1
                            if not queue[g][0][1]:
                                queue[g].pop(0)
                for g in used:
                    have[g] -= run * int(config[g])
                    if queue[g] and not queue[g][0][1]:
                        queue[g].pop(0)
                room.add(tuple(sorted(lengths, reverse=True)), run, capacity - sum(lengths))
                times -= run
        for x in large:
            left[int(x)] = 0
        for q in queue:
            for x, n in q:
                left[x] += n
    # What the rounding down of the program left, and small lengths: best fit, large first.
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            if (found := room.take(length)) is None:
                per = min(capacity // length, n)
                room.add((length,) * per, n // per, capacity - per * length)
                n -= n // per * per
                continue
            lengths, count, free = found
            per = min(free // length, n)
            run = min(count, n // per)
            room.add(lengths, count - run, free)
            room.add((*lengths, *(length,) * per), run, free - per * length)
            n -= run * per
    return sorted((run for runs in room.runs.values() for run in runs), reverse=True)


def places(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, sequence, per, offset): ranks first to last of a length stand in the sequences from
    sequence on, per of them in each, one after the other from offset."""
    out, rank, sequence = [], Counter(), 0
    for lengths, count in runs:
        offset = 0
        for length, per in sorted(Counter(lengths).items(), reverse=True):
            out.append((length, rank[length], rank[length] + per * count - 1, sequence, per, offset))
            rank[length] += per * count
            offset += per * length
        sequence += count
    return out


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, rows_per_range: int = 100_000) -> DataFrame:
    """cut (rows of pieces()) with sequence_id and offset.

    A piece's rank among those of its length is that of (hash, id, piece), counted
    in ranges of the hash; rows that agree in all of these are interchangeable. The
    histogram and the plan that go through the driver have at most a few rows per
    possible length. An empty table gives an empty table; columns of cut named
    sequence_id or offset are replaced.
    """
    spark = cut.sparkSession
    rest = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    d = cut.select(*rest)
    histogram = {int(r[0]): int(r[1]) for r in d.groupBy("length").count().collect()}
    found = places(plan(histogram, capacity))
    ranges = max(1, sum(histogram.values()) // rows_per_range)
    d = d.withColumn("_hash", F.xxhash64(id_col, "piece")).withColumn("_range", F.pmod("_hash", F.lit(ranges)))
    counts = d.groupBy("length", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_range").orderBy("_hash", id_col, "piece", "start")
    d = d.withColumn("_rank", F.row_number().over(inside) - 1).join(counts, ["length", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    table = spark.createDataFrame(found, "_length long, _first long, _last long, _sequence long, _per long, _offset long")
    fits = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    d = d.join(F.broadcast(table), fits)
    nth = F.col("_rank") - F.col("_first")
    sequence = F.col("_sequence") + F.floor(nth / F.col("_per"))
    offset = F.col("_offset") + nth % F.col("_per") * F.col("length")
    return d.select(*rest, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
