"""Removal of repeated substrings by sorted suffixes.

Every 200-byte string of a text has one anchor: the place, among its runs of 64
bytes, whose hash is least (the first of equals). Equal strings have their
anchors at equal offsets, so only the strings around anchors with a hash that
occurs twice can repeat. The stretches around such anchors meet by hash, and
suffixes that start at the anchors, and reversed prefixes that end there, are
sorted deep-shallow: multikey quicksort to a shallow depth, then blind tries for
the groups with a longer common prefix. Two strings with the same anchor offset
are equal if and only if both sorted orders put their parts in the same class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes, fresh, sized, stored, text_key
from fathom.llm.textkernel import _BASE, _BASE_INVERSE, U64, mix, powers, prefix_hash

LENGTH = 200
GRAM = 64
SHALLOW = 16
#: Bytes of stretches that are sorted at a time; a hash whose stretches exceed them is sorted alone.
BATCH_BYTES = 16 << 20
#: A place of a stretch: the text's 128 bits, and where the anchor stands in it.
SPOT = np.dtype([("tid", "V16"), ("place", "<i4")])
#: Bytes of different stretches that a task gathers the places of before it hands them on.
STRETCH_BYTES = 8 << 20
BLOCK = 1 << 20


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(values)
    pad = -n % width
    v = np.append(values, np.full(pad, np.iinfo(np.uint64).max, U64)).reshape(-1, width)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first and last window start of each anchor of text, in order of place.

    Long texts are handled in blocks that overlap by length - 1 bytes.
    """
    parts = []
    for top in range(0, max(1, len(text) - length + 1), BLOCK):
        part = np.frombuffer(text, np.uint8, min(len(text), top + BLOCK + length - 1) - top, top)
        if len(part) < length:
            break
        h = prefix_hash(part)
        g = mix((h[gram:] - h[:-gram]) * powers(_BASE_INVERSE, len(h))[: len(h) - gram])
        width = length - gram + 1
        least = _window_minimum(g, width)
        # The first place with the window's least hash: where the minimum changes, or its place falls out.
        places = np.flatnonzero(_is_window_minimum(g, least, width))
        starts = np.arange(len(least))
        own = np.searchsorted(places, starts)
        at = places[own]
        wrong = np.flatnonzero(g[at] != least)
        while len(wrong):
            own[wrong] += 1
            at[wrong] = places[own[wrong]]
            wrong = wrong[g[at[wrong]] != least[wrong]]
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(edge[1:], len(at)) - 1
        parts.append((g[at[edge]], at[edge] + top, edge + top, last + top))
    if not parts:
        return (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _is_window_minimum(g: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Whether each value is the least of some window that holds it: the greatest of its windows' minima equals it."""
    n = len(g)
    most = ~_window_minimum(~np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)]), width)
    return most[:n] == g


def multikey_sort(strings: list[bytes], depth: int = SHALLOW, base: int = 0) -> tuple[list[int], list[int]]:
    """The order of strings and the common prefix of each with the one before it: deep-shallow.

    Multikey quicksort splits on one byte after another; a group that still agrees
    in depth bytes beyond base goes to a blind trie.
    """
    order: list[int] = []
    common: list[int] = []
    work: list[tuple[list[int], int, int]] = [(list(range(len(strings))), base, 0)]
    while work:
        group, at, shared = work.pop()
        if len(group) == 1:
            order.append(group[0])
            common.append(shared)
        elif at - base >= depth:
            for k, (i, lcp) in enumerate(blind_trie(strings, group, at)):
                order.append(i)
                common.append(lcp if k else shared)
        else:
            pivot = _byte(strings[group[len(group) // 2]], at)
            less, same, more = [], [], []
            for i in group:
                c = _byte(strings[i], at)
                (less if c < pivot else same if c == pivot else more).append(i)
            # Later groups share `at` bytes with the one before; the first keeps what this group shared.
            parts = [(g, a) for g, a in ((less, at), (same, at + 1), (more, at)) if g]
            if pivot < 0 and same:  # they end here, so they are equal
                parts = [(g, a) if g is not same else (g, -1) for g, a in parts]
            for k in range(len(parts) - 1, -1, -1):
                g, a = parts[k]
                before = shared if k == 0 else at
                if a < 0:
                    work.append((g, base + depth, before))
                else:
                    work.append((g, a, before))
    return order, common


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix of a and b, which agree in at bytes."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        if a[at : at + step] != b[at : at + step]:
            if step == 1:
                break
            step = max(1, step // 4)
        else:
            at += step
    return min(at, n)


def blind_trie(strings: list[bytes], group: list[int], at: int) -> list[tuple[int, int]]:
    """group in order, each with its common prefix with the one before; its strings agree in at bytes.

    Inner nodes hold only a depth and the branching bytes. A string is inserted by
    a blind descent to some leaf, one comparison with that leaf, and a split at
    the depth where they part.
    """
    root: list = [group[0]]  # a node: [leaf, leaf, ...] of equal strings, or (depth, {byte: node})
    for i in group[1:]:
        s = strings[i]
        node = root
        while isinstance(node, tuple):
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
        leaf = strings[node[0]]
        lcp = common_prefix(s, leaf, min(at, len(s), len(leaf)))
        if lcp == len(s) == len(leaf):
            node.append(i)
            continue
        parent, key, node = None, 0, root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, key = node, _byte(s, node[0])
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][_byte(s, lcp)] = [i]
            continue
        split = (lcp, {_byte(leaf, lcp): node, _byte(s, lcp): [i]})
        if parent is None:
            root = split
        else:
            parent[1][key] = split
    out: list[tuple[int, int]] = []
    work: list[tuple[object, int]] = [(root, at)]
    while work:
        node, shared = work.pop()
        if isinstance(node, tuple):
            keys = sorted(node[1])
            for k in range(len(keys) - 1, -1, -1):
                work.append((node[1][keys[k]], shared if k == 0 else node[0]))
        else:
            out.append((node[0], shared))
            out += [(i, len(strings[i])) for i in node[1:]]
    return out


def repeated_windows(groups: np.ndarray, stretches: list[bytes], first: np.ndarray, last: np.ndarray, weight: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For each stretch, which of its offsets have a string that another stretch of its group, or a copy of it, has too.

    A stretch holds the windows whose anchor stands first, first - 1, ... last
    bytes after their start; it starts first bytes before the anchor. weight counts
    the places it stands at. Stretches of a group that are alike must be one row.
    """
    n = len(stretches)
    out = [np.zeros(0, np.int64)] * n
    rows: list[int] = []
    bounds = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if n else np.zeros(0, np.int64)
    bounds = np.append(bounds, n)
    right_class: list[np.ndarray] = []
    right = {}
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo == 1:
            if weight[lo] > 1:
                out[lo] = np.arange(last[lo], first[lo] + 1)
            continue
        rows += range(lo, hi)
        right[len(rows)] = (lo, hi)
    if not rows:
        return out
    at = np.array(rows)
    after, before = [], []
    for lo, hi in right.values():
        tails = [stretches[i][first[i] + gram :] for i in range(lo, hi)]
        heads = [stretches[i][: first[i]][::-1] for i in range(lo, hi)]
        for strings, into in ((tails, after), (heads, before)):
            order, common = multikey_sort(strings)
            common[0] = -1 << 20
            into.append((np.array(order) + lo, np.array(common)))
    del right_class
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    order_r, common_r = (np.concatenate(x) for x in zip(*after, strict=True))
    order_l, common_l = (np.concatenate(x) for x in zip(*before, strict=True))
    order_r, order_l = place[order_r], place[order_l]
    high, low, many = first[at], last[at], weight[at] > 1
    hits: list[tuple[np.ndarray, int]] = []
    class_r, class_l = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for j in range(int(low.min()), int(high.max()) + 1):
        live = (low <= j) & (j <= high)
        if not live.any():
            continue
        class_r[order_r] = np.cumsum(common_r < length - gram - j)
        class_l[order_l] = np.cumsum(common_l < j)
        own = np.flatnonzero(live)
        key = class_l[own] * (len(at) + 1) + class_r[own]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = many[own]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hits.append((own[twice], j))
    found = np.concatenate([h for h, _ in hits]) if hits else np.zeros(0, np.int64)
    offset = np.concatenate([np.full(len(h), j) for h, j in hits]) if hits else np.zeros(0, np.int64)
    order = np.argsort(found, kind="stable")
    cut = np.searchsorted(found[order], np.arange(len(at) + 1))
    for k, i in enumerate(at):
        out[i] = offset[order[cut[k] : cut[k + 1]]]
    return out


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive numbers, as first and last."""
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > 1)
    yield from zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True)


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of [start, end), as maximal runs."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        if out and starts[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(ends[i]))
        else:
            out.append([int(starts[i]), int(ends[i])])
    return [(a, b) for a, b in out]


def repeated_anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(hash): the anchors that stand in more than one place of rows (_text, a row per document, copies too), as a stored table.

    It reads the documents as they are; anchors are counted in each part of a batch before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            found = [anchors(text or b"", length, gram)[0] for text in batch.column(0).to_pylist()]
            h, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(count, 2).astype(np.int8))], names=["hash", "n"])

    found = rows.mapInArrow(run, "hash long, n byte").groupBy("hash").agg(F.sum("n").alias("n"))
    return stored(found.where("n > 1").select("hash"), "anchors")


def find_repeats(texts: DataFrame, twice: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_tid, _starts, _ends): the runs of each text of texts (_tid, _text, _copies) that repeat somewhere.

    texts has a row per different text, identified by the 128 bits of _tid; _copies
    counts its rows; twice are its repeated_anchors(). Equal stretches around an anchor become one row with all their
    places before they are shuffled.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            found = [np.unique(anchors(text, length, gram)[0]) for text in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(h) for h in found])
            arrays = [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "_tid"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
        rows: dict[tuple[int, int, bytes], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [[k[0] for k in rows], [k[1] for k in rows], *([v[c] for v in rows.values()] for c in (0, 1, 2)), [k[2] for k in rows]]
            columns[3] = [b"".join(spots) for spots in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hash", "first", "last", "spots", "weight", "stretch"])

        for batch in by_bytes(batches, 1):
            for tid, text, copies, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, place, lo, hi = anchors(text, length, gram)
                keep = np.isin(h, np.array(wanted, np.int64).view(U64))
                for k in np.flatnonzero(keep):
                    stretch = text[lo[k] : hi[k] + length]
                    key = (int(h.view(np.int64)[k]), int(place[k] - lo[k]), stretch)
                    if (row := rows.get(key)) is None:
                        row = rows[key] = [int(place[k] - hi[k]), [], 0]
                        size += len(stretch) + 100
                    row[1].append(tid + int(place[k]).to_bytes(4, "little"))
                    row[2] += copies
            if size > STRETCH_BYTES:
                yield flush()
                rows.clear()
                size = 0
        if rows:
            yield flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_tid", "start", "end"]

        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            column = {c: table.column(c).combine_chunks() for c in table.column_names}
            hashes, first, last, weights = (column[c].to_numpy() for c in ("hash", "first", "last", "weight"))
            alike: dict[tuple, int] = {}
            of = np.array([alike.setdefault(k, len(alike)) for k in zip(hashes.tolist(), first.tolist(), column["stretch"].to_pylist(), strict=True)])
            keys = list(alike)
            lasts = np.zeros(len(keys), np.int64)
            lasts[of] = last
            weight = np.bincount(of, weights=weights, minlength=len(keys)).astype(np.int64)
            hits = repeated_windows(np.array([k[0] for k in keys]), [k[2] for k in keys], np.array([k[1] for k in keys]), lasts, weight, length, gram)
            runs = [list(_runs(h)) if len(h) else [] for h in hits]
            each = [(row, lo, hi) for row, k in enumerate(of) for lo, hi in runs[k]]
            if not each:
                return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
            row, lo, hi = (np.array(x) for x in zip(*each, strict=True))
            spots = [column["spots"][int(k)].as_py() for k in row]
            n = np.array([len(x) // SPOT.itemsize for x in spots])
            flat = np.frombuffer(b"".join(spots), SPOT)
            place = flat["place"].astype(np.int64)
            tids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(flat), [None, pa.py_buffer(np.ascontiguousarray(flat["tid"]).tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([tids, pa.array(place - np.repeat(hi, n)), pa.array(place - np.repeat(lo, n) + length)], names=names)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            edge = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
            if held and len(batch) and held[-1].column(0)[-1].as_py() != hashes[0]:
                edge = np.append(0, edge)
            if len(edge):
                whole, rest = batch.slice(0, edge[-1]), batch.slice(edge[-1])
                held.append(whole)
                size += whole.get_total_buffer_size() * len(whole) // max(1, len(batch))
                if size > BATCH_BYTES:
                    yield solved([h for h in held if len(h)])
                    held, size = [], 0
                held.append(rest)
            elif len(batch):
                held.append(batch)
                size += batch.get_total_buffer_size()
        if any(len(h) for h in held):
            yield solved([h for h in held if len(h)])

    # With all columns, as in the joins below, the grouped texts are shuffled once for all.
    found = texts.mapInArrow(sketch, "hash long, _tid binary")
    # Where the repeated anchors are few, they go to the texts; else both are shuffled.
    wanted = found.join(sized(twice, 8), "hash").groupBy("_tid").agg(F.collect_list("hash").alias("_wanted"))
    stretches = texts.join(wanted, "_tid").select("_tid", "_text", "_copies", "_wanted")
    stretches = stretches.mapInArrow(cut, "hash long, first int, last int, spots binary, weight long, stretch binary")
    met = stretches.repartition(F.col("hash")).sortWithinPartitions("hash", "first", "stretch")
    runs = met.mapInArrow(match, "_tid binary, start long, end long")
    return runs.groupBy("_tid").agg(F.collect_list("start").alias("_starts"), F.collect_list("end").alias("_ends"))


def different_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_tid, _text, _copies): a row per different text as bytes; a null text is an empty one.

    _tid is a hash of 128 bits. Copies are counted before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(text_key(F.col(text_col)).alias("_tid"), text.cast("binary").alias("_text"))
    return d.groupBy("_tid").agg(F.first("_text").alias("_text"), F.count("*").alias("_copies"))


def removed(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_tid, n_bytes, spans, kept) per different text: the maximal removed runs [start, end) and the bytes left."""
    texts = different_texts(docs, text_col)
    twice = repeated_anchors(docs.select(F.col(text_col).cast("binary")), length, gram)
    d = texts.join(find_repeats(texts, twice, length, gram), "_tid", "left").select("_tid", "_text", "_copies", "_starts", "_ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in by_bytes(batches, 1):
            sizes, runs, kept = [], [], []
            for _, text, _, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = spans(np.array(starts), np.array(ends)) if starts else []
                at, left = 0, []
                for a, b in own:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                sizes.append(len(text))
                runs.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(left))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_tid", "n_bytes", "spans", "kept"])

    return d.mapInArrow(cut, "_tid binary, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, of_kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans and kept: the bytes left, or what of_kept makes of them before they are shuffled.

    Every byte that a string of length bytes covers which also starts anywhere
    else, in the same text or another, is removed; all places count by the input.
    A copy is another text, so texts of that length with copies vanish. Null texts
    are empty, short ones stay whole, repeated ids keep their rows, an empty table
    gives an empty table, other columns don't matter.
    """
    (key,) = fresh(docs, "_tid")
    ids = docs.select(F.col(id_col), text_key(F.col(text_col)).alias(key))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = removed(docs, text_col, length).select(F.col("_tid").alias(key), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), (of_kept(F.col("kept")) if of_kept else F.col("kept")).alias("kept"))
    return ids.join(found, key).drop(key)


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """docs with the repeated strings cut out of their texts; a character goes only if all its bytes do.

    length_col, where present, follows the text. Rows whose text changes not keep it, null included.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            out = []
            for _, text, _, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, left = 0, []
                for a, b in spans(np.array(starts), np.array(ends)):
                    while a < len(text) and text[a] & 0xC0 == 0x80:  # inside a character: it stays
                        a += 1
                    while b > 0 and b < len(text) and text[b] & 0xC0 == 0x80:
                        b -= 1
                    left.append(text[at : max(at, a)])
                    at = max(a, b)
                left.append(text[at:])
                out.append(b"".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_tid", "_cut"])

    texts = different_texts(docs, text_col)
    twice = repeated_anchors(docs.select(F.col(text_col).cast("binary")), length)
    changed = texts.join(find_repeats(texts, twice, length), "_tid").select("_tid", "_text", "_copies", "_starts", "_ends").mapInArrow(whole, "_tid binary, _cut string")
    d = docs.select(F.struct("*").alias("_doc"), text_key(F.col(text_col)).alias("_tid")).join(changed, "_tid", "left")
    text = F.coalesce(F.col("_cut"), F.col("_doc").getField(text_col))
    replaced = {text_col: text} | ({length_col: F.when(F.col("_cut").isNull(), F.col("_doc").getField(length_col)).otherwise(F.length("_cut"))} if length_col in docs.columns else {})
    return d.select(*[replaced.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
