"""Near-duplicate documents by ProbMinHash.

Five-word shingles weigh 1 + ln(count). Each shingle sends arrivals of a Poisson
process at the rate of its weight to random registers of a sketch, which keep
the first arrival; a shingle stops once it can't be first anywhere. Two sketches
agree in a register with the probability Jaccard similarity of the weights.
Registers are banded; texts that meet in a band are candidates, and each
candidate pair is verified on the shingles themselves; where many texts meet,
bounds on the shingles that a pair can share leave few pairs to verify. Links are
joined into classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes, discard, fresh, sized, stored, text_key
from fathom.llm.textkernel import U64, chunks, mix, rolling, scan

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: A shingle that more of the unsure texts hold is a common one.
RARE = 32
#: Texts on each side of a block of pairs, and shingles that are compared at a time there.
BLOCK, COLUMNS = 1024, 4096
#: What rounding may do to a bound.
SLACK = 1e-4
_GAMMA = 0x9E3779B97F4A7C15


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, weight and text of each different shingle, in order of text and hash.

    A text of one to four words has one shingle, all its words; one without words has none.
    """
    words = scan(texts)
    h, n = words.hashes(), words.counts
    text = words.text_of_word()
    parts, owners = [], []
    if len(h) >= SHINGLE:
        inside = text[: len(h) - SHINGLE + 1] == text[SHINGLE - 1 :]
        parts.append(rolling(h, SHINGLE)[inside])
        owners.append(text[: len(h) - SHINGLE + 1][inside])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        parts.append(rolling(h[words.text_ptr[i] : words.text_ptr[i + 1]], int(n[i])))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, U64), np.zeros(0), np.zeros(0, np.int64)
    key, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
    count = np.diff(np.append(edge, len(key)))
    return key[edge], 1 + np.log(count), owner[edge]


def sketch(key: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """For each text the shingles (low 32 bits) that arrived first in its registers; texts without shingles: 0."""
    first = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, np.uint32)
    key, base = key.copy(), owner * registers
    time = np.zeros(len(key))
    step = 0
    while len(key):
        step += 1
        random = mix(key + U64(step * _GAMMA & (1 << 64) - 1))
        time = time - np.log(((random >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        register = base + (mix(random) % U64(registers)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        winner[register[won]] = key[won].astype(np.uint32)
        latest = first.reshape(n_texts, registers).max(axis=1)
        on = time < latest[base // registers]
        key, weight, base, time = key[on], weight[on], base[on], time[on]
    return winner.reshape(n_texts, registers)


def band_keys(winners: np.ndarray) -> np.ndarray:
    """A hash for each band of each sketch."""
    rows = winners.reshape(len(winners), BANDS, ROWS).astype(U64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(_GAMMA), rows.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out + rows[:, :, k])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two weighted sets, each (sorted hashes, weights), exactly."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(common)
    if not len(common):
        return 0.0, 0.0
    wa, wb = a[1][i], b[1][j]
    # For a shared shingle d: 1 / sum over d' of max(a' / a, b' / b); who is greater follows from the ratios a / b.
    ratio = wa / wb
    order = np.argsort(-ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    above = np.cumsum(wa)
    below = wb.sum() - np.cumsum(wb)
    return float((1 / ((only_a + above) / wa + (only_b + below) / wb)).sum()), len(common) / union


def keyed_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_key, _hash, _text) for each row: the 128 bits that stand for the text, 64 for its bands, and its bytes; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text_key(F.col(text_col)).alias("_key"), F.xxhash64(text).alias("_hash"), text.cast("binary").alias("_text"))


def sketched(texts: DataFrame) -> DataFrame:
    """(_hash, band) rows: the band keys of each text of texts (_hash, _text). Copies in a part of a batch give one text's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            tid, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            every = batch.column(1).take(pa.array(at)).to_pylist()
            for lo, hi in chunks(every):
                key, weight, owner = shingles(every[lo:hi])
                full = np.unique(owner)
                bands = band_keys(sketch(key, weight, owner, hi - lo))[full]
                arrays = [np.repeat(tid[lo:hi][full], BANDS), bands.ravel().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["_hash", "band"])

    return texts.select("_hash", "_text").mapInArrow(run, "_hash long, band long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard, or plain Jaccard, reaches threshold; pairs and texts are stored tables."""
    texts = texts.select("_tid", "_text")
    texts_b = texts.withColumnsRenamed({"_tid": "b", "_text": "text_b"}).join(sized(pairs, 16), "b")
    wanted = sized(stored(pairs.select("a").distinct(), "ends"), 8)
    texts_a = texts.withColumnsRenamed({"_tid": "a", "_text": "text_a"}).join(wanted, "a", "left_semi")
    d = texts_b.hint("shuffle_merge").join(texts_a, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in by_bytes(batches, 3):
            a = batch.column(0).to_pylist()
            every = batch.column(3).to_pylist()
            keep = []
            for lo, hi in chunks(every):
                key, weight, owner = shingles(every[lo:hi])
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                for k in range(lo, hi):
                    if a[k] != last:
                        last, own = a[k], shingles([batch.column(2)[k].as_py()])[:2]
                    part = slice(at[k - lo], at[k - lo + 1])
                    keep.append(max(similarity(own, (key[part], weight[part]))) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return d.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(_tid, class): for each end of edges (a, b) the least end that it is connected with.

    Labels travel along edges and jump to the labels of labels, until nothing changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("_tid")).agg(F.min("b").alias("least")).select("_tid", F.least("_tid", "least").alias("class")), "label")
    while True:
        near = both.join(label, both["b"] == label["_tid"]).groupBy("a").agg(F.min("class").alias("near"))
        new = label.join(near, label["_tid"] == near["a"]).select("_tid", F.col("class").alias("was"), F.least("class", "near").alias("via"))
        jump = label.select(F.col("_tid").alias("via"), F.col("class").alias("further"))
        new = stored(new.join(jump, "via").select("_tid", "was", F.least("via", "further").alias("class")), "label")
        done = new.where("was <> class").isEmpty()
        discard(label)
        label = new.select("_tid", "class")
        if done:
            discard(both)
            return label


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (_tid, class) after links (a, b) between classes; only the classes that links touch are gone through."""
    of_a = label.select(F.col("_tid").alias("a"), F.col("class").alias("class_a"))
    of_b = label.select(F.col("_tid").alias("b"), F.col("class").alias("class_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    ends = stored(ends.select("a", F.coalesce("class_a", "a").alias("class_a"), "b", F.coalesce("class_b", "b").alias("class_b")), "ends")
    root = components(ends.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    root = root.select(F.col("_tid").alias("class"), F.col("class").alias("root"))
    known = label.union(ends.select("a", "class_a")).union(ends.select("b", "class_b")).distinct()
    out = stored(known.join(root, "class", "left").select("_tid", F.coalesce("root", "class").alias("class")), "label")
    discard(label, links, ends, root)
    return out


def common_shingles(texts: DataFrame, rare: int) -> DataFrame:
    """(_tid, often): the shingles of each text of texts (_tid, _text) that more than rare of them hold, where it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            tid, every = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo, hi in chunks(every):
                key, _, owner = shingles(every[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(tid[lo:hi][owner]), pa.array(key.view(np.int64))], names=["_tid", "shingle"])

    held = texts.select("_tid", "_text").mapInArrow(run, "_tid long, shingle long")
    often = sized(stored(held.groupBy("shingle").count().where(F.col("count") > rare).select("shingle"), "often"), 8)
    return held.join(often, "shingle").groupBy("_tid").agg(F.collect_list("shingle").alias("often"))


_PARTS = "_tid long, class long, n int, total double, shingle array<long>, left array<int>, share array<double>, common array<long>, weight array<double>"


def parts(texts: DataFrame, threshold: float) -> DataFrame:
    """For texts (_tid, _text, class, often) what a link can begin with, in an order of shingles with the rare ones first.

    n and total are a text's shingles and their weight. shingle: the rare shingles
    that can be the first that a linked pair shares; left and share: how many
    shingles there are from it on, and their share of the weight. common and weight:
    the common shingles, if they alone can make a link, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            rows: list[list] = [[] for _ in range(9)]
            every = batch.column(1).to_pylist()
            for lo, hi in chunks(every):
                key, weight, owner = shingles(every[lo:hi])
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                for k in range(lo, hi):
                    own, w = key[at[k - lo] : at[k - lo + 1]], weight[at[k - lo] : at[k - lo + 1]]
                    common = np.isin(own, np.array(batch.column(3)[k].as_py() or [], np.int64).view(U64))
                    order = np.argsort(common, kind="stable")
                    own, w = own[order].view(np.int64), w[order]
                    n, n_rare = len(own), len(own) - int(common.sum())
                    left = n - np.arange(n)
                    share = np.cumsum(w[::-1])[::-1] / w.sum()
                    able = (left >= (threshold - SLACK) * n) | (share >= threshold - SLACK)
                    cut = int(able[:n_rare].sum())
                    alone = n_rare < n and able[n_rare]
                    values = (batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), n, float(w.sum()), own[:cut], left[:cut], share[:cut])
                    for c, v in zip(rows, (*values, own[n_rare:] if alone else None, w[n_rare:] if alone else None), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), *map(pa.list_, (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in _PARTS.split(", ")])

    return texts.select("_tid", "_text", "class", "often").mapInArrow(run, _PARTS)


def rare_pairs(split: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of different classes that share a rare shingle and, if it is their first, can be links."""
    most = 1 + 1 / threshold + SLACK

    def met(shingle: np.ndarray, tid: np.ndarray, cls: np.ndarray, n: np.ndarray, left: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = 1
        while step < len(shingle) and (same := shingle[step:] == shingle[:-step]).any():
            fits = n[step:] + n[:-step] <= most * np.minimum(left[step:], left[:-step])
            fits |= 1 / share[step:] + 1 / share[:-step] <= most
            keep = same & fits & (cls[step:] != cls[:-step])
            a.append(np.minimum(tid[step:], tid[:-step])[keep])
            b.append(np.maximum(tid[step:], tid[:-step])[keep])
            step += 1
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if len(held[0]):
                last = int(np.append(0, np.flatnonzero(held[0] != held[0][-1]) + 1)[-1])
                yield met(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        if held is not None:
            yield met(*held)

    rows = split.select("_tid", "class", "n", F.inline(F.arrays_zip("shingle", "left", "share")))
    rows = rows.select("shingle", "_tid", "class", "n", "left", "share").repartition("shingle").sortWithinPartitions("shingle")
    return rows.mapInArrow(run, "a long, b long").distinct()


def block_pairs(texts: list[tuple], against: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """The pairs, one of each list of (tid, class, n, total, common, weight), that can be links by their common shingles alone.

    Of pairs that surely are links, those that join classes which no others join already.
    """
    names, of = np.unique([r[1] for r in (*texts, *against)], return_inverse=True)
    root = np.arange(len(names))
    sides = []
    for rows, cls in ((texts, of[: len(texts)]), (against, of[len(texts) :])):
        owner = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
        key, weight = np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows])
        sides.append((owner, key, weight, cls, np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])))
    x, y = sides
    shape = len(texts), len(against)
    both, of_x, of_y = (np.zeros(shape, np.float32) for _ in range(3))
    every = np.intersect1d(x[1], y[1])
    for lo in range(0, len(every), COLUMNS):
        columns = every[lo : lo + COLUMNS]
        held = []
        for owner, key, weight, *_ in sides:
            at = np.minimum(np.searchsorted(columns, key), len(columns) - 1)
            own = columns[at] == key
            ones, weights = np.zeros((2, owner[-1] + 1, len(columns)), np.float32)
            ones[owner[own], at[own]] = 1
            weights[owner[own], at[own]] = weight[own]
            held.append((ones, weights))
        both += held[0][0] @ held[1][0].T
        of_x += held[0][1] @ held[1][0].T
        of_y += held[0][0] @ held[1][1].T
    n = (x[5][:, None] + y[5][None, :]).astype(np.float64)
    sure = both / (n - both) >= threshold
    with np.errstate(divide="ignore"):
        able = sure | (x[6][:, None] / of_x + y[6][None, :] / of_y <= 1 + 1 / threshold + SLACK)
    out = []
    for i in range(shape[0]):  # surely linked classes grow together
        for kind in np.unique(root[y[3][sure[i]]]):
            if kind != root[x[3][i]]:
                j = int(np.flatnonzero(sure[i] & (root[y[3]] == kind))[0])
                out.append((int(x[4][i]), int(y[4][j])))
                root[root == kind] = root[x[3][i]]
    for i, j in zip(*np.nonzero(able & ~sure & (root[x[3]][:, None] != root[y[3]][None, :])), strict=True):
        out.append((int(x[4][i]), int(y[4][j])))
    return out


def common_pairs(split: DataFrame, met: DataFrame, label: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b): pairs of different classes that can be links by their common shingles alone; None if there are none.

    Texts that meet in a band of met, directly or by others, are a group. Of texts
    with the same common shingles and weights, one is near to as many others as any:
    the shortest, or by weights the lightest. So each text is held against
    those of its group only, in blocks.
    """
    alone = split.where("common IS NOT NULL").drop("class").join(label, "_tid", "left").withColumn("class", F.coalesce("class", "_tid"))
    alike = F.array_sort(F.arrays_zip("common", "weight"))
    alone = stored(alone.select("_tid", "class", "n", "total", "common", "weight", F.xxhash64(alike).alias("alike")), "alone")
    inside = met.select("band", "_tid").join(alone.select("_tid", "class"), "_tid")
    mixed = inside.groupBy("band").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.min("_tid").alias("low")).where("one < other")
    edges = stored(inside.join(mixed, "band").where("_tid <> low").select(F.col("low").alias("a"), F.col("_tid").alias("b")).distinct(), "meet")
    if edges.limit(1).count() == 0:
        return None
    group = components(edges).withColumnRenamed("class", "group")
    texts = stored(alone.select("_tid", "alike", "n", "total").join(group, "_tid"), "dealt")
    least = texts.groupBy("group", "alike").agg(F.min(F.struct("n", "_tid")).alias("short"), F.min(F.struct("total", "_tid")).alias("light"))
    against = least.select("group", F.explode(F.array("short._tid", "light._tid")).alias("_tid")).distinct()
    n_texts = texts.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("n_i"))
    n_against = against.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("n_j"))
    blocks = stored(n_texts.join(n_against, "group"), "blocks")
    h = F.xxhash64("_tid")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = texts.select("group", "_tid").join(blocks, "group").select("group", "_tid", F.lit(True).alias("is_text"), F.pmod(h, "n_i").alias("i"), every("n_j").alias("j"))
    right = against.join(blocks, "group").select("group", "_tid", F.lit(False).alias("is_text"), F.pmod(h, "n_j").alias("j"), every("n_i").alias("i"))
    rows = left.unionByName(right).join(alone.drop("alike"), "_tid")

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        columns = [table.column(c).to_pylist() for c in ("is_text", "_tid", "class", "n", "total", "common", "weight")]
        for is_text, *row in zip(*columns, strict=True):
            sides[is_text].append(tuple(row))
        pairs = block_pairs(sides[1], sides[0], threshold) if all(sides) else []
        return pa.table({k: pa.array([min(p) if k == "a" else max(p) for p in pairs], pa.int64()) for k in ("a", "b")})

    return rows.groupBy("group", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_classes(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_key, _class) for those of texts (_key, _hash, _text) that meet another in a band; _class is the key of one text of the class.

    First every text is held against the least and the greatest text that it meets
    in a band. The texts of bands that still hold several classes are unsure. Of
    two sets with X and Y elements, or weights, in all and shares x and y of them
    in common, neither similarity exceeds 1 / (X / x + Y / y - 1). So linked texts
    share a rare shingle, and one early in their order, or their common shingles
    alone are enough for a link. Pairs of both kinds are all tested, but for those
    within a class; the pairs of a rare shingle are few.
    The candidates are numbered once they are stored; tables that no later step
    reads are deleted.
    """
    rows = stored(sketched(texts), "bands")
    shared = rows.groupBy("band").agg(F.min("_hash").alias("low"), F.max("_hash").alias("high")).where("low < high").select("band")
    inside = stored(rows.join(shared, "band").distinct(), "inside")
    discard(rows)
    wanted = sized(stored(inside.select("_hash").distinct(), "wanted"), 8)
    own = texts.join(wanted, "_hash", "left_semi").groupBy("_key").agg(F.first("_hash").alias("_hash"), F.first("_text").alias("_text"))
    # Read back, a number given while writing is a fixed one.
    candidates = stored(own.withColumn("_tid", F.monotonically_increasing_id()), "candidates")
    met = inside.join(candidates.select("_hash", "_tid"), "_hash").select("band", "_tid")
    ends = met.groupBy("band").agg(F.min("_tid").alias("low"), F.max("_tid").alias("high")).where("low < high")
    met = stored(met.join(ends, "band"), "met")
    discard(inside, wanted)
    low = met.where("_tid <> low").select(F.col("low").alias("a"), F.col("_tid").alias("b"))
    high = met.where("_tid <> high AND _tid <> low").select(F.col("high").alias("a"), F.col("_tid").alias("b"))
    tested = stored(low.union(high).distinct(), "pairs")
    links = stored(verified(tested, candidates, threshold), "links")
    label = components(links)
    discard(tested, links)
    held = met.select("band", "_tid").join(label, "_tid", "left").withColumn("class", F.coalesce("class", "_tid"))
    mixed = held.groupBy("band").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one < other").select("band")
    left = stored(met.select("band", "_tid").join(mixed, "band"), "unsure")
    discard(met)
    unsure = sized(stored(left.select("_tid").distinct(), "unsure"), 8)
    doubtful = stored(candidates.select("_tid", "_text").join(unsure, "_tid", "left_semi"), "unsure")
    often = common_shingles(doubtful, RARE)
    split = doubtful.join(label, "_tid", "left").join(often, "_tid", "left").withColumn("class", F.coalesce("class", "_tid"))
    split = stored(parts(split, threshold), "parts")
    pairs = stored(rare_pairs(split, threshold), "pairs")
    new = stored(verified(pairs, doubtful, threshold), "links")
    label = joined(label, new)
    pairs = common_pairs(split, left, label, threshold)
    if pairs is not None:
        new = stored(verified(stored(pairs, "pairs"), doubtful, threshold), "links")
        label = joined(label, new)
    discard(split, left, doubtful)
    names = candidates.select("_key", "_tid")
    heads = label.join(names.select(F.col("_key").alias("_class"), F.col("_tid").alias("class")), "class").select("_tid", "_class")
    out = stored(names.join(heads, "_tid", "left").select("_key", F.coalesce("_class", "_key").alias("_class")), "classes")
    discard(candidates, label)
    return out


def classed(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(_key, _least, _n, _class): the least id and the rows of each different text, and the key that stands for its class."""
    label = near_classes(keyed_texts(docs, text_col), threshold)
    ids = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key")).groupBy("_key").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    return ids.join(label, "_key", "left").withColumn("_class", F.coalesce("_class", "_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with class_id (the least id of the class) and class_size.

    Equal texts share a class, and so do texts that a chain of links joins. Texts
    without words are near no other, empty and null texts are equal. A document by
    itself is a class of one. Ids that repeat stay in their rows; null ids count
    last. Columns of docs with these two names are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("class_id", "class_size")]
    (key,) = fresh(docs, "_key")
    ids = classed(docs, id_col, text_col, threshold)
    whole = ids.groupBy("_class").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_size"))
    of = ids.join(whole, "_class").select(F.col("_key").alias(key), "class_id", "class_size")
    return docs.select(*rest, text_key(F.col(text_col)).alias(key)).join(of, key).drop(key)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each class the row with the least id stays, null ids last; of equal ids, that with the least key of its text.

    Classes are told apart by their texts: ids may be null or repeat on other texts.
    """
    ids = classed(docs, id_col, text_col, threshold)
    best = ids.groupBy("_class").agg(F.min(F.struct(F.col("_least").isNull().alias("none"), "_least", "_key")).alias("best"))
    best = best.select("_class", "best._least", "best._key")
    kept = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key")).join(best, "_key").where(F.col("_id").eqNullSafe(F.col("_least")))
    # Rows left of a class agree in id and text.
    return kept.groupBy("_class").agg(F.first("_doc").alias("_doc")).select("_doc.*")
