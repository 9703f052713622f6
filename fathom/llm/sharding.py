"""Sharding by vector bin packing over bytes, tokens and rows.

Groups are equal texts. Each group goes, by its own vector, to the shard where the
dot product of that vector and the residual capacity is highest. Groups that are
large against the whole are placed first, on the driver: their number is bounded.
The others are dealt to parts of groups of about one size; a task places the groups
of a part one by one into its part of the capacity that the large ones left.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.mixing import word_count
from fathom.llm.stage import sized, stored

#: A group over 1 / ALONE of all bytes, tokens or rows is placed on the driver: 3 * ALONE of them at most.
ALONE = 4096
#: Groups of a part of the others, about.
PER_PART = 4096
#: A group over one shard's share is placed in so many parts, by a hash of each row.
PARTS = 64

NAMES = ["bytes", "tokens", "rows"]


def pack_vectors(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A shard for each row of vectors; large rows first, ties by place. room, what each shard can take, is lessened."""
    out = np.empty(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        v = vectors[i]
        gain = room @ v
        fits = (room >= v).all(axis=1)
        out[i] = np.argmax(np.where(fits, gain, -np.inf)) if fits.any() else np.argmax(gain)
        room[out[i]] -= v
    return out


def tiers(counts: dict[int, int], per_part: int = PER_PART) -> dict[int, tuple[int, int]]:
    """Level: (tier, its number of parts), for the counts of groups by level, a level holding half the size of the one before.

    A tier is one level or more that hold per_part groups together, so parts of it
    hold about as many, but for the last tier, which may hold less.
    """
    out, here, n = {}, [], 0
    for level in sorted(counts):
        here.append(level)
        n += counts[level]
        if n >= per_part:
            out |= {x: (here[0], n // per_part) for x in here}
            here, n = [], 0
    return out | {x: (here[0], 1) for x in here}


def place_small(groups: DataFrame, total: np.ndarray, room: np.ndarray, per_part: int = PER_PART) -> DataFrame:
    """(text, shard) of groups (text, bytes, tokens, rows, level), each placed by its own vector in a task of its part.

    A part's capacity is room, shared out by the part's bytes, tokens and rows. The
    shards are turned by the number of the part, so that ties and last groups
    don't meet in the first ones.
    """
    sums = groups.groupBy("level").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in NAMES]).collect()  # a row per level: 64 at most
    if not sums:
        return groups.select("text", F.lit(0).alias("shard"))
    parts_of = tiers({r.level: r.n for r in sums}, per_part)
    every = np.array([[r[c] for c in NAMES] for r in sums], float).sum(axis=0).clip(1)
    known = F.create_map(*[x for level, t in parts_of.items() for x in (F.lit(level), F.struct(F.lit(t[0]).alias("tier"), F.lit(t[1]).alias("parts")))])
    own = F.element_at(known, F.col("level"))
    d = groups.select("text", *NAMES, own["tier"].alias("tier"), F.pmod(F.xxhash64("text"), own["parts"]).alias("part"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text", ignore_index=True)
        vectors = rows[NAMES].to_numpy(float)
        turn = (int(key[0]) + int(key[1])) % len(room)
        chosen = pack_vectors(vectors / total, np.roll(room * (vectors.sum(axis=0) / every), turn, axis=0))
        return pd.DataFrame({"text": rows["text"], "shard": ((chosen - turn) % len(room)).astype(np.int32)})

    return d.groupBy("tier", "part").applyInPandas(run, "text string, shard int")


def place(measures: DataFrame, n_shards: int = 16, id_col: str = "doc_id", rows_per_range: int = 100_000, per_part: int = PER_PART) -> DataFrame:
    """The rows of measured() with shard and slot; the struct _m goes.

    Equal texts share a shard unless they exceed a shard's share of bytes, tokens
    or rows; such a group is split by a hash of each row. measures is a
    stored table. slot counts from 0 in
    each shard without gaps, in the order of the id's hash. A null text is
    an empty text, null ids are placed like any other, rows that agree in id and
    text are interchangeable, an empty table gives an empty table.
    """
    spark = measures.sparkSession
    d = measures.select(F.col("_m.doc").alias("doc"), "_m.id", "_m.size", "_m.crc", "_m.tokens", "_m.text", "_m.part")
    sizes = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    # One row per different text.
    groups = stored(d.groupBy("text").agg(*sizes), "groups")
    total = groups.agg(*[F.sum(c).alias(c) for c in NAMES]).first()
    n = np.array([float(total[c] or 0) for c in NAMES]).clip(1)
    share = F.greatest(*[F.col(c) / float(x) for c, x in zip(NAMES, n, strict=True)])
    large = groups.where(share > 1 / ALONE).toPandas().sort_values("text", ignore_index=True)

    over = (large[NAMES] / n).max(axis=1) > 1 / n_shards if len(large) else np.zeros(0, bool)
    items = [(("text", t, None), v) for t, v in zip(large["text"][~over], large.loc[~over, NAMES].to_numpy(float), strict=True)] if len(large) else []
    if np.any(over):
        split = spark.createDataFrame([(t,) for t in large["text"][over]], "text string")
        rows = d.join(F.broadcast(split), "text").groupBy("text", "part").agg(*sizes).toPandas().sort_values(["text", "part"])
        items += [(("part", t, int(p)), v) for t, p, v in zip(rows["text"], rows["part"], rows[NAMES].to_numpy(float), strict=True)]
    room = np.full((n_shards, len(NAMES)), 1.0 / n_shards)
    shards = pack_vectors(np.array([v for _, v in items]) / n, room) if items else []

    level = F.floor(-F.log2(share)).cast("int").alias("level")
    of_text = place_small(groups.where(share <= 1 / ALONE).select("text", *NAMES, level), n, room, per_part)
    own = spark.createDataFrame([(key, int(s)) for ((what, key, _), _), s in zip(items, shards, strict=True) if what == "text"], "text string, shard int")
    of_text = sized(stored(of_text.unionByName(own), "shards"), 48)
    halves = spark.createDataFrame([(key, p, int(s)) for ((what, key, p), _), s in zip(items, shards, strict=True) if what == "part"], "text string, part long, in_part int")
    placed = d.join(of_text, "text", "left").join(F.broadcast(halves), ["text", "part"], "left")  # PARTS rows per group over a shard at most
    placed = placed.select("doc", "id", "size", "crc", "text", F.coalesce("in_part", "shard").alias("shard"))

    ranges = max(1, int(n[2]) // (rows_per_range * n_shards))
    placed = placed.withColumn("order", F.xxhash64(F.lit(2), "id")).withColumn("range", F.pmod("order", F.lit(ranges)))
    per = placed.groupBy("shard", "range").agg(F.count("*").alias("m"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "range").orderBy("order", "id", "text")
    placed = placed.withColumn("nth", F.row_number().over(inside)).join(per, ["shard", "range"])
    slot = (F.col("begin") + F.col("nth") - 1).alias("slot")
    return placed.select("doc.*", "size", F.col("crc").alias("text_crc32"), "shard", slot)


OUTPUTS = ("size", "text_crc32", "shard", "slot")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One column _m: the columns of docs (or those of keep) that place() hands through, and what it needs of each row.

    Columns with the names of OUTPUTS are left out: place() makes them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in keep or docs.columns if c.lower() not in OUTPUTS]
    m = F.struct(
        F.struct(*rest).alias("doc"),
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        word_count(F.col(text_col)).alias("tokens"),
        F.md5(text.cast("binary")).alias("text"),
        # The row's place is in it, so that rows of one id are split too.
        F.pmod(F.xxhash64(F.lit(1), id_col, F.monotonically_increasing_id()), F.lit(PARTS)).alias("part"),
    )
    return docs.select(m.alias("_m"))


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, text_crc32, shard and slot; see place(). Columns of docs with these names are replaced."""
    return place(stored(measured(docs, id_col, text_col), "sharding"), n_shards, id_col)
