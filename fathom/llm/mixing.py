"""Mixing sources to target weights with DataFrame operations only.

Each document gets a hash-random key. Within its source the keys are cut into
equal ranges, a prefix sum of word counts runs inside each range and over the
range totals, and a source's last epoch is cut at its exact budget; the epochs
before it take every document whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WORD_WITH_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

OUTPUTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """sources (source, source_size) with each source's target.

    Sources in code point order, null last, weigh weights, repeating. Together the
    targets make up the sum of all sizes; none exceeds max_repeats times its
    source's size, and the excess goes to the others by weight. This is a summary
    with one row per source; its windows run over those rows alone.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sources.withColumn("_place", place).withColumn("_w", weight)
    s = s.withColumn("_cap", F.col("source_size") * max_repeats)
    s = s.withColumn("_total", F.sum("source_size").over(everything))
    # In the order of cap / weight, the sources that reach their caps come first.
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_before", before).withColumn("_from", from_here)
    s = s.withColumn("_full", F.col("_cap") * F.col("_from") <= (F.col("_total") - F.col("_before")) * F.col("_w"))
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    share = (F.col("_total") - used).cast("double") * F.col("_w") / open_w
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share)
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    rows_per_range: int = 100_000,
) -> DataFrame:
    """docs with size, source_size, target and taken (the words that the mix takes, repeats counted).

    The size of a row is its number of words, or size_col where given. A source's
    taken words make up its target, rounded to a whole word; the document at the
    cut is taken in part. The order is that of md5(id), then id and size: reruns
    agree, and rows that agree in all of these are interchangeable. A null text
    has size 0, a null source is a source, and a null id has the key of an empty
    one. An empty table gives an empty table. Columns of docs that bear the name
    of an output are replaced. rows_per_range only says how many rows a prefix sum
    runs over at a time; results don't depend on it.
    """
    given = F.col(size_col).cast("long") if size_col else word_count(F.col(text_col))
    rest = [c for c in docs.columns if c.lower() not in OUTPUTS]
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    named = F.when(F.col(source_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source_col)))
    d = docs.select(
        F.struct(*rest).alias("_row"), given.alias("size"), F.md5(id_text.cast("binary")).alias("_key"), named.alias("_named"), F.col(id_col).alias("_id")
    )
    sums = d.groupBy("_named").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    source = F.when(F.col("_named") != "0", F.substring("_named", 2, 1 << 30)).alias("source")
    rows = sums.agg(F.sum("_n")).first()[0] or 0
    bits = min(30, max(0, (rows // rows_per_range).bit_length()))
    d = d.withColumn("_range", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - bits))

    ranges = d.groupBy("_named", "_range").agg(F.sum("size").alias("_in_range"))
    earlier = Window.partitionBy("_named").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_named", "_range", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_named", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_upto", F.sum("size").over(inside)).join(ranges, ["_named", "_range"])

    targets = source_targets(sums.select(source, "source_size"), weights, max_repeats)
    named = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    d = d.join(targets.select(named.alias("_named"), "source_size", "target"), "_named")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    first = F.col("_start") + F.col("_upto") - F.col("size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left - first))
    return d.select("_row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: a row of docs per whole copy taken, and one with the first words for a part.

    A row without words is never taken. length_col, where present, follows the text.
    """
    columns = docs.columns
    m = mix(docs.select(F.struct(*columns).alias("_doc"), text_col, "doc_id", "source"), text_col=text_col, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.array_repeat(F.lit(0), whole.cast("int"))
    m = m.withColumn("_part", F.explode(F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD_WITH_GAP), F.lit(0)), F.lit(1), F.col("_part")), "")
    text = F.when(F.col("_part") > 0, first_words).otherwise(F.col(text_col))
    out = m.select("_doc", text.alias("_text"))
    replaced = {text_col: F.col("_text")} | ({length_col: F.length("_text").cast("long")} if length_col in columns else {})
    return out.select(*[replaced.get(c, F.col("_doc").getField(c)).alias(c) for c in columns])
