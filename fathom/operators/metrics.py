"""Counts, weights and scores of classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_weights(samples: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): weight = N / (classes that occur * n); absent classes weigh 0."""
    n = classes.select(label).join(samples.groupBy(label).agg(F.count("*").alias("n")), label, "left").fillna(0, ["n"])
    every = Window.partitionBy()
    total, present = F.sum("n").over(every), F.sum((F.col("n") > 0).cast("int")).over(every)
    return n.withColumn("weight", F.when(F.col("n") > 0, total / (present * F.col("n"))).otherwise(0.0))


def confusion(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(class, precision, recall, f1) of the classes that occur; 0 where a denominator is."""
    rows = counts.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    called = counts.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("called"))
    d = rows.join(called, "class", "left").fillna(0, ["called"])
    precision = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    d = d.withColumn("precision", precision).withColumn("recall", F.col("hit") / F.col("actual"))
    both = F.col("precision") + F.col("recall")
    return d.select("class", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def mean_loss(batches: DataFrame, *keys: str) -> DataFrame:
    """(keys, loss): the mean of batches' losses, weighted by their sizes n."""
    return batches.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
