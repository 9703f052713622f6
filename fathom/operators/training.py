"""Training of a linear classifier of clips as Spark jobs, and tables of trained models.

An epoch is one pass over the stored features: each task sums the weighted gradient
and what the scores need of its rows, Spark adds these up cell by cell, and only a
model's worth of numbers comes to the driver, which takes a step. The pass after a
step also judges it, so E epochs take E + 1 passes, and one more reads the test rows
by the best model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathom.operators import metrics, preprocess
from fathom.operators.tables import stored

SPLITS = ("train", "val", "test")

MODEL = "version string, labels array<string>, mode string, clip_len int, grid int, epoch int, selected_on string, mean array<double>, scale array<double>, weights array<array<double>>"
HISTORY = "epoch int, split string, n long, loss double, acc double, macro_f1 double"


@dataclass(frozen=True)
class Options:
    """epochs full passes; the rate falls from rate by half a cosine; a gradient longer than clip_norm is shortened to it."""

    epochs: int = 30
    rate: float = 0.05
    weight_decay: float = 1e-4
    clip_norm: float = 5.0


def pooled(x: np.ndarray, grid: int) -> np.ndarray:
    """The 3 * grid * grid numbers of a clip x (depth and mask, steps, side, side), by blocks in rows.

    First the mean depth of each block, then how it changes from the first half of
    the steps to the second (0 for one step), then the share of valid pixels.
    """
    edges = np.arange(grid) * x.shape[2] // grid
    sizes = np.diff(np.append(edges, x.shape[2]))
    sums = np.add.reduceat(np.add.reduceat(x.astype(np.float64), edges, axis=2), edges, axis=3)
    # One division by all pixels: a mean of means would round more than once.
    mean = lambda part: part.sum(axis=0) / (len(part) * np.outer(sizes, sizes))
    half = x.shape[1] // 2
    change = mean(sums[0, half:]) - mean(sums[0, :half]) if half else np.zeros((grid, grid))
    return np.concatenate([mean(sums[0]).ravel(), change.ravel(), mean(sums[1]).ravel()])


def clip_features(samples: DataFrame, side: int, grid: int = 4) -> DataFrame:
    """samples, as dataset_clips() gives them, with features in place of steps; see pooled(). side is at least grid; a clip without steps has null."""
    rest = [c for c in samples.columns if c not in ("steps", "features")]
    d = samples.select(*rest, "steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for clip in batch.column(len(rest)):
                if not clip.is_valid or not len(clip.values):
                    made.append(None)
                    continue
                x = np.stack([clip.values.field(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)])
                made.append(pooled(x.reshape(2, len(clip.values), side, side), grid))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(made, pa.list_(pa.float64()))], names=[*rest, "features"])

    return d.mapInArrow(run, d.drop("steps").withColumn("features", F.lit(None).cast("array<double>")).schema)


def scores(logits: np.ndarray) -> np.ndarray:
    """The log of softmax, row by row."""
    top = logits - logits.max(axis=1, keepdims=True)
    return top - np.log(np.exp(top).sum(axis=1, keepdims=True))


def one_pass(rows: DataFrame, theta: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[float, np.ndarray]]]:
    """The mean weighted gradient over the training rows, and by split the mean weighted loss and the counts (truth, guess).

    rows (nth split, y, features) may be any number; a task hands on theta's size and 3 * (2 + classes ** 2) sums.
    """
    classes, width = theta.shape
    each = 2 + classes * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, tally = np.zeros((classes, width)), np.zeros((len(SPLITS), each))
        for batch in batches:
            if not len(batch):
                continue
            split, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x = np.column_stack([(x - mean) / scale, np.ones(len(batch))])
            log_p = scores(x @ theta.T)
            w = weights[y]
            off = np.exp(log_p)
            off[np.arange(len(y)), y] -= 1
            of_train = split == 0
            gradient += (off[of_train] * w[of_train, None]).T @ x[of_train]
            np.add.at(tally, (split, 0), w)
            np.add.at(tally, (split, 1), -w * log_p[np.arange(len(y)), y])
            np.add.at(tally, (split, 2 + y * classes + log_p.argmax(axis=1)), 1)
        out = np.concatenate([gradient.ravel(), tally.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["cell", "value"])

    sums = np.zeros(classes * width + len(SPLITS) * each)
    for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        sums[r.cell] = r.value
    tally = sums[classes * width :].reshape(len(SPLITS), each)
    judged = {s: (t[1] / t[0] if t[0] else 0.0, t[2:].reshape(classes, classes)) for s, t in zip(SPLITS, tally, strict=True)}
    return sums[: classes * width].reshape(classes, width) / max(tally[0, 0], 1e-300), judged


def macro_f1(counts: np.ndarray) -> float:
    """The mean F1 of the classes that occur, as metrics.per_class() has it; 0 without any."""
    actual, called, hit = counts.sum(axis=1), counts.sum(axis=0), np.diag(counts)
    here = actual > 0
    return float((2 * hit / np.maximum(actual + called, 1))[here].mean()) if here.any() else 0.0


def train(features: DataFrame, labels: list[str], options: Options | None = None, mode: str = "absolute", clip_len: int = 0, grid: int = 0) -> dict[str, DataFrame]:
    """model, history and test_confusion (truth, guess, n) of a classifier of features (split, y, features).

    Classes weigh as in metrics.class_weights(). The model of the epoch with the best
    macro F1 on val is taken, the first of equals, or the last epoch without val
    rows. A row of another split, with y null or outside of labels, or whose features
    are null, of another length than most, or not all finite, takes no part. Fewer
    than two labels, and no training rows, are errors. mode, clip_len and grid are
    kept with the model.
    """
    options = options or Options()
    if len(labels) < 2:
        raise ValueError(f"training needs two labels or more, there are {labels}")
    spark, classes = features.sparkSession, len(labels)
    known = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")).cast("int") - 1
    sound = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    d = features.select(known.alias("split"), F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))
    d = d.where((F.col("split") >= 0) & F.col("y").between(0, classes - 1) & (F.size("features") > 0) & sound)
    # Read once for each epoch.
    d = stored(d, "training")
    lengths = d.where("split = 0").groupBy(F.size("features").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        raise ValueError("no training rows")
    d = d.where(F.size("features") == lengths.n)
    of_train = d.where("split = 0")
    cells = of_train.select(F.posexplode("features").alias("cell", "v")).groupBy("cell").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    cells = cells.orderBy("cell").collect()  # a row per feature
    mean, std = np.array([r["mean"] for r in cells]), np.array([r["std"] for r in cells])
    scale = np.where(std > 1e-12, std, 1.0)
    weighed = metrics.class_weights(of_train, spark.range(classes).select(F.col("id").cast("int").alias("y")), "y").orderBy("y").collect()  # a row per class
    weights = np.array([r.weight for r in weighed], float)

    theta = np.zeros((classes, len(mean) + 1))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    gradient, judged = one_pass(d, theta, mean, scale, weights)
    has_val = judged["val"][1].sum() > 0
    history, best = [], (-1.0, 0, theta)
    entry = lambda epoch, split, loss, n: (epoch, split, int(n.sum()), float(loss), float(np.trace(n) / max(1, n.sum())), macro_f1(n))
    for epoch in range(1, options.epochs + 1):
        history.append(entry(epoch, "train", *judged["train"]))
        rate = options.rate * (1 + np.cos(np.pi * (epoch - 1) / options.epochs)) / 2
        gradient = gradient * min(1.0, options.clip_norm / (np.linalg.norm(gradient) + 1e-6))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = first / (1 - 0.9**epoch) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        theta = theta - rate * (step + options.weight_decay * theta)
        gradient, judged = one_pass(d, theta, mean, scale, weights)
        score = macro_f1(judged["val"][1]) if has_val else float(epoch)
        if has_val:
            history.append(entry(epoch, "val", *judged["val"]))
        if score > best[0]:
            best = (score, epoch, theta)
    _, judged = one_pass(d, best[2], mean, scale, weights)
    tested = judged["test"][1]
    if tested.sum():
        history.append(entry(best[1], "test", *judged["test"]))
    chosen = (preprocess.VERSION, labels, mode, clip_len, grid, best[1], "val_macro_f1" if has_val else "final_epoch", mean.tolist(), scale.tolist(), best[2].tolist())
    pairs = [(labels[t], labels[g], int(tested[t, g])) for t in range(classes) for g in range(classes) if tested[t, g]]
    return {
        "model": spark.createDataFrame([chosen], MODEL),
        "history": spark.createDataFrame(history, HISTORY),
        "test_confusion": spark.createDataFrame(pairs, "truth string, guess string, n long"),
    }


def save(trained: dict[str, DataFrame], path: str) -> None:
    for name, d in trained.items():
        d.coalesce(1).write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Row:
    """The model that save() left under path; one of another preprocessing is refused."""
    model = spark.read.schema(MODEL).parquet(f"{path}/model").first()
    if model.version != preprocess.VERSION:
        raise ValueError(f"the model was trained on preprocessing {model.version}, this is {preprocess.VERSION}: train it again")
    return model


def logits(model: Row, x: np.ndarray) -> np.ndarray:
    """(n, classes) of features (n, width)."""
    theta = np.array(model.weights)
    return (x - np.array(model["mean"])) / np.array(model.scale) @ theta[:, :-1].T + theta[:, -1]


def predict(features: DataFrame, model: Row) -> DataFrame:
    """features with probs, a probability per label in order; null where features are null, of another length or not all finite."""
    rest = [c for c in features.columns if c != "probs"]
    d = features.select(*rest)
    width, place = len(model["mean"]), rest.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if v is None else np.array(v, float) for v in batch.column(place).to_pylist()]
            good = [k for k, v in enumerate(rows) if v is not None and len(v) == width and np.isfinite(v).all()]
            made = [None] * len(rows)
            if good:
                for k, p in zip(good, np.exp(scores(logits(model, np.stack([rows[k] for k in good])))), strict=True):
                    made[k] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*rest, "probs"])

    return d.mapInArrow(run, d.withColumn("probs", F.lit(None).cast("array<double>")).schema)


def clip_model(model: Row) -> Callable[[np.ndarray], np.ndarray]:
    """The model as the live reader takes it: logits of one clip (depth and mask, steps, side, side)."""
    return lambda x: logits(model, pooled(np.asarray(x), model.grid)[None])[0]
