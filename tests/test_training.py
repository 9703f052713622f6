"""Distributed training against a plain fit, model tables, features of clips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import preprocess, training

LABELS = ["a", "b", "c"]


def rows_of(n=240, seed=3):
    r = np.random.default_rng(seed)
    y = r.choice(3, n, p=[0.6, 0.3, 0.1])
    x = r.normal(size=(n, 4)) + np.eye(3, 4)[y] * 1.5
    split = r.choice(["train", "val", "test"], n, p=[0.6, 0.2, 0.2])
    return [(s, int(k), v.tolist()) for s, k, v in zip(split, y, x, strict=True)]


def plain(rows, o):
    """The same fit in loops over rows: history of (epoch, split, loss) and the parameters of the best epoch."""
    fit = [r for r in rows if r[0] == "train"]
    x = np.array([r[2] for r in fit])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    n = [sum(r[1] == c for r in fit) for c in range(3)]
    w = [len(fit) / (3 * k) for k in n]

    def judge(theta, part):
        grad, loss, total, counts = np.zeros_like(theta), 0.0, 0.0, np.zeros((3, 3))
        for _, y, v in part:
            z = np.append((np.array(v) - mean) / scale, 1.0)
            e = [math.exp(float(t @ z)) for t in theta]
            p = [k / sum(e) for k in e]
            for c in range(3):
                grad[c] += w[y] * (p[c] - (c == y)) * z
            loss -= w[y] * math.log(p[y])
            total += w[y]
            counts[y, int(np.argmax(p))] += 1
        f1 = []
        for c in range(3):
            precision = counts[c, c] / counts[:, c].sum() if counts[:, c].sum() else 0.0
            recall = counts[c, c] / counts[c].sum()
            f1.append(2 * precision * recall / (precision + recall) if precision + recall else 0.0)
        return grad / total, loss / total, float(np.mean(f1))

    theta, m, v = (np.zeros((3, 5)) for _ in range(3))
    val, history, best = [r for r in rows if r[0] == "val"], [], (-1, 0, theta)
    for e in range(1, o.epochs + 1):
        g, loss, _ = judge(theta, fit)
        history.append((e, "train", loss))
        norm = math.sqrt(float((g**2).sum()))
        g = g * min(1.0, o.clip_norm / (norm + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = o.rate * 0.5 * (1 + math.cos(math.pi * (e - 1) / o.epochs))
        theta = theta * (1 - rate * o.weight_decay) - rate * (m / (1 - 0.9**e)) / (np.sqrt(v / (1 - 0.999**e)) + 1e-8)
        _, loss, f1 = judge(theta, val)
        history.append((e, "val", loss))
        if f1 > best[0]:
            best = (f1, e, theta)
    return history, best


def test_training_equals_a_plain_fit(spark, tmp_path):
    rows, o = rows_of(), training.Options(epochs=6, rate=0.3, clip_norm=0.4)
    broken = [("train", 7, [0.0] * 4), ("train", None, [0.0] * 4), ("train", 1, None), ("train", 1, [1.0, None, 0.0, 0.0]), ("val", 1, [math.nan] * 4), ("val", 1, [1.0]), ("other", 1, [1.0] * 4), (None, 1, [1.0] * 4)]
    d = spark.createDataFrame(rows + broken, "split string, y int, features array<double>").repartition(5)
    out = training.train(d, LABELS, o, clip_len=16, grid=2)
    history, (f1, epoch, theta) = plain(rows, o)
    got = {(r.epoch, r.split): r for r in out["history"].collect()}
    assert set(got) == {(e, s) for e, s, _ in history} | {(epoch, "test")}
    assert all(abs(got[e, s].loss - loss) < 1e-9 for e, s, loss in history)
    assert abs(got[epoch, "val"].macro_f1 - f1) < 1e-12 and got[1, "train"].n == sum(r[0] == "train" for r in rows)
    training.save(out, str(tmp_path / "m"))
    model = training.load(spark, str(tmp_path / "m"))
    assert np.allclose(model.weights, theta, atol=1e-9) and (model.epoch, model.selected_on, model.grid) == (epoch, "val_macro_f1", 2)
    said = training.predict(d, model).where("split = 'test'").collect()
    right = sum(int(np.argmax(r.probs)) == r.y for r in said)
    counts = {(r.truth, r.guess): r.n for r in out["test_confusion"].collect()}
    assert right == sum(n for (t, g), n in counts.items() if t == g) and sum(counts.values()) == len(said)
    assert abs(got[epoch, "test"].acc - right / len(said)) < 1e-12
    assert training.predict(d, model).where("probs IS NULL").count() == 4


def test_without_val_rows_the_last_epoch_is_taken(spark):
    d = spark.createDataFrame([r for r in rows_of(60) if r[0] == "train"], "split string, y int, features array<double>")
    out = training.train(d, LABELS, training.Options(epochs=2))
    model = out["model"].first()
    assert (model.epoch, model.selected_on) == (2, "final_epoch") and out["test_confusion"].count() == 0
    assert {r.split for r in out["history"].collect()} == {"train"}


def test_nothing_to_train_on_is_an_error(spark, tmp_path):
    d = spark.createDataFrame([("val", 0, [1.0])], "split string, y int, features array<double>")
    with pytest.raises(ValueError, match="two labels"):
        training.train(d, ["a"])
    with pytest.raises(ValueError, match="no training rows"):
        training.train(d, LABELS)
    old = training.train(d.withColumn("split", F.lit("train")), LABELS, training.Options(epochs=1))
    old["model"] = old["model"].withColumn("version", F.lit("0"))
    training.save(old, str(tmp_path / "old"))
    with pytest.raises(ValueError, match=preprocess.VERSION):
        training.load(spark, str(tmp_path / "old"))


def test_features_of_a_clip(spark):
    r = np.random.default_rng(1)
    x = r.random((2, 3, 5, 5)).round(3)
    want = [[], [], []]
    for rows in (range(2), range(2, 5)):
        for cols in (range(2), range(2, 5)):
            mean = lambda k, steps: np.mean([x[k, t, i, j] for t in steps for i in rows for j in cols])  # noqa: B023, E731
            want[0].append(mean(0, range(3)))
            want[1].append(mean(0, range(1, 3)) - mean(0, range(1)))
            want[2].append(mean(1, range(3)))
    assert np.allclose(training.pooled(x, 2), np.concatenate(want))
    steps = [(x[0, t].ravel().tolist(), x[1, t].ravel().tolist()) for t in range(3)]
    d = spark.createDataFrame([(1, steps, 9), (2, None, 9), (3, [], 9)], "clip_id long, steps array<struct<depth:array<float>,mask:array<float>>>, features int")
    got = {r.clip_id: r.features for r in training.clip_features(d, 5, 2).collect()}
    assert np.allclose(got[1], np.concatenate(want), atol=1e-6) and got[2] is None and got[3] is None
    model = spark.createDataFrame([("v", ["a", "b"], "deform", 3, 2, 1, "", [0.0] * 12, [2.0] * 12, [[1.0] * 13, [0.0] * 12 + [3.0]])], training.MODEL).first()
    assert np.allclose(training.clip_model(model)(x), [sum(map(sum, want)) / 2 + 1, 3.0])
