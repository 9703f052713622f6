"""The convolutional network against direct loops and differences of its loss; its training, model tables and the live reader."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import network, preprocess, training
from fathom.operators.network import Network

STEPS = "array<struct<depth:array<float>,mask:array<float>>>"


def by_loops(net, theta, moments, x):
    """The logits of one clip, number by number."""
    parts, norms = net.parts(theta), net.of_moments(moments)
    for k, (n_in, n_out) in enumerate(net.convolutions):
        w, (gain, shift), (mean, var) = parts[3 * k].reshape(n_out, n_in, 3, 3, 3), parts[3 * k + 1 : 3 * k + 3], norms[k]
        _, steps, h, wide = x.shape
        made = np.zeros((n_out, steps, h, wide))
        for o, t, i, j in np.ndindex(*made.shape):
            total = 0.0
            for c, a, b, e in np.ndindex(n_in, 3, 3, 3):
                p, q, r = t + a - 1, i + b - 1, j + e - 1
                if 0 <= p < steps and 0 <= q < h and 0 <= r < wide:
                    total += w[o, c, a, b, e] * x[c, p, q, r]
            made[o, t, i, j] = max(0.0, (total - mean[o]) / math.sqrt(var[o] + 1e-5) * gain[o] + shift[o])
        x = made
        if k % 2:
            pt, ph, pw = net.pools[k // 2]
            out = np.zeros((n_out, steps // pt, h // ph, wide // pw))
            for o, t, i, j in np.ndindex(*out.shape):
                out[o, t, i, j] = max(made[o, t * pt + a, i * ph + b, j * pw + c] for a in range(pt) for b in range(ph) for c in range(pw))
            x = out
    means = [float(c.mean()) for c in x]
    return [sum(m * v for m, v in zip(means, row, strict=True)) + b for row, b in zip(parts[-2], parts[-1], strict=True)]


def made_up(net, seed):
    r = np.random.default_rng(seed)
    moments = np.concatenate([v for _, o in net.convolutions for v in (r.normal(0, 0.1, o), r.random(o) + 0.5)])
    return net.first(seed) + r.normal(0, 0.1, net.n_parameters), moments


def frame_of(spark, rows):
    """Rows of (split, y, clip_id, clip); a clip is an array, or what stands in steps."""
    steps = lambda x: [(x[0, t].ravel().tolist(), x[1, t].ravel().tolist()) for t in range(x.shape[1])] if isinstance(x, np.ndarray) else x
    return spark.createDataFrame([(*r[:3], steps(r[3])) for r in rows], f"split string, y int, clip_id long, steps {STEPS}")


def clips(n, seed=1, steps=4, side=5):
    """Clips whose depth grows or falls with time, by y."""
    r = np.random.default_rng(seed)
    ramp = np.linspace(-1, 1, steps)[:, None, None]
    out = []
    for k in range(n):
        y = int(r.integers(2))
        depth = np.clip((1 if y else -1) * ramp * 0.6 + r.normal(0, 0.2, (steps, side, side)), -1, 1)
        mask = (r.random((steps, side, side)) < 0.9).astype(float)
        out.append((("train", "train", "train", "val", "test")[k % 5], y, k, np.stack([depth * mask, mask]).astype(np.float32)))
    return out


def test_logits_equal_direct_loops():
    net = Network(3, 2, ((1, 2, 2), (2, 2, 2)))
    theta, moments = made_up(net, 4)
    x = np.random.default_rng(2).normal(size=(2, 2, 3, 5, 6))
    got = network.logits(net, theta, moments, x)
    assert np.allclose(got, [by_loops(net, theta, moments, clip) for clip in x], atol=1e-12)


def test_shapes_of_the_whole_network():
    net = Network(6)
    assert net.convolutions == [(2, 16), (16, 16), (16, 32), (32, 32), (32, 64), (64, 64), (64, 128), (128, 128)]
    assert net.parts(net.first())[-2].shape == (6, 128) and net.fits(8, 16) and not net.fits(7, 16) and not net.fits(8, 15)


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_the_gradient_equals_differences_of_the_loss(spark, dropout):
    net = Network(2, 2, ((1, 2, 2), (2, 2, 2)))
    theta, moments = made_up(net, 7)
    rows, weights = clips(10), np.array([0.7, 1.6])
    d = frame_of(spark, rows).withColumn("split", F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)).repartition(3)
    gradient, found, judged = network.one_pass(d, net, 5, theta, moments, weights, dropout, 2)
    fit = [r for r in rows if r[0] == "train"]
    x, y = np.stack([r[3] for r in fit]).astype(float), [r[1] for r in fit]
    kept = network.dropped([r[2] for r in fit], 4, dropout, 2) if dropout else 1.0

    def loss(at, kept):
        means, _ = network.forward(net, at, moments, x)
        log_p = training.scores((means * kept) @ net.parts(at)[-2].T + net.parts(at)[-1])
        return -sum(weights[k] * log_p[i, k] for i, k in enumerate(y)) / sum(weights[k] for k in y)

    assert abs(judged["train"][0] - loss(theta, 1.0)) < 1e-12 and judged["val"][1].sum() == 2
    for k in np.random.default_rng(0).choice(net.n_parameters, 60, replace=False).tolist() + [net.n_parameters - 1]:
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert abs((loss(theta + step, kept) - loss(theta - step, kept)) / 2e-6 - gradient[k]) < 1e-6
    made = network.convolved(x, net.parts(theta)[0])
    assert np.allclose(net.of_moments(found)[0], [made.mean(axis=(0, 2, 3, 4)), made.var(axis=(0, 2, 3, 4))])


def test_training_learns_and_its_model_is_kept(spark, tmp_path):
    rows = clips(60)
    one = rows[0][3]
    broken = [("train", 5, 900, one), ("train", None, 901, one), ("train", 0, None, one), ("train", 0, 902, None), ("train", 0, 903, []), ("train", 0, 904, one[:, :1]), ("val", 0, 905, one[:, :, :3]), ("val", 0, 906, one * math.nan), (None, 0, 907, one), ("x", 0, 908, one), ("val", 0, 909, [None] * 4), ("val", 1, 910, [([None] * 25, [1.0] * 25)] * 4)]
    d = frame_of(spark, rows + broken).repartition(4)
    out = network.train(d, 5, ["falls", "grows"], training.Options(epochs=8, rate=0.05), width=2, pools=((2, 2, 2),), clip_len=4)
    history = {(r.epoch, r.split): r for r in out["history"].collect()}
    assert history[1, "train"].n == 36 and history[1, "val"].n == 12
    assert history[8, "train"].loss < history[1, "train"].loss * 0.7
    training.save(out, str(tmp_path / "m"))
    model = network.load(spark, str(tmp_path / "m"))
    assert history[model.epoch, "test"].acc >= 0.9 and model.selected_on == "val_macro_f1"
    said = {r.clip_id: r for r in network.predict(d.where("clip_id < 60 OR clip_id IN (902, 904)").withColumn("probs", F.lit("x")), model).collect()}
    assert len(said) == 62 and said[902].probs is None and said[904].logits is None
    live = network.clip_model(model)
    assert all(np.allclose(said[r[2]].logits, live(r[3])) and abs(sum(said[r[2]].probs) - 1) < 1e-9 for r in rows)
    test = [r for r in rows if r[0] == "test"]
    assert abs(np.mean([int(np.argmax(said[r[2]].probs)) == r[1] for r in test]) - history[model.epoch, "test"].acc) < 1e-12
    assert sum(r.n for r in out["test_confusion"].collect()) == len(test)
    again = network.train(d.repartition(2), 5, ["falls", "grows"], training.Options(epochs=2, rate=0.05), width=2, pools=((2, 2, 2),))
    assert abs(again["history"].where("epoch = 2 AND split = 'train'").first().loss - history[2, "train"].loss) < 0.05


def test_nothing_to_train_on_is_an_error(spark, tmp_path):
    d = frame_of(spark, clips(5))
    with pytest.raises(ValueError, match="two labels"):
        network.train(d, 5, ["a"])
    with pytest.raises(ValueError, match="no training rows"):
        network.train(d.where("split = 'val'"), 5, ["a", "b"], pools=((2, 2, 2),))
    with pytest.raises(ValueError, match="pools"):
        network.train(d, 5, ["a", "b"])
    row = ("0", ["a", "b"], "absolute", 4, 5, 2, [[2, 2, 2]], 1, "", [0.0], [0.0])
    spark.createDataFrame([row], network.MODEL).write.parquet(str(tmp_path / "old/model"))
    with pytest.raises(ValueError, match=preprocess.VERSION):
        network.load(spark, str(tmp_path / "old"))


def test_the_live_reader_takes_a_network():
    from fathom.operators.preprocess import Params
    from fathom.streaming.live import Reader

    net = Network(2, 2, ((2, 2, 2),))
    theta, moments = made_up(net, 3)

    class Kept:
        labels, width, pools = ["a", "b"], 2, [[2, 2, 2]]

    Kept.theta, Kept.moments = theta, moments
    params = Params(out_size=5, expected_distance_m=0.16, search_band_m=0.03, clip_mm=12.0, roi_margin=1.0, min_relief_mm=0.1, coverage_thresh=0.3)
    reader = Reader(params, 0.0001, "absolute", 4, 2, 0.6, 5)
    r, said = np.random.default_rng(5), []
    bowl = 1600 + ((np.mgrid[:16, :16] - 7.5) ** 2).sum(axis=0)
    for k in range(20):
        p = reader.frame((bowl + r.integers(0, 9, (16, 16))).astype(np.int64), network.clip_model(Kept), k / 30)
        if p is not None:
            said.append(p)
            z = network.logits(net, theta, moments, reader.input()[None])[0]
            now = np.exp(z) / np.exp(z).sum()
            want = now if len(said) == 1 else 0.6 * want + 0.4 * now
            assert np.allclose(p, want)
    assert len(said) >= 5 and reader.problem is None
