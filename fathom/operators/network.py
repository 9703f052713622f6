"""A 3-D convolutional network over clips: its forward and backward passes in numpy inside tasks, and its training as Spark jobs.

Blocks of two convolutions, each normalised and rectified, and a max pool; then the
mean over steps and pixels and a linear layer. An epoch is one pass over the stored
samples: tasks sum the weighted gradient, what the normalisation needs and the
scores, Spark adds these up in parts of the model, and the driver takes a step.
Normalisation uses the moments that the pass before measured over all training
clips, as constants; so a model is judged exactly as it is saved.
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
from fathom.operators.training import SPLITS, Options, macro_f1, scores

MODEL = "version string, labels array<string>, mode string, clip_len int, side int, width int, pools array<array<int>>, epoch int, selected_on string, theta array<double>, moments array<double>"
HISTORY = "epoch int, split string, n long, loss double, acc double, macro_f1 double"
#: Depth and mask come in; the pools of the four blocks (steps, rows, columns); what is added to a variance.
CHANNELS, POOLS, EPS = 2, ((1, 2, 2), (2, 2, 2), (2, 2, 2), (2, 2, 2)), 1e-5
#: Pixels of a step of all clips that are worked on together: one clip of 128 x 128, many small ones.
AT_ONCE = 1 << 14
#: Numbers of a model that are summed up together; a sum reads so many of each task.
PART = 1 << 8


@dataclass(frozen=True)
class Network:
    """The shape of a network. A block has width * 2 ** k channels, k from 0."""

    classes: int
    width: int = 16
    pools: tuple[tuple[int, int, int], ...] = POOLS

    @property
    def convolutions(self) -> list[tuple[int, int]]:
        """Channels in and out of each convolution."""
        outs = [self.width << k for k in range(len(self.pools))]
        return [pair for k, n in enumerate(outs) for pair in ((outs[k - 1] if k else CHANNELS, n), (n, n))]

    @property
    def sizes(self) -> list[tuple[int, ...]]:
        """The shapes of the parameters, in order: weights, gain and shift of each convolution, then the last layer and its bias."""
        each = [s for i, o in self.convolutions for s in ((o, i * 27), (o,), (o,))]
        return [*each, (self.classes, self.convolutions[-1][1]), (self.classes,)]

    def parts(self, theta: np.ndarray) -> list[np.ndarray]:
        """Views of theta by sizes."""
        ends = np.cumsum([int(np.prod(s)) for s in self.sizes])
        return [p.reshape(s) for p, s in zip(np.split(theta, ends[:-1]), self.sizes, strict=True)]

    @property
    def n_parameters(self) -> int:
        return sum(int(np.prod(s)) for s in self.sizes)

    def first(self, seed: int = 0) -> np.ndarray:
        """Parameters to start from: normal weights by the number of inputs, gains of 1, the rest 0."""
        r, made = np.random.default_rng(seed), []
        for k, s in enumerate(self.sizes):
            weights = len(s) == 2
            made.append(r.normal(0, np.sqrt((2 if k < len(self.sizes) - 2 else 1) / s[1]), s) if weights else np.ones(s) if k % 3 == 1 and k < len(self.sizes) - 2 else np.zeros(s))
        return np.concatenate([m.ravel() for m in made])

    def plain_moments(self) -> np.ndarray:
        """Means of 0 and variances of 1, for each channel of each convolution."""
        return np.concatenate([np.repeat([0.0, 1.0], o) for _, o in self.convolutions])

    def of_moments(self, moments: np.ndarray) -> list[np.ndarray]:
        """(2, channels) of each convolution."""
        ends = np.cumsum([2 * o for _, o in self.convolutions])
        return [m.reshape(2, -1) for m in np.split(moments, ends[:-1])]

    def fits(self, steps: int, side: int) -> bool:
        """Whether something is left of such a clip after all pools."""
        left = np.array([steps, side, side]) // np.prod(np.array(self.pools, int).reshape(-1, 3), axis=0)
        return bool((left >= 1).all())


def columns(padded: np.ndarray, t: int) -> np.ndarray:
    """The neighbourhoods of all pixels of step t as rows: (n * h * w, channels * 27) of padded (n, channels, steps + 2, h + 2, w + 2)."""
    seen = np.lib.stride_tricks.sliding_window_view(padded[:, :, t : t + 3], (3, 3), axis=(3, 4))
    n, _, _, h, w = seen.shape[:5]
    return seen.transpose(0, 3, 4, 1, 2, 5, 6).reshape(n * h * w, -1)


def convolved(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(n, out, steps, h, w) of x (n, in, steps, h, w): sums over 3 x 3 x 3 neighbours, zeros outside."""
    n, _, steps, h, w = x.shape
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1), (1, 1)))
    out = np.empty((n, len(weights), steps, h, w))
    for t in range(steps):
        out[:, :, t] = (columns(padded, t) @ weights.T).reshape(n, h, w, -1).transpose(0, 3, 1, 2)
    return out


def convolved_back(x: np.ndarray, weights: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slopes of the weights and of x, from that of convolved()."""
    n, channels, steps, h, w = x.shape
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1), (1, 1)))
    of_weights, of_x = np.zeros_like(weights), np.zeros_like(padded)
    for t in range(steps):
        g = slope[:, :, t].transpose(0, 2, 3, 1).reshape(n * h * w, -1)
        of_weights += g.T @ columns(padded, t)
        spread = (g @ weights).reshape(n, h, w, channels, 3, 3, 3).transpose(0, 3, 4, 5, 6, 1, 2)
        for a in range(3):
            for b in range(3):
                of_x[:, :, t : t + 3, a : a + h, b : b + w] += spread[:, :, :, a, b]
    return of_weights, of_x[:, :, 1:-1, 1:-1, 1:-1]


def _windows(x: np.ndarray, pool: tuple[int, int, int]) -> np.ndarray:
    """The windows of a pool along the last axis; what is left over at an end is cut off."""
    sizes = [s // p for s, p in zip(x.shape[2:], pool, strict=True)]
    cut = x[:, :, : sizes[0] * pool[0], : sizes[1] * pool[1], : sizes[2] * pool[2]]
    parted = cut.reshape(*x.shape[:2], sizes[0], pool[0], sizes[1], pool[1], sizes[2], pool[2])
    return parted.transpose(0, 1, 2, 4, 6, 3, 5, 7).reshape(*x.shape[:2], *sizes, -1)


def _pooled_back(x: np.ndarray, pool: tuple[int, int, int], slope: np.ndarray) -> np.ndarray:
    """The slope of x, all of it at the first greatest value of each window."""
    seen = _windows(x, pool)
    put = np.zeros_like(seen)
    np.put_along_axis(put, seen.argmax(axis=-1)[..., None], slope[..., None], axis=-1)
    sizes = slope.shape[2:]
    parted = put.reshape(*slope.shape, *pool).transpose(0, 1, 2, 5, 3, 6, 4, 7)
    out = np.zeros_like(x)
    out[:, :, : sizes[0] * pool[0], : sizes[1] * pool[1], : sizes[2] * pool[2]] = parted.reshape(*x.shape[:2], *[s * p for s, p in zip(sizes, pool, strict=True)])
    return out


def _channel(v: np.ndarray) -> np.ndarray:
    return v[None, :, None, None, None]


def forward(net: Network, theta: np.ndarray, moments: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """The means before the last layer (n, channels), and what the way back needs: the input and output of each convolution, and what each pool reads."""
    parts, norms, trace = net.parts(theta), net.of_moments(moments), []
    for k in range(len(net.convolutions)):
        weights, gain, shift = parts[3 * k : 3 * k + 3]
        made = convolved(x, weights)
        scaled = (made - _channel(norms[k][0])) / np.sqrt(_channel(norms[k][1]) + EPS)
        after = np.maximum(scaled * _channel(gain) + _channel(shift), 0)
        trace.append((x, made, scaled, after))
        x = _windows(after, net.pools[k // 2]).max(axis=-1) if k % 2 else after
    return x.mean(axis=(2, 3, 4)), [*trace, x.shape]


def logits(net: Network, theta: np.ndarray, moments: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(n, classes) of clips x (n, depth and mask, steps, side, side)."""
    means, _ = forward(net, theta, moments, np.asarray(x, float))
    last, bias = net.parts(theta)[-2:]
    return means @ last.T + bias


def backward(net: Network, theta: np.ndarray, moments: np.ndarray, trace: list, slope: np.ndarray) -> np.ndarray:
    """The slope of theta but for the last layer's, from that of the means."""
    parts, norms = net.parts(theta), net.of_moments(moments)
    out = np.zeros(net.n_parameters)
    into = net.parts(out)
    shape = trace[-1]
    g = np.broadcast_to(slope[:, :, None, None, None] / np.prod(shape[2:]), shape)
    for k in reversed(range(len(net.convolutions))):
        x, _, scaled, after = trace[k]
        weights, gain, _ = parts[3 * k : 3 * k + 3]
        if k % 2:
            g = _pooled_back(after, net.pools[k // 2], g)
        g = g * (after > 0)
        into[3 * k + 1][:] = (g * scaled).sum(axis=(0, 2, 3, 4))
        into[3 * k + 2][:] = g.sum(axis=(0, 2, 3, 4))
        into[3 * k][:], g = convolved_back(x, weights, g * _channel(gain / np.sqrt(norms[k][1] + EPS)))
    return out


def dropped(keys: list[int], channels: int, share: float, epoch: int) -> np.ndarray:
    """What the means of clips are multiplied by in an epoch: 0 for about that share, by the clip's number, so reruns agree."""
    kept = np.stack([np.random.default_rng((epoch, key % (1 << 63))).random(channels) >= share for key in keys])
    return kept / (1 - share)


def _clips(batch: pa.RecordBatch, place: int, side: int) -> list[np.ndarray | None]:
    """Clips (2, steps, side, side); None for one without steps, or with steps of another size."""
    out: list[np.ndarray | None] = []
    for clip in batch.column(place):
        if not clip.is_valid or not len(clip.values):
            out.append(None)
            continue
        x = [clip.values.field(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)]
        good = all(len(v) == len(clip.values) * side * side for v in x) and np.isfinite(x[0].sum() + x[1].sum())
        out.append(np.stack(x).reshape(2, -1, side, side) if good else None)
    return out


def _alike(clips: list[np.ndarray | None], net: Network, side: int) -> Iterator[list[int]]:
    """Places of clips of one length, as many as are worked on together; those too short for the pools are left out."""
    lengths: dict[int, list[int]] = {}
    for k, x in enumerate(clips):
        if x is not None and net.fits(x.shape[1], side):
            lengths.setdefault(x.shape[1], []).append(k)
    n = max(1, AT_ONCE // (side * side))
    for places in lengths.values():
        yield from (places[lo : lo + n] for lo in range(0, len(places), n))


def one_pass(rows: DataFrame, net: Network, side: int, theta: np.ndarray, moments: np.ndarray, weights: np.ndarray, dropout: float, epoch: int) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[float, np.ndarray]]]:
    """The mean weighted gradient and the moments of the training rows, and by split the mean weighted loss and the counts (truth, guess).

    rows (nth split, y, clip_id, steps) may be any number. Losses and counts are
    those of the model as it is; the gradient is taken with dropout.
    """
    classes, each = net.classes, 2 + net.classes**2
    n_theta, n_moments = net.n_parameters, len(moments)
    total_size = n_theta + n_moments + len(net.convolutions) + len(SPLITS) * each
    shared = rows.sparkSession.sparkContext.broadcast((theta, moments))  # a model's worth of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, moments = shared.value
        out = np.zeros(total_size)
        gradient, seen, rest = out[:n_theta], out[n_theta : n_theta + n_moments], out[n_theta + n_moments :]
        pixels, tally = rest[: len(net.convolutions)], rest[len(net.convolutions) :].reshape(len(SPLITS), each)
        last, bias = net.parts(theta)[-2:]
        for batch in batches:
            split, y, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            clips = _clips(batch, 3, side)
            for places in _alike(clips, net, side):
                s, truth, x = split[places], y[places], np.stack([clips[k] for k in places]).astype(float)
                means, trace = forward(net, theta, moments, x)
                log_p, w = scores(means @ last.T + bias), weights[truth]
                np.add.at(tally, (s, 0), w)
                np.add.at(tally, (s, 1), -w * log_p[np.arange(len(truth)), truth])
                np.add.at(tally, (s, 2 + truth * classes + log_p.argmax(axis=1)), 1)
                if not (s == 0).any():
                    continue
                kept = dropped([int(k) for k in keys[places]], means.shape[1], dropout, epoch) if dropout else 1.0
                off = np.exp(scores((means * kept) @ last.T + bias))
                off[np.arange(len(truth)), truth] -= 1
                off *= (w * (s == 0))[:, None]
                made = backward(net, theta, moments, trace, off @ last * kept)
                into = net.parts(made)
                into[-2][:], into[-1][:] = off.T @ (means * kept), off.sum(axis=0)
                gradient += made
                for k, sums in enumerate(net.of_moments(seen)):
                    own = trace[k][1][s == 0]
                    sums += [own.sum(axis=(0, 2, 3, 4)), (own**2).sum(axis=(0, 2, 3, 4))]
                    pixels[k] += own[:, 0].size
        for lo in range(0, total_size, PART):
            if out[lo : lo + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // PART], pa.int32()), pa.array([out[lo : lo + PART]], pa.list_(pa.float64()))], names=["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        # One row per task of one part of the model.
        sums = np.stack([v.values.to_numpy(zero_copy_only=False) for v in table.column("sums")]).sum(axis=0)
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    out = np.zeros(total_size)
    schema = "part int, sums array<double>"
    for r in rows.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect():  # a model's worth of numbers
        out[r.part * PART : r.part * PART + len(r["sums"])] = r["sums"]
    rest = out[n_theta + n_moments :]
    pixels, tally = rest[: len(net.convolutions)], rest[len(net.convolutions) :].reshape(len(SPLITS), each)
    found = []
    for k, sums in enumerate(net.of_moments(out[n_theta : n_theta + n_moments])):
        mean = sums[0] / max(pixels[k], 1)
        found += [mean, np.maximum(sums[1] / max(pixels[k], 1) - mean**2, 0)]
    judged = {s: (t[1] / t[0] if t[0] else 0.0, t[2:].reshape(classes, classes)) for s, t in zip(SPLITS, tally, strict=True)}
    return out[:n_theta] / max(tally[0, 0], 1e-300), np.concatenate(found), judged


def train(samples: DataFrame, side: int, labels: list[str], options: Options | None = None, width: int = 16, pools: tuple = POOLS, dropout: float = 0.3, mode: str = "absolute", clip_len: int = 0, seed: int = 0) -> dict[str, DataFrame]:
    """model, history and test_confusion (truth, guess, n) of a network over samples (split, y, clip_id, steps).

    Classes weigh as in metrics.class_weights(); the model of the epoch with the
    best macro F1 on val is taken, the first of equals, or the last without val rows.
    Rows of other splits, with y null or outside of labels, a null clip_id, and clips
    without steps, with pixels that are null or not finite, of another side or too
    short for the pools take no part. Fewer than two labels, and no training rows,
    are errors.
    """
    options = options or Options(rate=0.01)
    if len(labels) < 2:
        raise ValueError(f"training needs two labels or more, there are {labels}")
    net, spark = Network(len(labels), width, tuple(tuple(p) for p in pools)), samples.sparkSession
    known = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")).cast("int") - 1
    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = lambda v: (F.size(v) == side * side) & F.forall(v, sound)
    shortest = int(np.prod([p[0] for p in net.pools]))
    d = samples.select(known.alias("split"), F.col("y").cast("int").alias("y"), F.col("clip_id").cast("long").alias("clip_id"), "steps")
    d = d.where((F.col("split") >= 0) & F.col("y").between(0, len(labels) - 1) & F.col("clip_id").isNotNull() & (F.size("steps") >= shortest))
    # Read once for each epoch.
    d = stored(d.where(F.forall("steps", lambda x: F.coalesce(whole(x["depth"]) & whole(x["mask"]), F.lit(False)))), "network")
    of_train = d.where("split = 0")
    if not net.fits(shortest, side) or of_train.limit(1).count() == 0:
        raise ValueError("no training rows, or none that the pools leave anything of")
    weighed = metrics.class_weights(of_train, spark.range(len(labels)).select(F.col("id").cast("int").alias("y")), "y").orderBy("y").collect()  # a row per class
    weights = np.array([r.weight for r in weighed], float)
    go = lambda theta, moments, epoch: one_pass(d, net, side, theta, moments, weights, dropout, epoch)

    theta, moments = net.first(seed), net.plain_moments()
    for _ in net.convolutions:  # what one layer's moments are depends on those before it
        gradient, found, judged = go(theta, moments, 0)
        if np.allclose(found, moments, rtol=1e-3, atol=1e-6):
            break
        moments = found
    gradient, found, judged = go(theta, moments, 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    has_val = judged["val"][1].sum() > 0
    history, best = [], (-1.0, 0, theta, moments)
    entry = lambda epoch, split, loss, n: (epoch, split, int(n.sum()), float(loss), float(np.trace(n) / max(1, n.sum())), macro_f1(n))
    for epoch in range(1, options.epochs + 1):
        history.append(entry(epoch, "train", *judged["train"]))
        rate = options.rate * (1 + np.cos(np.pi * (epoch - 1) / options.epochs)) / 2
        gradient = gradient * min(1.0, options.clip_norm / (np.linalg.norm(gradient) + 1e-6))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = first / (1 - 0.9**epoch) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        theta, moments = theta - rate * (step + options.weight_decay * theta), found
        gradient, found, judged = go(theta, moments, epoch + 1)
        if has_val:
            history.append(entry(epoch, "val", *judged["val"]))
        score = macro_f1(judged["val"][1]) if has_val else float(epoch)
        if score > best[0]:
            best, tested = (score, epoch, theta, moments), judged["test"]
    if tested[1].sum():
        history.append(entry(best[1], "test", *tested))
    chosen = (preprocess.VERSION, labels, mode, clip_len, side, width, [list(p) for p in net.pools], best[1], "val_macro_f1" if has_val else "final_epoch", best[2].tolist(), best[3].tolist())
    pairs = [(labels[t], labels[g], int(tested[1][t, g])) for t in range(len(labels)) for g in range(len(labels)) if tested[1][t, g]]
    return {
        "model": spark.createDataFrame([chosen], MODEL),
        "history": spark.createDataFrame(history, HISTORY),
        "test_confusion": spark.createDataFrame(pairs, "truth string, guess string, n long"),
    }


def load(spark: SparkSession, path: str) -> Row:
    """The model that training.save() left under path; one of another preprocessing is refused."""
    model = spark.read.schema(MODEL).parquet(f"{path}/model").first()
    if model.version != preprocess.VERSION:
        raise ValueError(f"the model was trained on preprocessing {model.version}, this is {preprocess.VERSION}: train it again")
    return model


def of_row(model: Row) -> tuple[Network, np.ndarray, np.ndarray]:
    """The network, its parameters and moments of a row of MODEL."""
    return Network(len(model.labels), model.width, tuple(tuple(p) for p in model.pools)), np.array(model.theta), np.array(model.moments)


def predict(samples: DataFrame, model: Row) -> DataFrame:
    """samples with logits and probs, a number per label in order, in place of steps; null for clips that can't be trained on either."""
    rest = [c for c in samples.columns if c not in ("steps", "logits", "probs")]
    d = samples.select(*rest, "steps")
    net, side = of_row(model)[0], model.side
    shared = samples.sparkSession.sparkContext.broadcast(of_row(model)[1:])  # a model's worth of numbers
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips = _clips(batch, len(rest), side)
            made: list[np.ndarray | None] = [None] * len(clips)
            probs = made.copy()
            for places in _alike(clips, net, side):
                out = logits(net, *shared.value, np.stack([clips[k] for k in places]))
                for k, z, p in zip(places, out, np.exp(scores(out)), strict=True):
                    made[k], probs[k] = z, p
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(made, kind), pa.array(probs, kind)], names=[*rest, "logits", "probs"])

    numbers = F.lit(None).cast("array<double>")
    return d.mapInArrow(run, d.drop("steps").withColumn("logits", numbers).withColumn("probs", numbers).schema)


def clip_model(model: Row) -> Callable[[np.ndarray], np.ndarray]:
    """The model as the live reader takes it: logits of one clip (depth and mask, steps, side, side)."""
    net, theta, moments = of_row(model)
    return lambda x: logits(net, theta, moments, np.asarray(x)[None])[0]
