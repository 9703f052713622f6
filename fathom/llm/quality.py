"""Quality rules: counts of the text, and a calibrated n-gram classifier.

Hashed word and character n-grams feed a logistic regression that learns from
labelled rows; a second fit on held-out labels turns its scores into
probabilities. Texts are scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes, fresh
from fathom.llm.textkernel import IS_SPACE, U64, chunks, mix, rolling, scan, segment_sum

BITS = 17
DIM = 1 << BITS
WORD_GRAMS = (1, 2)
CHAR_GRAMS = (2, 4)
#: Labelled rows that the fit uses at most, those with the least hashes of their ids.
TRAINING_ROWS = 4000
#: Labelled rows with longer texts (in bytes) aren't learned from: the sample's bytes are bounded too.
TRAINING_BYTES = 1 << 16
#: One in so many training rows is held out for the calibration.
CALIBRATION_FOLD = 4
EPOCHS = 6

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MIN_PROBABILITY = 0.5
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class QualityModel:
    """Weights for hashed n-grams (words, then characters), and the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.offset, -50, 50)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, scalars=np.array([self.bias, self.slope, self.offset]))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> QualityModel:
        with np.load(io.BytesIO(data)) as z:
            return QualityModel(z["weights"], *map(float, z["scalars"]))


#: Grams that are worked on at a time; a chunk of texts has fewer, but for one long text.
GRAMS = 1 << 20


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Blocks of features: (kind, features of its grams, the first gram's number, each text's range of that kind's grams).

    Kinds count the widths of word grams, then those of character grams; the blocks of a kind come in order.
    """
    words = scan(texts)
    yield from _blocks(words.hashes(), words.text_ptr, WORD_GRAMS, 0, 0)
    points = np.frombuffer(words.buffer.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (words.buffer & 0xC0) != 0x80
    ptr = np.concatenate([[0], np.cumsum(lead)])[words.byte_ptr]  # a text's range ends with the space after it
    yield from _blocks(points, ptr, CHAR_GRAMS, DIM, len(WORD_GRAMS))


def _blocks(values: np.ndarray, ptr: np.ndarray, widths: tuple[int, ...], shift: int, kind: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    for k, width in enumerate(widths):
        n = max(0, len(values) - width + 1)
        start = np.minimum(ptr[:-1], n)
        ranges = np.column_stack([start, np.maximum(start, np.minimum(ptr[1:] - width + 1, n))])
        for lo in range(0, max(n, 1), GRAMS):
            own = values[lo : lo + GRAMS + width - 1].astype(U64)
            grams = rolling(own, width) if width > 1 else mix(own)
            yield kind + k, (mix(grams + U64(width)) >> U64(64 - BITS)).astype(np.int32) + shift, lo, ranges


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The uncalibrated score of each text: for each kind of gram, the mean weight; each sum is on its own."""
    total = np.zeros((len(WORD_GRAMS) + len(CHAR_GRAMS), len(texts)))
    counts = np.ones_like(total)
    for kind, index, lo, ranges in features(texts):
        own = np.clip(ranges - lo, 0, len(index))
        full = np.flatnonzero(own[:, 1] > own[:, 0])
        if len(full):
            total[kind, full] += np.add.reduceat(np.append(weights[index], np.float32(0)), own[full].ravel(), dtype=np.float64)[0::2]
        counts[kind] = np.maximum(1, ranges[:, 1] - ranges[:, 0])
    return (total / counts).sum(axis=0)


def fit(texts: list[bytes], labels: np.ndarray) -> QualityModel:
    """Logistic regression by AdaGrad on three quarters of the rows; slope and offset by Newton steps on the rest."""
    sparse = []
    for lo, hi in chunks(texts):
        blocks = list(features(texts[lo:hi]))  # texts are short: one block of each kind
        for i in range(hi - lo):
            index, value = [], []
            for _, at, _, ranges in blocks:
                own, count = np.unique(at[ranges[i, 0] : ranges[i, 1]], return_counts=True)
                index.append(own)
                value.append((count / max(1, count.sum())).astype(np.float32))
            sparse.append((np.concatenate(index), np.concatenate(value)))
    held = np.arange(len(texts)) % CALIBRATION_FOLD == CALIBRATION_FOLD - 1
    learn = np.flatnonzero(~held)
    weights, seen = np.zeros(2 * DIM, np.float32), np.full(2 * DIM, 1e-12, np.float32)
    bias, bias_seen = 0.0, 1e-12
    good = max(1, int((labels[learn] == 1).sum()))
    share = {1: len(learn) / (2 * good), 0: len(learn) / (2 * max(1, len(learn) - good))}
    order = np.random.default_rng(0)
    for epoch in range(EPOCHS):
        rate = 0.5 / (1 + epoch)
        for i in order.permutation(learn):
            index, value = sparse[i]
            p = 1 / (1 + np.exp(-np.clip(float(weights[index] @ value) + bias, -30, 30)))
            g = (p - labels[i]) * share[int(labels[i])]
            step = np.float32(g) * value
            seen[index] += step * step
            weights[index] -= np.float32(rate) * step / np.sqrt(seen[index])
            bias_seen += g * g
            bias -= rate * g / bias_seen**0.5
    rows = np.flatnonzero(held)
    x = np.array([float(weights[sparse[i][0]] @ sparse[i][1]) for i in rows]) + bias
    slope, offset = _calibrate(x, labels[rows].astype(float))
    return QualityModel(weights, float(bias), slope, offset)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x); labels are drawn in a little, so that separable rows give finite values."""
    up, down = (y == 1).sum(), (y == 0).sum()
    if not up or not down:
        return 1.0, 0.0
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        g = np.array([((p - t) * x).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> QualityModel:
    """A model from at most rows labelled documents.

    The sample is fixed: the labelled ids with the least hashes, rows with a null
    label or text left out, and texts over TRAINING_BYTES. One task fits it; the
    sample bounds its memory. Without labels of both kinds the model keeps everything.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    chosen = chosen.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).where(F.octet_length(text_col) <= TRAINING_BYTES)
    # At most `rows` ids and labels: a few tens of kilobytes.
    sample = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for i, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found[i] = min(found.get(i, (label, text)), (label, text))  # repeated ids: the least text
        ids = sorted(found)
        y = np.array([found[i][0] for i in ids], np.int64)
        if len(set(y.tolist())) == 2:
            model = fit([found[i][1] for i in ids], y)
        else:
            model = QualityModel(np.zeros(2 * DIM, np.float32), 1.0, 1.0, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return QualityModel.from_bytes(bytes(made[0])) if made else QualityModel(np.zeros(2 * DIM, np.float32), 1.0, 1.0, 0.0)


def rule_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = scan(texts)
    counts = words.counts
    byte = words.buffer
    in_text = words.byte_ptr.copy()
    chars = segment_sum((((byte & 0xC0) != 0x80) & ~IS_SPACE[byte]).view(np.uint8), in_text)
    symbols = segment_sum(_SYMBOL[byte].view(np.uint8), in_text)
    lines = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line in seen:
                    lines[i] += 1
                elif line.strip(b" \t\n\r\x0b\x0c"):
                    seen.add(line)
    repeated = np.zeros(len(texts), np.int64)
    hashes = words.hashes()
    if len(hashes) >= WINDOW:
        of = words.text_of_word()
        start = np.flatnonzero(of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :])
        key = mix(rolling(hashes, WINDOW)[start] ^ mix(of[start].astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, start[twice], 1)
        np.add.at(edge, start[twice] + WINDOW, -1)
        repeated = segment_sum((np.cumsum(edge)[:-1] > 0).view(np.uint8), words.text_ptr)
    return {"n_words": counts.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with the counts, base_failed, quality_probability and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word
    windows. kept: not base_failed, and a probability of 0.5 or more. A null text is
    an empty one, so base_failed. Columns of docs with these names are replaced;
    rows stay in their partitions, each text judged on its own.
    """
    outputs = [*COUNTS, "base_failed", "quality_probability", "kept"]
    rest = [c for c in docs.columns if c.lower() not in outputs]
    (helper,) = fresh(docs, "_text_bytes")
    frame = docs.select(*rest, F.col(text_col).cast("binary").alias(helper))
    kinds = ["0L " + c for c in COUNTS] + ["false base_failed", "0D quality_probability", "false kept"]
    schema = frame.drop(helper).selectExpr("*", *kinds).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * DIM weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in by_bytes(batches, len(schema) - len(outputs)):
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found, score = [], []
            for lo, hi in chunks(texts):
                found.append(rule_counts(texts[lo:hi]))
                score.append(m.probability(margins(texts[lo:hi], m.weights)))
            if not found:
                continue
            c = {k: np.concatenate([f[k] for f in found]) for k in COUNTS}
            p = np.concatenate(score)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])
            arrays = [*batch.columns[:-1], *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= MIN_PROBABILITY))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return frame.mapInArrow(run, schema)
