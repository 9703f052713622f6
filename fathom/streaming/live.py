"""Live streams of frames: a buffer of the last frames, a stride, smoothing, pauses, and a warm-up that fits the session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.frames import blend
from fathom.operators.preprocess import Params, clip_input, fit_frames, relative_frame

OUTPUT = "session long, pos long, smoothed double"
STATE = "pos long, buffer array<double>, smoothed double"


def live_predictions(stream: DataFrame, length: int = 16, every: int = 4, alpha: float = 0.6) -> DataFrame:
    """(session, pos, smoothed): whenever the buffer of a session is full and pos hits the stride, the smoothed mean of it.

    stream: session, ts, event_id, value, paused. Frames count in the order of (ts,
    event_id) within a micro-batch, and micro-batches in the order they come. A
    paused frame is counted and dropped, and empties the buffer and the smoothing,
    so no window spans a pause. A session's frames of one micro-batch are sorted in
    memory: the source's maxFilesPerTrigger bounds them. The state is the buffer
    and two numbers.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, held, smoothed = state.get if state.exists else (0, [], None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        value, paused = rows["value"].to_numpy(float), rows["paused"].to_numpy(bool)
        found: list[tuple[int, float]] = []
        buffer = np.array(held, float)
        edges = np.flatnonzero(np.append(paused, True))
        begin = 0
        for end in edges:  # stretches without a pause; the last one ends with the batch
            own = np.concatenate([buffer, value[begin:end]])
            at = start + begin + np.arange(end - begin)
            full = np.arange(len(buffer) + 1, len(own) + 1) >= length
            hit = np.flatnonzero(full & (at % every == 0))
            if len(hit):
                windows = np.lib.stride_tricks.sliding_window_view(own, length)
                for k, mean in zip(at[hit], windows[hit + len(buffer) - length + 1].mean(axis=1), strict=True):
                    smoothed = float(mean) if smoothed is None else blend(smoothed, float(mean), alpha)
                    found.append((int(k), smoothed))
            buffer = own[max(0, len(own) - length + 1) :] if length > 1 else own[:0]
            if end < len(paused):
                buffer, smoothed = buffer[:0], None
            begin = end + 1
        state.update((start + len(rows), buffer.tolist(), smoothed))
        out = pd.DataFrame(found, columns=["pos", "smoothed"])
        out.insert(0, "session", key[0])
        yield out.astype({"session": "int64", "pos": "int64", "smoothed": "float64"})

    return stream.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


#: A model: the depth and mask (2, length, size, size) of a clip to one number per label.
Model = Callable[[np.ndarray], np.ndarray]


#: How long a warm-up lasts at most, in seconds, and how many frames it needs then.
WARM_SECONDS, LEAST_WARM = 20.0, 3


class Reader:
    """One session's live state: warming up on neutral frames, then predicting from a buffer of clips.

    Fitting, transforming and scaling are those of the batch build, so a clip gives
    the same input in both. A warm-up ends with its last frame or, by the frames'
    clock, after WARM_SECONDS, with LEAST_WARM frames at least. What goes wrong is
    kept in reports until it is put out.
    """

    def __init__(self, params: Params, scale: float, mode: str, length: int, every: int, alpha: float, warm_frames: int) -> None:
        self.params, self.scale, self.mode = params, scale, mode
        self.length, self.every, self.alpha, self.warm_frames = length, every, alpha, warm_frames
        self.fitted: dict | None = None
        self.warming: list[np.ndarray] | None = []
        self.since: float | None = None
        self.buffer: list[np.ndarray] = []
        self.smoothed: np.ndarray | None = None
        self.count = 0
        self.paused = False
        self.problem: str | None = None
        self.reports: list[str] = []

    def control(self, kind: str) -> None:
        """pause (again: resume) and rewarm; each empties the buffer and the smoothing, so no clip spans it."""
        self.buffer, self.smoothed = [], None
        if kind == "pause":
            self.paused = not self.paused
        elif kind == "rewarm":
            self.warming, self.since = [], None

    def end_warm_up(self) -> None:
        """Fits the frames at hand. After a failure an earlier fit goes on; without one the next frames are tried."""
        images, self.since = self.warming or [], None
        if len(images) < min(LEAST_WARM, self.warm_frames):
            found = {"problem": f"the warm-up got {len(images)} frames"}
        elif len({x.shape for x in images}) > 1:
            found = {"problem": "the warm-up's frames are of different shapes"}
        else:
            found = fit_frames(np.stack(images), self.params, self.scale)
        self.problem = found.get("problem")
        if self.problem is None:
            self.fitted = found | {"shape": images[0].shape}
        else:
            self.reports.append(self.problem)
        self.warming = None if self.fitted else []

    def frame(self, image: np.ndarray, model: Model, at: float | None = None) -> np.ndarray | None:
        """Takes a frame, at a time in seconds; the smoothed probabilities where it makes a prediction."""
        if self.warming is not None:
            self.since = at if self.since is None else self.since
            if at is not None and at - self.since >= WARM_SECONDS:
                self.end_warm_up()
        if self.warming is not None:
            self.since = at if self.since is None else self.since
            self.warming.append(image)
            if len(self.warming) >= self.warm_frames:
                self.end_warm_up()
            return None
        if image.shape != self.fitted["shape"]:
            self.reports.append("a frame of {}x{}, the session is fitted on {}x{}".format(*image.shape, *self.fitted["shape"]))
            return None
        if self.paused:
            return None
        roi = self.fitted["roi"]
        rel = relative_frame(image, (roi["x"], roi["y"], roi["side"]), self.fitted["reference_mm"], self.params, self.scale)
        self.buffer = [*self.buffer[-(self.length - 1) :], rel] if self.length > 1 else [rel]
        self.count += 1
        if len(self.buffer) < self.length or self.count % max(1, self.every):
            return None
        logits = np.asarray(model(self.input()), float)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        self.smoothed = p if self.smoothed is None else blend(self.smoothed, p, self.alpha)
        return self.smoothed

    def kept(self) -> tuple:
        """The state as the columns of READER_STATE: raw frames as 16-bit numbers, relative ones as doubles."""
        fit, warm = self.fitted or {}, self.warming
        roi, (h, w) = fit.get("roi") or {}, fit.get("shape") or (None, None)
        of = [self.paused, self.count, self.since, self.problem, warm is not None]
        of += [[x.astype("<u2").tobytes() for x in warm or []], [x.shape[0] for x in warm or []], [x.shape[1] for x in warm or []]]
        of += [[x.tobytes() for x in self.buffer], None if self.smoothed is None else self.smoothed.tolist()]
        reference = fit.get("reference_image")
        of += [roi.get("x"), roi.get("y"), roi.get("side"), fit.get("reference_mm"), None if reference is None else np.array(reference, float).tobytes(), h, w]
        return tuple(of)

    def restore(self, state: tuple) -> None:
        """Takes what kept() gave."""
        self.paused, self.count, self.since, self.problem, warming, frames, hs, ws, buffer, smoothed, x, y, side, reference_mm, reference, h, w = state
        self.warming = [np.frombuffer(f, "<u2").reshape(a, b).astype(np.int64) for f, a, b in zip(frames, hs, ws, strict=True)] if warming else None
        n = self.params.out_size
        self.buffer = [np.frombuffer(f).reshape(n, n) for f in buffer]
        self.smoothed = None if smoothed is None else np.array(smoothed, float)
        if side is not None:
            self.fitted = {"roi": {"x": x, "y": y, "side": side}, "reference_mm": reference_mm, "reference_image": np.frombuffer(reference), "shape": (h, w)}

    def input(self) -> np.ndarray:
        """The buffer as a model takes it: depth in [-1, 1], 0 where masked, and the mask."""
        clip = np.stack(self.buffer)
        reference = np.array(self.fitted["reference_image"], float).reshape(clip.shape[1:]) if self.mode == "deform" else None
        return np.stack(clip_input(clip, self.params, self.mode, reference))


READER_STATE = (
    "paused boolean, count long, since double, problem string, warming boolean, frames array<binary>, heights array<int>, widths array<int>, buffer array<binary>, smoothed array<double>,"
    " x int, y int, side int, reference_mm double, reference binary, h int, w int"
)


def live_readout(
    stream: DataFrame,
    model: Model,
    labels: list[str],
    params: Params | None = None,
    depth_scale: float = 0.0001,
    mode: str = "absolute",
    length: int = 16,
    every: int = 2,
    alpha: float = 0.6,
    warm_frames: int = 45,
    idle_seconds: float | None = None,
) -> DataFrame:
    """(session, ts, top_label, confidence, p, problem): a row per prediction of each session's live state, and one per problem.

    stream: session (text), ts (timestamp), nth (long), h, w, depth and control. A
    row whose control is pause or rewarm is no frame. Rows count in the order of
    (ts, nth) within a micro-batch; a session's micro-batch is bounded by the
    source's rate. The state, in typed columns, holds a clip, or the warm-up's
    frames, and the fit. A warm-up that fails keeps the fit before it; its problem,
    or that of a frame whose shape isn't the fitted one, is a row without a
    prediction. With idle_seconds, a warm-up also ends when no row has come for so
    long, by the cluster's clock.
    """
    params = params or Params()
    settings = (params, depth_scale, mode, length, every, alpha, warm_frames)
    if mode not in ("absolute", "deform"):
        raise ValueError(f"unknown mode {mode!r}")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reader = Reader(*settings)
        if state.exists:
            reader.restore(state.get)
        rows: list[tuple] = []

        def told(at: object) -> None:
            rows.extend((key[0], at, None, None, None, problem) for problem in reader.reports)
            reader.reports.clear()

        if idle_seconds is not None and state.hasTimedOut:
            reader.end_warm_up()
            told(pd.Timestamp.now())
        else:
            for r in pd.concat(list(parts)).sort_values(["ts", "nth"]).itertuples():
                if r.control:
                    reader.control(r.control)
                elif r.depth is not None:
                    p = reader.frame(np.asarray(r.depth).reshape(int(r.h), int(r.w)), model, r.ts.timestamp())
                    told(r.ts)
                    if p is not None:
                        top = int(np.argmax(p))
                        rows.append((key[0], r.ts, labels[top], float(p[top]), p.tolist(), None))
        state.update(reader.kept())
        if idle_seconds is not None and reader.warming:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame(rows, columns=["session", "ts", "top_label", "confidence", "p", "problem"])

    output = "session string, ts timestamp, top_label string, confidence double, p array<double>, problem string"
    timeout = "NoTimeout" if idle_seconds is None else "ProcessingTimeTimeout"
    return stream.groupBy("session").applyInPandasWithState(step, output, READER_STATE, "append", timeout)


def prediction_log(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """The rows of a log: host_time_unix, iso, top_label, confidence and p_<label> of each label, 4 decimals; problems are left out."""
    four = lambda c: F.format_string("%.4f", c)
    unix = F.unix_micros("ts") / 1e6
    return predictions.where("top_label IS NOT NULL").select(
        F.format_string("%.6f", unix).alias("host_time_unix"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        "top_label",
        four(F.col("confidence")).alias("confidence"),
        *[four(F.col("p")[k]).alias(f"p_{x}") for k, x in enumerate(labels)],
    )


def append_log(predictions: DataFrame, labels: list[str], path: str) -> object:
    """Starts a query that appends prediction_log() to CSV files with a header under path."""
    rows = prediction_log(predictions, labels)
    return rows.writeStream.format("csv").option("header", True).option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/rows")


def run_available(result: DataFrame, path: str) -> DataFrame:
    """All that a streaming result gives for the input at hand, written under path and read back."""
    query = result.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/rows")
