"""Frames of sessions: order, clocks, runs of labels, windows and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import UNLABELED
from fathom.operators import scans
from fathom.operators.scans import runs
from fathom.operators.tables import numbered, small

#: Rows of a session up to which one task puts them in order; beyond, all are ordered in ranges.
SESSION_ROWS = 1 << 18


def positions(events: DataFrame, session: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), trial_length: int = 40, most: int = SESSION_ROWS) -> DataFrame:
    """A frame per event: session, pos (from 0), label, t_ms, value, trial. A missing label is "unlabeled".

    Sessions, counted first, are put in order by one task each if none has more
    than `most` rows, else in ranges of the order; the rows are the same.
    """
    label = F.coalesce(F.nullif("event_type", F.lit("")), F.lit(UNLABELED))
    t_ms = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000.0)
    columns = [F.col(session).alias("session"), "pos", label.alias("label"), t_ms.alias("t_ms"), "value"]
    if (events.groupBy(session).count().agg(F.max("count")).first()[0] or 0) > most:
        d = numbered(events, "pos", session, *order, by=session).withColumn("pos", F.col("pos").cast("int"))
    else:
        d = events.withColumn("pos", F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1)
    return d.select(*columns).withColumn("trial", F.floor(F.col("pos") / trial_length).cast("int"))


def longest_run(frames: DataFrame) -> DataFrame:
    """The longest run of each label in a session, the earliest of equals."""
    best = F.max_by("start", F.struct("length", -F.col("start"))).alias("start")
    return runs(frames).groupBy("session", "label").agg(best, F.max("length").alias("length"))


def reference_rows(frames: DataFrame, label: str, seconds: float = 1.0, fps: float = 30.0, least: int = 20, fallback: bool = False) -> DataFrame:
    """(session, pos, fallback): the first rows of the longest run of label, which must have `least` rows.

    With fallback, sessions without such a run give their first rows instead.
    """
    want = max(least, round(seconds * fps))
    run = longest_run(frames).where((F.col("label") == label) & (F.col("length") >= least)).select("session", "start", "length")
    d = frames.select("session", "pos").join(run, "session", "left" if fallback else "inner")
    first = F.coalesce("start", F.lit(0))
    inside = (F.col("pos") >= first) & (F.col("pos") < first + F.least(F.coalesce("length", F.lit(want)), F.lit(want)))
    return d.where(inside).select("session", "pos", F.col("start").isNull().alias("fallback"))


def modal_label(labels: Column) -> Column:
    """struct(n, label): the most frequent of an array, the first seen of equals."""
    counted = F.transform(F.array_distinct(labels), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), (-F.array_position(labels, x)).alias("first"), x.alias("label")))
    return F.array_max(counted)


def clip_candidates(frames: DataFrame, length: int = 16, stride: int = 4) -> DataFrame:
    """Windows of length frames at every stride, whole ones only.

    n_label, label: the modal label; straddles: more than one trial; gap_ms: the
    largest step between known clocks inside the window. Each frame goes to the
    length / stride windows that hold it, and a window is one group: a session is
    never one task, whatever its share of the rows.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - length + 1) / stride)).cast("int")
    starts = F.transform(F.sequence(first, F.floor(F.col("pos") / stride).cast("int")), lambda k: k * stride)
    held = F.filter(starts, lambda s: F.col("pos") < s + length)
    frame = F.struct("pos", "label", "t_ms", "trial", "valid")
    d = frames.select("session", F.explode(held).alias("start"), frame.alias("f")).groupBy("session", "start").agg(F.array_sort(F.collect_list("f")).alias("f"))
    d = d.where(F.size("f") == length)
    clocks = F.filter(F.transform("f", lambda x: x["t_ms"]), lambda t: t.isNotNull())
    steps = F.zip_with(F.slice(clocks, 2, length), F.slice(clocks, 1, length), lambda a, b: a - b)
    d = d.select(
        "session",
        "start",
        F.lit(length).cast("long").alias("length"),
        modal_label(F.transform("f", lambda x: x["label"])).alias("mode"),
        (F.size(F.array_distinct(F.transform("f", lambda x: x["trial"]))) > 1).alias("straddles"),
        F.col("f")[0]["trial"].alias("trial"),
        (F.aggregate("f", F.lit(0.0), lambda s, x: s + x["valid"]) / length).alias("mean_valid"),
        F.array_max(steps).alias("gap_ms"),
    )
    return d.select("*", F.col("mode.n").cast("long").alias("n_label"), F.col("mode.label").alias("label")).drop("mode")


def clip_verdicts(clips: DataFrame, max_gap_ms: float, min_valid: float = 0.4, min_purity: float = 0.9, include_unlabeled: bool = False) -> DataFrame:
    """clips with reason: the first rule that a window breaks, or null."""
    reason = F.when(F.col("straddles"), "straddles_trial").when(F.col("gap_ms") > max_gap_ms, "time_gap").when(F.col("mean_valid") < min_valid, "low_valid_depth")
    reason = reason.when(F.col("n_label") / F.col("length") < min_purity, "impure_label")
    if not include_unlabeled:
        reason = reason.when(F.col("label") == UNLABELED, "unlabeled")
    return clips.withColumn("reason", reason)


def label_ids(labels: DataFrame) -> DataFrame:
    """(label, label_id): unlabeled is 0, the others count from 1 in code point order."""
    d = labels.select("label").where(F.col("label") != UNLABELED).distinct()
    d = d.withColumn("label_id", F.row_number().over(Window.orderBy("label")))
    return labels.sparkSession.createDataFrame([(UNLABELED, 0)], "label string, label_id int").unionByName(d)


def blend(before: object, new: object, alpha: float) -> object:
    """A smoothed value: alpha of the one before it, the rest of the new one; columns, numbers or arrays. alpha of 0 or less doesn't smooth."""
    alpha = max(alpha, 0.0)
    return alpha * before + (1 - alpha) * new


def ema(values: Column, alpha: float = 0.6) -> Column:
    """The smoothed value after the last of an array of values; see blend()."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, p: F.when(s.isNull(), p).otherwise(blend(s, p, alpha)))


def ema_last(frames: DataFrame, value: str, alpha: float = 0.6) -> DataFrame:
    """(session, ema): the smoothed value after a session's last frame, as a weighted sum over its frames; see blend()."""
    alpha = max(alpha, 0.0)
    last = small(frames.groupBy("session").agg(F.max("pos").alias("_last")), 24)
    d = frames.select("session", "pos", value).join(last, "session")
    fade = F.pow(F.lit(alpha), F.col("_last") - F.col("pos"))
    return d.groupBy("session").agg(F.sum(F.when(F.col("pos") == 0, fade).otherwise((1 - alpha) * fade) * F.col(value)).alias("ema"))


def label_digest(frames: DataFrame) -> DataFrame:
    """(session, digest): 16 hex digits of a SHA-1 over the labels and trials of all frames, by place.

    Each frame's digest of "pos:label:trial" is cut to 60 bits, and the session's
    is that of their sum: frames are summed where they are, and no session is
    brought together.
    """
    own = F.sha1(F.concat_ws(":", "pos", F.coalesce("label", F.lit("")), F.coalesce(F.col("trial").cast("string"), F.lit(""))))
    part = F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")
    return frames.groupBy("session").agg(F.substring(F.sha1(F.sum(part).cast("string")), 1, 16).alias("digest"))


def gate_problems(sessions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """sessions with problems, the names of the rules that hold for each, in the rules' order, and refused."""
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return sessions.withColumn("problems", named).withColumn("refused", F.size("problems") > 0)


def prediction_ticks(frames: DataFrame, length: int = 16, every: int = 4) -> DataFrame:
    """frames at which a live model predicts: its buffer of an epoch is full and the session's own counter hits the stride.

    frames have an epoch that a pause begins; the counter runs on through pauses.
    """
    d = scans.ranked(frames, "_filled", "session", "epoch")
    return d.where((F.col("_filled") + 1 >= length) & (F.col("pos") % every == 0)).drop("_filled")


def numbered_clips(clips: DataFrame) -> DataFrame:
    """clips with clip_id, counted from 0 by session and start over all of them."""
    return numbered(clips, "clip_id", "session", "start")


def moved_starts(clips: DataFrame, lengths: DataFrame, jitter: int = 0, seed: int = 0) -> DataFrame:
    """clips with n_frames of lengths (session, n_frames), and with start moved.

    A clip's start moves by up to jitter frames, by a hash of its place and seed,
    inside its session.
    """
    d = clips.join(lengths.select("session", "n_frames"), "session")
    if not jitter:
        return d
    move = F.pmod(F.xxhash64("session", "start", F.lit(seed)), F.lit(2 * jitter + 1)) - jitter
    room = F.greatest(F.lit(0), F.col("n_frames") - F.col("length"))
    return d.withColumn("start", F.greatest(F.lit(0), F.least(F.col("start") + move, room)).cast("int"))


def clip_frames(clips: DataFrame, lengths: DataFrame, jitter: int = 0, seed: int = 0) -> DataFrame:
    """A row per frame of each clip, moved as by moved_starts(): clips' columns, step (0 to length - 1) and pos.

    A clip longer than what is left of its session repeats the last frame.
    """
    d = moved_starts(clips, lengths, jitter, seed)
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)))
    return d.withColumn("pos", F.least(F.col("start") + F.col("step"), F.col("n_frames").cast("int") - 1)).drop("n_frames")


def even_sample(lengths: DataFrame, n: int = 5) -> DataFrame:
    """(session, nth, pos): up to n evenly spaced places of each session of lengths (session, n_frames), first and last among them."""
    many = F.least(F.lit(n), F.col("n_frames")).cast("int")
    d = lengths.where("n_frames > 0").select("session", "n_frames", many.alias("_n"), F.explode(F.sequence(F.lit(0), many - 1)).alias("nth"))
    gap = (F.col("n_frames") - 1) / F.nullif(F.col("_n") - 1, F.lit(0))
    pos = F.when(F.col("nth") == F.col("_n") - 1, F.when(F.col("_n") > 1, F.col("n_frames") - 1).otherwise(0)).otherwise(F.floor(F.col("nth") * gap))
    return d.select("session", "nth", pos.cast("int").alias("pos"))


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    """Every n-th of the rows at hand of each session, by pos, from the first."""
    if n <= 1:
        return frames
    return scans.ranked(frames, "_nth").where(F.col("_nth") % n == 0).drop("_nth")


def select_rows(frames: DataFrame, label: str | None = None, trial: int | None = None, frame: int | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """The frames of a label, of a trial, and of one frame_index or else of a half-open span of them.

    No frame at any step is an error that names the first such step.
    """
    steps = [(f"no frames labelled {label!r}", F.col("label") == label)] if label is not None else []
    steps += [(f"no frames in trial {trial}", F.col("trial") == trial)] if trial is not None else []
    if frame is not None:
        steps.append((f"frame {frame} is not in the recording", F.col("frame_index") == frame))
    elif span is not None:
        steps.append((f"no frames in range {span[0]}:{span[1]}", (F.col("frame_index") >= span[0]) & (F.col("frame_index") < span[1])))
    chosen = frames
    for _, rule in steps:
        chosen = chosen.where(rule)
    if steps and chosen.isEmpty():
        left = frames
        for message, rule in steps:
            left = left.where(rule)
            if left.isEmpty():
                raise ValueError(message)
    return chosen


def rolling_rate(frames: DataFrame, n: int = 30) -> DataFrame:
    """frames with rate, the frames a second over the last n; 0 without a span of time."""
    span = F.col("t_ms") - F.col("_since")
    d = scans.clock_before(frames, "_since", n)
    return d.withColumn("rate", F.when(span > 0, (F.col("_rows") - 1) / (span / 1000)).otherwise(0.0)).drop("_since", "_rows")


def trial_numbers(frames: DataFrame, toggle: Column, order: tuple[str, ...], by: str | None = None) -> DataFrame:
    """frames with trial_id: a toggle opens trial 1, the next ends it, the one after opens trial 2, ...; 0 between trials.

    The count runs on over all recordings, in order, of one device (by). Running
    counts are made in ranges of the order, not in one task.
    """
    d = numbered(frames.withColumn("_toggle", toggle.cast("int")), "_at", *([by] if by else []), *order, running="_toggle", by=by)
    return d.withColumn("trial_id", F.when(F.col("_toggle") % 2 == 1, (F.col("_toggle") + 1) / 2).otherwise(0).cast("long")).drop("_toggle", "_at")


def carried_labels(frames: DataFrame, events: DataFrame) -> DataFrame:
    """frames (session, elapsed_s) with label: the last one that events (session, elapsed_s, kind, value) set at or before it.

    Before any label event it is unlabeled. An event at the time of a frame counts for it.
    """
    marks = events.where("kind = 'label'").select("session", "elapsed_s", F.lit(0).alias("_kind"), F.col("value").alias("_label"))
    rest = [c for c in frames.columns if c not in ("session", "elapsed_s", "label")]
    both = frames.select("session", "elapsed_s", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_label"), *rest)
    both = both.unionByName(marks, allowMissingColumns=True)
    d = scans.carried(both, "_label", "elapsed_s", "_kind").where("_kind = 1")
    return d.withColumn("label", F.coalesce("_label", F.lit(UNLABELED))).drop("_kind", "_label")


def capture_counts(frames: DataFrame) -> DataFrame:
    """(session, saved, dropped, failed, effective_fps, label_frames) of frames (session, status, label, t_ms).

    status is saved, dropped or failed. The rate is that of saved frames, 2 decimals; 0 without a span.
    """
    saved = F.col("status") == "saved"
    span = F.max(F.when(saved, F.col("t_ms"))) - F.min(F.when(saved, F.col("t_ms")))
    d = frames.groupBy("session").agg(
        F.count_if(saved).alias("saved"),
        F.count_if(F.col("status") == "dropped").alias("dropped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        span.alias("_span"),
    )
    rate = F.when(F.col("_span") > 0, F.round((F.col("saved") - 1) / (F.col("_span") / 1000), 2)).otherwise(0.0)
    by_label = frames.where(saved).groupBy("session", "label").agg(F.count("*").alias("n"))
    by_label = by_label.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_frames"))
    return d.withColumn("effective_fps", rate).drop("_span").join(by_label, "session", "left")
