"""The dataset build: recordings become a quality-gated, split, windowed set of clips.

Inputs are tables, so the job scales with sessions and frames: log (session, pos,
frame_index, filename, label, trial, device_timestamp_ms, host_time_unix), images
(session, filename, h, w, depth) and meta (session, fps, depth_scale). A session
is fitted on its reference rows, frames are transformed where they lie, and only
statistics, labels and clips are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import UNLABELED, frame_times_ms
from fathom.operators import frames, preprocess, splits
from fathom.operators.preprocess import Params
from fathom.operators.tables import small, stored
from fathom.sources.png import encode_png_rgb

# The quality gates, and what is only warned about.
MAX_RAIL_FRAC, MIN_STD_MM, MIN_FACE_COVERAGE = 0.02, 0.5, 0.5
JITTER = 2
WARN_FACE_COVERAGE, DRIFT_WARN_MM, LEAST_SESSIONS, LEAST_TRAIN_SHARE = 0.8, 2.0, 3, 0.4


@dataclass(frozen=True)
class Options:
    """The defaults of a build."""

    clip_len: int = 16
    stride: int = 4
    min_purity: float = 0.9
    min_clip_valid: float = 0.4
    max_gap_factor: float = 2.5
    include_unlabeled: bool = False
    ref_label: str = "neutral"
    ref_seconds: float = 1.0
    min_ref_frames: int = 20
    allow_session_start_reference: bool = False
    allow_low_quality: bool = False
    val_frac: float = 0.2
    test_frac: float = 0.2
    rebuild: bool = False
    reshuffle_splits: bool = False


def cache_keys(log: DataFrame, meta: DataFrame, params: Params, options: Options) -> DataFrame:
    """(session, key, digest): what a session's pixels depend on, and its labels."""
    policy = {k: v for k, v in asdict(options).items() if k in ("ref_label", "ref_seconds", "min_ref_frames", "allow_session_start_reference")}
    given = F.lit(repr((preprocess.VERSION, sorted(params.as_dict().items(), key=str), sorted(policy.items()))))
    n = log.groupBy("session").agg(F.count("*").alias("n"))
    key = F.sha1(F.concat_ws("|", given, F.col("n").cast("string"), F.col("depth_scale").cast("string")))
    d = n.join(meta.select("session", "depth_scale"), "session").select("session", key.alias("key"))
    return d.join(frames.label_digest(log), "session")


def cache_actions(keys: DataFrame, cached: DataFrame | None, rebuild: bool = False) -> DataFrame:
    """keys with action: reuse, relabel (labels changed, pixels didn't) or build, by the keys and digests of cached."""
    if cached is None or rebuild:
        return keys.withColumn("action", F.lit("build"))
    old = cached.select("session", F.col("key").alias("_key"), F.col("digest").alias("_digest"))
    same = F.col("key") == F.col("_key")
    action = F.when(same & (F.col("digest") == F.col("_digest")), "reuse").when(same, "relabel").otherwise("build")
    return keys.join(old, "session", "left").withColumn("action", action).drop("_key", "_digest")


def reference_rows(log: DataFrame, meta: DataFrame, options: Options) -> DataFrame:
    """(session, filename, depth_scale, source): the rows that each session is fitted on, some tens; sessions without give none."""
    want = F.greatest(F.lit(options.min_ref_frames), F.rint(F.lit(options.ref_seconds) * F.col("fps"))).cast("int")
    run = frames.longest_run(log).where((F.col("label") == options.ref_label) & (F.col("length") >= options.min_ref_frames))
    d = log.select("session", "pos", "filename").join(meta.select("session", "depth_scale", want.alias("_want")), "session")
    d = d.join(run.select("session", "start", "length"), "session", "left" if options.allow_session_start_reference else "inner")
    first = F.coalesce("start", F.lit(0))
    d = d.where((F.col("pos") >= first) & (F.col("pos") < first + F.least(F.coalesce("length", "_want"), "_want")))
    source = F.when(F.col("start").isNull(), "session_start").otherwise(f"label:{options.ref_label}")
    return d.select("session", "filename", "depth_scale", source.alias("source"))


#: Images as a table, or what gives those of some rows (session, and filename where given), so that only these are decoded.
Images = DataFrame | Callable[[DataFrame], DataFrame]


def pictures(images: Images, wanted: DataFrame) -> DataFrame:
    """The images of wanted (session, and filename where it has one), a stored table."""
    if callable(images):
        return images(wanted)
    return images.join(small(wanted, 96), wanted.columns, "left_semi")


def session_rollup(stats: DataFrame) -> DataFrame:
    """Per session: n_frames, valid_frac, rail_frac and coverage as means over frames, std_mm as their median, and n_unreadable where stats has it."""
    unreadable = [F.count_if("unreadable").alias("n_unreadable")] if "unreadable" in stats.columns else []
    return stats.groupBy("session").agg(
        *unreadable,
        F.count("*").alias("n_frames"),
        F.avg("valid_frac").alias("valid_frac"),
        F.avg("rail_frac").alias("rail_frac"),
        F.median("std_mm").alias("std_mm"),
        F.avg("face_coverage").alias("coverage"),
    )


def label_dc(stats: DataFrame) -> DataFrame:
    """(session, label, dc): the mean of the frames' medians, missing ones left out, 3 decimals."""
    d = stats.where(F.col("median_mm").isNotNull()).groupBy("session", "label")
    return d.agg(F.round(F.avg("median_mm"), 3).alias("dc"))


def dc_spread(dc: DataFrame) -> DataFrame:
    """(session, spread): the span of label_dc(); 0 below two labels."""
    return dc.groupBy("session").agg(F.when(F.count("*") > 1, F.round(F.max("dc") - F.min("dc"), 3)).otherwise(0.0).alias("spread"))


def gates() -> dict[str, Column]:
    return {"saturated": F.col("rail_frac") > MAX_RAIL_FRAC, "flat": F.col("std_mm") < MIN_STD_MM, "uncovered": F.col("coverage") < MIN_FACE_COVERAGE}


def gated(rollup: DataFrame, allow_low_quality: bool = False) -> DataFrame:
    """rollup with problems, the gates that a session fails, and refused."""
    d = frames.gate_problems(rollup, gates())
    return d.withColumn("refused", F.lit(False)) if allow_low_quality else d


def clip_index(stats: DataFrame, meta: DataFrame, options: Options) -> DataFrame:
    """The windows of all sessions with the reason why one is refused, null for clips. stats: a row per frame with valid_frac, label, trial, t_ms."""
    d = stats.withColumn("valid", F.round("valid_frac", 4))
    windows = frames.clip_candidates(d, options.clip_len, options.stride)
    windows = windows.join(small(meta.select("session", "fps"), 64), "session")
    gap = options.max_gap_factor * 1000.0 / F.greatest(F.lit(1.0), F.coalesce("fps", F.lit(30.0)).cast("double"))
    return frames.clip_verdicts(windows, gap, options.min_clip_valid, options.min_purity, options.include_unlabeled).drop("fps")


def manifest_frames(stats: DataFrame, session_splits: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per frame; frame_index is its place in the session."""
    d = splits.with_splits(stats, session_splits).join(F.broadcast(labels), "label", "left")
    return d.select(
        "session",
        F.col("pos").alias("frame_index"),
        "label",
        F.coalesce("label_id", F.lit(0)).alias("label_id"),
        F.col("trial").alias("trial_id"),
        "split",
        F.round("valid_frac", 4).alias("valid_frac"),
        "device_timestamp_ms",
        "host_time_unix",
    )


def manifest_clips(clips: DataFrame, session_splits: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per clip with its clip_id."""
    d = splits.with_splits(clips.where("reason IS NULL"), session_splits).join(F.broadcast(labels), "label", "left")
    d = frames.numbered_clips(d)
    purity = F.round(F.col("n_label") / F.col("length"), 3)
    return d.select("clip_id", "session", "start", "length", "label", F.coalesce("label_id", F.lit(0)).alias("label_id"), F.col("trial").alias("trial_id"), "split", purity.alias("purity"))


def clip_counts(windows: DataFrame, session_splits: DataFrame) -> DataFrame:
    """(kind, split, label, n): clips by split, by label, by both and in all, and refused windows by reason (as label)."""
    d = splits.with_splits(windows, session_splits)
    kept = d.where("reason IS NULL").groupingSets([["split"], ["label"], ["split", "label"], []], "split", "label").agg(F.count("*").alias("n"))
    lost = d.where("reason IS NOT NULL").groupBy(F.col("reason").alias("label")).agg(F.count("*").alias("n"))
    return kept.select(F.lit("clips").alias("kind"), "split", "label", "n").unionByName(lost.select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("split"), "label", "n"))


def build_warnings(sessions: DataFrame, refused: DataFrame, clips: DataFrame, val: float = 0.2, test: float = 0.2) -> DataFrame:
    """(rule, detail): what makes a dataset doubtful, eight rules; those about sessions have a row per session.

    sessions (session, spread, coverage), refused (session), clips (split, label).
    Clips are counted once, by split and label; their rules only read these counts.
    """
    counts = stored(clips.groupBy("split", "label").agg(F.count("*").alias("n")), "clip-counts")
    known = counts.where(F.col("label") != UNLABELED)
    every = known.agg(F.collect_set("label").alias("every"))
    by_split = counts.groupBy("split").agg(F.collect_set(F.when(F.col("label") != UNLABELED, F.col("label"))).alias("own"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *map(of, ("train", "val", "test")))

    def rule(frame: DataFrame, name: str, holds: Column, detail: Column) -> DataFrame:
        return frame.where(holds).select(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))

    found = [
        rule(refused.select("session").distinct(), "refused", F.lit(True), F.col("session")),
        rule(sessions.where(F.col("spread") > DRIFT_WARN_MM), "drift", F.lit(True), F.col("session")),
        rule(sessions.where(F.col("coverage") < WARN_FACE_COVERAGE), "low_coverage", F.lit(True), F.col("session")),
        rule(sessions.agg(F.count("*").alias("n")), "few_sessions", F.col("n") < LEAST_SESSIONS, F.col("n")),
        *[rule(total, "empty_split", F.col(s) == 0, F.lit(s)) for s, share in (("val", val), ("test", test)) if share > 0],
        rule(total, "small_train", (F.col("n") > 0) & (F.col("train") < LEAST_TRAIN_SHARE * F.col("n")), F.concat_ws("/", "train", "n")),
        rule(every, "few_classes", F.size("every") < 2, F.size("every")),
        # One row of labels, a vocabulary.
        rule(
            by_split.join(F.broadcast(every), F.size("own") < F.size("every")),
            "missing_class",
            F.lit(True),
            F.concat_ws(" ", "split", F.to_json(F.array_sort(F.array_except("every", "own")))),
        ),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dataset_spec(built: dict[str, DataFrame], params: Params, options: Options) -> DataFrame:
    """One row, spec: the build as JSON (parameters, gates, label map, sessions, counts). It holds a line per session."""
    spark = built["sessions"].sparkSession
    fixed = {
        "preproc_version": preprocess.VERSION,
        "preproc_params": {k: v for k, v in params.as_dict().items() if v is not None},
        "reference_policy": {k: getattr(options, k) for k in ("ref_label", "ref_seconds", "min_ref_frames", "allow_session_start_reference")},
        "quality_gates": {"max_rail_frac": MAX_RAIL_FRAC, "min_std_mm": MIN_STD_MM, "min_face_coverage": MIN_FACE_COVERAGE, "overridden": options.allow_low_quality},
        "clip": {k: getattr(options, k) for k in ("stride", "min_purity", "min_clip_valid", "max_gap_factor", "include_unlabeled")} | {"length": options.clip_len},
    }

    def literal(value: object) -> Column:
        if isinstance(value, dict):
            return F.struct(*[literal(v).alias(k) for k, v in value.items()])
        return F.array(*map(literal, value)) if isinstance(value, list | tuple) else F.lit(value)

    def map_of(key: str, value: Column) -> Column:
        by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), by_key))

    info = F.struct("split", "n_frames", "reference_mm", "roi", F.col("valid_frac").alias("mean_valid_fraction"), F.col("coverage").alias("mean_face_coverage"), F.col("rail_frac").alias("rail_fraction"), F.col("std_mm").alias("median_relief_mm"), F.col("spread").alias("label_dc_spread_mm"), "label_mean_depth_mm", "reference_source", "fit_notes")
    sessions = built["sessions"].agg(map_of("session", info).alias("sessions"), F.sum("n_frames").alias("frames"), F.count("*").alias("n"))
    members = built["sessions"].groupBy("split").agg(F.array_sort(F.collect_list("session")).alias("names")).agg(map_of("split", F.col("names")).alias("split_sessions"))
    labels = built["labels"].agg(map_of("label", F.col("label_id")).alias("label_map"))
    refused = built["refused"].agg(F.array_sort(F.collect_set("session")).alias("refused_sessions"))
    counts = built["counts"].agg(
        F.coalesce(F.max(F.when((F.col("kind") == "clips") & F.col("split").isNull() & F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("clips"),
        *[F.map_from_entries(F.array_sort(F.collect_list(F.when(w, F.struct(F.col(k).alias("k"), F.col("n").alias("v")))))).alias(c) for c, k, w in (
            ("clips_per_split", "split", (F.col("kind") == "clips") & F.col("label").isNull() & F.col("split").isNotNull()),
            ("clips_per_label", "label", (F.col("kind") == "clips") & F.col("split").isNull() & F.col("label").isNotNull()),
            ("clips_rejected", "label", F.col("kind") == "rejected"),
        )],
    )
    by_label = built["frames"].groupBy("label").agg(F.count("*").alias("n")).agg(map_of("label", F.col("n")).alias("frames_per_label"))
    d = spark.range(1).select(*[literal(v).alias(k) for k, v in fixed.items()])
    for part in (sessions, members, labels, refused, counts, by_label):  # one row each
        d = d.join(F.broadcast(part), F.lit(True), "left")
    total = F.struct(F.col("n").alias("sessions"), "frames", "frames_per_label", "clips", "clips_per_split", "clips_per_label", "clips_rejected")
    return d.select(F.to_json(F.struct(*fixed, "label_map", "refused_sessions", "sessions", "split_sessions", total.alias("counts"))).alias("spec"))


def build(log: DataFrame, images: Images, meta: DataFrame, params: Params | None = None, options: Options | None = None, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole build; images as told at Images. Returns sessions, refused, states, stats, rel, splits, labels, frames, clips, counts, warnings and spec.

    Further columns of meta go to sessions. rel holds the relative frames, stats a
    row of numbers per frame. before holds
    the tables of an earlier build: sessions that haven't changed keep their
    pixels, fit and statistics (a relabelled one keeps its reference and its label
    means), and their splits unless reshuffle_splits. Sessions without enough
    reference frames, without a plausible surface or with failing gates are in
    refused, with the reason.
    """
    params, options = params or Params(), options or Options()
    log = stored(log.withColumn("t_ms", frame_times_ms(F.col("device_timestamp_ms"), F.col("host_time_unix"))), "log")
    keys = stored(cache_actions(cache_keys(log, meta, params, options), before["sessions"] if before else None, options.rebuild), "keys")
    work = small(keys.where("action = 'build'").select("session"), 32)
    own_log = log.join(work, "session", "left_semi")
    chosen = stored(reference_rows(own_log, meta, options), "reference-rows")
    fitted_on = pictures(images, chosen.select("session", "filename")).select("session", "filename", "h", "w", "depth")
    fitted_on = fitted_on.join(small(chosen.drop("source"), 96), ["session", "filename"])
    states = stored(preprocess.fit(fitted_on, params, "depth_scale", options.min_ref_frames), "states")
    sources = chosen.groupBy("session").agg(F.first("source").alias("reference_source"))
    # Images are transformed where they lie; what they become is a tenth of them, and statistics are a few numbers.
    d = pictures(images, keys.where("action = 'build'").select("session"))
    d = d.join(small(stored(meta.select("session", "depth_scale"), "scales"), 64), "session")
    made = preprocess.transform(d, states, params, "depth_scale")
    made = stored(made.withColumn("rel", F.col("rel").cast("array<float>")), "relative")
    # Every logged frame of a fitted session: one whose image is missing is an unreadable one.
    places = own_log.select("session", "pos", "filename").join(small(states.where("problem IS NULL").select("session"), 32), "session")
    stats = places.join(made.drop("rel", "h", "w", "depth_scale"), ["session", "filename"], "left").drop("filename")
    lost = F.col("unreadable").isNull()
    for c in ("valid_frac", "rail_frac", "std_mm", "face_coverage"):
        stats = stats.withColumn(c, F.when(lost, 0.0).otherwise(F.col(c)))
    stats = stats.withColumns({"misfit": F.coalesce("misfit", F.lit(False)), "unreadable": F.coalesce("unreadable", F.lit(True))})
    # Places go to the images, which stay where they are as long as the places are few; then they are written once.
    blank = F.array_repeat(F.lit(None).cast("float"), params.out_size**2).alias("rel")
    there = made.where("rel IS NOT NULL")
    rel = there.select("session", "filename", "rel").join(small(places, 64), ["session", "filename"]).select("session", "pos", "rel")
    rel = rel.unionByName(places.join(there.select("session", "filename"), ["session", "filename"], "left_anti").select("session", "pos", blank))
    rel = stored(rel, "placed")
    if before:
        keep = keys.where("action <> 'build'").select("session")
        columns = ["session", "pos", *preprocess.STATS, "misfit", "unreadable"]
        stats = stats.select(*columns).unionByName(before["stats"].select(*columns).join(keep, "session", "left_semi"))
        rel = rel.unionByName(before["rel"].join(keep, "session", "left_semi"))
        states = states.unionByName(before["states"].join(keep, "session", "left_semi"))
        old = before["sessions"].join(keep, "session", "left_semi")
        sources = sources.unionByName(old.select("session", "reference_source"))
    stats = stored(stats.join(log.select("session", "pos", "label", "trial", "t_ms", "device_timestamp_ms", "host_time_unix"), ["session", "pos"]), "stats")
    dc = label_dc(stats)
    means = dc.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "dc")))).alias("label_mean_depth_mm"))
    rollup = session_rollup(stats).join(dc_spread(dc), "session", "left").join(means, "session", "left").fillna(0.0, ["spread"])
    if before:  # labels don't move what was measured when the session was built
        was = before["sessions"].join(keep, "session", "left_semi").select("session", F.col("spread").alias("_spread"), F.col("label_mean_depth_mm").alias("_means"))
        rollup = rollup.join(was, "session", "left").withColumn("spread", F.coalesce("_spread", "spread")).withColumn("label_mean_depth_mm", F.coalesce("_means", "label_mean_depth_mm")).drop("_spread", "_means")
    misfit = stats.groupBy("session").agg(F.max("misfit").alias("misfit"))
    judged = stored(gated(rollup, options.allow_low_quality).join(misfit, "session"), "judged")
    reason = F.when(F.col("misfit"), "a frame's shape isn't the fitted one").otherwise(F.array_join("problems", ", "))
    short = keys.join(states, "session", "left_anti").select("session", F.lit("no reference rows").alias("reason"))
    unfit = states.where("problem IS NOT NULL").select("session", F.col("problem").alias("reason"))
    refused = stored(short.unionByName(unfit).unionByName(judged.where("refused OR misfit").select("session", reason.alias("reason"))), "refused")
    good = judged.where("NOT refused AND NOT misfit").drop("refused", "misfit")
    previous = before["sessions"].select("session", "split") if before and not options.reshuffle_splits else None
    session_splits = stored(splits.assign_splits(good.select("session"), options.val_frac, options.test_frac, previous), "splits")
    sessions = good.join(session_splits, "session").join(keys, "session").join(sources, "session", "left")
    sessions = sessions.join(states.select("session", "roi", "reference_mm", "n_reference_frames", "fit_notes"), "session")
    sessions = stored(sessions.join(small(meta, 256), "session"), "sessions")
    kept = stats.join(small(session_splits.select("session"), 32), "session", "left_semi")
    labels = stored(frames.label_ids(kept), "labels")
    windows = stored(clip_index(kept, meta, options), "windows")
    clips = stored(manifest_clips(windows, session_splits, labels), "clips")
    out = {
        "sessions": sessions,
        "refused": refused,
        "states": states,
        "stats": stats.drop("label", "trial", "t_ms", "device_timestamp_ms", "host_time_unix"),
        "rel": rel,
        "splits": session_splits,
        "labels": labels,
        "frames": manifest_frames(kept, session_splits, labels),
        "clips": clips,
        "counts": clip_counts(windows, session_splits),
        "warnings": build_warnings(sessions, refused, clips, options.val_frac, options.test_frac),
    }
    return out | {"spec": dataset_spec(out, params, options)}


def write(built: dict[str, DataFrame], path: str) -> None:
    """The tables under path: Parquet, the two manifests as CSV with a header, the spec as text."""
    for name, d in built.items():
        if name in ("frames", "clips"):
            d.write.csv(f"{path}/manifest_{name}", header=True)
        elif name == "spec":
            d.write.text(f"{path}/dataset_spec")
        else:
            d.write.partitionBy("session").parquet(f"{path}/{name}") if name == "rel" else d.write.parquet(f"{path}/{name}")
    built["clips"].write.parquet(f"{path}/clips")


def read(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """The tables that write() left under path; with strict, a dataset of another version is refused."""
    spec = spark.read.text(f"{path}/dataset_spec")
    version = spec.select(F.get_json_object("value", "$.preproc_version")).first()[0]
    if strict and version != preprocess.VERSION:
        raise ValueError(f"the dataset was built with preprocessing {version}, this is {preprocess.VERSION}: build it again")
    names = ("sessions", "refused", "states", "stats", "rel", "splits", "labels", "clips", "counts", "warnings")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    frames_of = "session string, frame_index int, label string, label_id int, trial_id int, split string, valid_frac double, device_timestamp_ms string, host_time_unix string"
    return out | {"frames": spark.read.csv(f"{path}/manifest_frames", schema=frames_of, header=True), "spec": spec.withColumnRenamed("value", "spec")}


def quality_tiles(built: dict[str, DataFrame], params: Params, n: int = 5) -> DataFrame:
    """(session, refused, nth, pos, tile): for a look at each session its reference (nth -1) and up to n evenly spaced frames, as bytes.

    Sessions that the gates refused are among them, as they are the ones worth a
    look; those without a fit, or of frames of several shapes, have nothing to show.
    0 to 255 span -clip_mm to clip_mm; missing pixels are null.
    """
    scaled = lambda image: F.transform(image, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v / params.clip_mm + 1) / 2)) * 255).cast("int"))
    known = lambda image: F.transform(F.arrays_zip(image.alias("v"), scaled(image).alias("s")), lambda x: F.when(x["v"].isNotNull(), x["s"]))
    out = built["stats"].join(built["refused"].select("session"), "session", "left_semi").groupBy("session").agg(F.count("*").alias("n_frames"), F.max("misfit").alias("misfit"))
    out = out.where("NOT misfit").select("session", "n_frames", F.lit(True).alias("refused"))
    shown = stored(built["sessions"].select("session", "n_frames", F.lit(False).alias("refused")).unionByName(out), "shown")
    picked = frames.even_sample(shown.select("session", "n_frames"), n)
    picked = built["rel"].join(small(picked, 64), ["session", "pos"]).select("session", "nth", "pos", "rel")
    reference = built["states"].where("problem IS NULL").select("session", F.lit(-1).alias("nth"), F.lit(None).cast("int").alias("pos"), F.col("reference_image").alias("rel"))
    return picked.unionByName(reference).join(small(shown, 64), "session").select("session", "refused", "nth", "pos", known(F.col("rel")).alias("tile"))


#: Fixed value: the side of a tile of a picture, in pixels.
TILE = 160


def coloured(tile: np.ndarray, side: int = TILE) -> np.ndarray:
    """A square image of 0 to 255 and NaN as side x side colours from blue over green to red, NaN black, each pixel by the nearest one."""
    at = np.arange(side) * len(tile) // side
    v = tile[at][:, at] / 255
    rgb = np.stack([1.5 - np.abs(4 * v - k) for k in (3, 2, 1)], axis=-1)
    return (np.clip(np.nan_to_num(rgb, nan=0.0), 0, 1) * 255).round().astype(np.uint8)


def quality_pictures(built: dict[str, DataFrame], params: Params, n: int = 5) -> DataFrame:
    """(name, content): a PNG of each session of quality_tiles(), its tiles in a row, the reference first; a refused one's name ends in _REFUSED.png.

    recordings.write_files() makes them files. A session has n + 1 tiles, so a group is bounded.
    """
    side = params.out_size
    kinds = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("nth").to_pylist(), table.column("tile").to_pylist(), strict=True), key=lambda r: r[0])
        tiles = [coloured(np.array(tile, float).reshape(side, side)) for _, tile in rows]
        name = f"{key[0].as_py()}{'_REFUSED' if key[1].as_py() else ''}.png"
        return pa.Table.from_pylist([{"name": name, "content": encode_png_rgb(np.hstack(tiles))}], schema=kinds)

    tiles = quality_tiles(built, params, n).select(F.col("session").cast("string").alias("session"), "refused", "nth", "tile")
    return tiles.groupBy("session", "refused").applyInArrow(run, "name string, content binary")


#: Places of a stretch of frames that clips are cut from; a multiple of what stands at its end a second time.
STRETCH, HALOS = 192, 16
#: Clips that a task hands on at a time.
CLIPS_AT_ONCE = 8


def dataset_clips(built: dict[str, DataFrame], params: Params, split: str | None = "train", mode: str = "absolute", labels: list[str] | None = None, augment: int | None = None) -> DataFrame:
    """Training samples: clip_id, session, label, y, steps (a struct(depth, mask) per frame, in order).

    labels gives the label space, numbered from 0, else the label map does; clips
    with other labels are left out. mode as in model_input(). augment is a seed: clips
    start up to JITTER frames off, and their frames are varied (see Variation).

    Frames are cut into stretches of a session. The first frames of a stretch are
    also at the end of the one before it, as many as the longest clip needs, so
    each image is moved about once, however many clips hold it. A task runs
    through its stretches in order and keeps the frames of one clip.
    """
    clips = splits.of_split(built["clips"], split)
    if labels is None:
        space = built["labels"].select("label", F.col("label_id").alias("y"))
    else:
        space = clips.sparkSession.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, y int")
    # A vocabulary: a row per label.
    clips = clips.join(F.broadcast(space), "label").select("clip_id", "session", "start", F.col("length").cast("int").alias("length"), "label", "y")
    lengths = built["sessions"].select("session", F.col("n_frames").cast("int").alias("n_frames"))
    clips = frames.moved_starts(clips, lengths, 0 if augment is None else JITTER, augment or 0)
    halo = (clips.agg(F.max("length")).first()[0] or 1) - 1
    size = max(STRETCH, HALOS * halo)
    stretch = lambda pos: F.floor(F.col(pos) / size).cast("int")
    ends = F.least(F.col("start") + F.col("length"), F.col("n_frames")) - 1
    none = F.lit(None).cast("array<float>").alias("rel")
    wanted = clips.select("session", stretch("start").alias("stretch"), ends.alias("at"), F.lit(2).alias("kind"), none, F.struct(*clips.columns).alias("clip"))
    parts = wanted.select("session", "stretch").distinct()
    clip_type = F.lit(None).cast(wanted.schema["clip"].dataType).alias("clip")
    again = F.when((F.col("pos") % size < halo) & (F.col("pos") >= size), F.array(stretch("pos") - 1, stretch("pos"))).otherwise(F.array(stretch("pos")))
    held = built["rel"].join(small(clips.select("session").distinct(), 32), "session", "left_semi")
    held = held.select("session", F.explode(again).alias("stretch"), F.col("pos").alias("at"), F.lit(1).alias("kind"), F.col("rel").cast("array<float>").alias("rel"), clip_type)
    if mode == "deform":
        references = built["states"].select("session", F.col("reference_image").cast("array<float>").alias("rel")).join(parts, "session")
        held = held.unionByName(references.select("session", "stretch", F.lit(-1).alias("at"), F.lit(0).alias("kind"), "rel", clip_type))
    d = held.unionByName(wanted).repartition("session", "stretch").sortWithinPartitions("session", "stretch", "at", "kind")
    d = d.select("session", "stretch", "kind", F.col("at").cast("int").alias("at"), "rel", "clip.clip_id", "clip.label", "clip.y", "clip.start", "clip.length", "clip.n_frames")
    vary = None if augment is None else preprocess.Variation(augment)
    side = params.out_size
    outputs = "clip_id long, session string, label string, y int, steps array<struct<depth:array<float>,mask:array<float>>>"

    def sample(images: dict[int, np.ndarray], reference: np.ndarray | None, clip: int, start: int, length: int, n_frames: int) -> np.ndarray:
        made = [(images[min(start + k, n_frames - 1)], reference) for k in range(length)]
        if vary:
            made = [vary.of(clip, k, *pair) for k, pair in enumerate(made)]
        # The reference is varied alike for all steps of a clip.
        depth, mask = preprocess.clip_input(np.stack([m[0] for m in made]), params, mode, made[0][1])
        return np.stack([depth, mask], axis=1).reshape(length, 2, -1).astype(np.float32)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        values = np.concatenate([r[-1] for r in rows])
        edges = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[2])
        parts = [pa.ListArray.from_arrays(edges, pa.array(values[:, k].ravel())) for k in (0, 1)]
        ends = pa.array(np.cumsum([0, *(len(r[-1]) for r in rows)]).astype(np.int32))
        steps = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["depth", "mask"]))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, steps], names=["clip_id", "session", "label", "y", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, images, reference, rows = None, {}, None, []
        for batch in batches:
            keys = [c.to_pylist() for k, c in enumerate(batch.columns) if k != 4]
            for row, (session, part, kind, at, clip, label, y, start, length, n_frames) in enumerate(zip(*keys, strict=True)):
                if (session, part) != here:
                    here, images, reference = (session, part), {}, None
                if kind == 2:
                    rows.append((clip, session, label, y, sample(images, reference, clip, start, length, n_frames)))
                    if len(rows) == CLIPS_AT_ONCE:
                        yield batch_of(rows)
                        rows = []
                    continue
                image = batch.column(4)[row].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(side, side)
                if kind:
                    images[at] = image
                    images.pop(at - halo - 1, None)
                else:
                    reference = image
        if rows:
            yield batch_of(rows)

    return d.mapInArrow(run, outputs)
