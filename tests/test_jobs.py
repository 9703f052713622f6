"""Whole jobs: recordings on disk to a dataset and back, exports, live predictions against the batch operators."""

import json
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import build, depth, export, preprocess, snapshots
from fathom.operators.preprocess import Params
from fathom.sources import recordings
from fathom.streaming import live
from tests.test_preprocess import H, SCALE, W, scene
from tests.test_sources import png16

PARAMS = Params(out_size=16)
OPTIONS = build.Options(clip_len=4, stride=2, ref_seconds=0.2, min_ref_frames=5, min_clip_valid=0.2)
LABELS = ["neutral"] * 8 + ["smile"] * 6 + ["blink"] * 6


def record(folder, ref=0.15, flat=False, labels=LABELS, meta=True):
    (folder / "depth").mkdir(parents=True)
    rows = ["label,frame_index,filename,trial_id,device_timestamp_ms,host_time_unix"]  # not the usual order
    for k, label in enumerate(labels):
        image = scene(ref, seed=k, bulge=4.0 if label == "smile" else 0.0)[0]
        if flat:
            image = np.where(image > 4000, image, 1500)
        name = f"depth/depth_{k:06d}.png"
        (folder / name).write_bytes(b"broken" if k == 17 else png16(image, [0, 2]))
        rows.append(f"{label},{k},{name},{0 if k < 8 else 1 + k // 14},{k * 33.3:.3f},{1e9 + k / 30:.6f}")
    (folder / "frame_timestamps.csv").write_text("\n".join(rows) + "\n")
    if meta:
        lens = {"fx": 110.0, "fy": 110.0, "ppx": W / 2, "ppy": H / 2}
        (folder / "metadata.json").write_text(json.dumps({"program": "p", "camera": {"stream": {"fps": 30}, "depth_scale_m_per_unit": SCALE, "depth_intrinsics": lens}}))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    for k, name in enumerate(("2024_a", "2024_b", "2024_c")):
        record(root / name, 0.145 + 0.005 * k)
    record(root / "2024_flat", flat=True)
    record(root / "2024_none", labels=["smile"] * 8)
    record(root / "2024_half", meta=False, labels=["smile"])
    return root


def inputs(spark, root):
    meta = recordings.metadata(spark, str(root)).select("session", "fps", "depth_scale")
    log = recordings.complete_sessions(recordings.frame_log(spark, str(root)), meta).drop("fps", "depth_scale")
    images = recordings.depth_frames(spark, str(root)).where("filename <> 'depth/depth_000006.png' OR session <> '2024_c'")  # one is lost
    return log, images, meta


@pytest.fixture(scope="module")
def built(spark, root):
    return build.build(*inputs(spark, root), PARAMS, OPTIONS)


def test_recordings_are_found(spark, root, tmp_path):
    assert [r.session for r in recordings.sessions(spark, str(root)).collect()] == ["2024_a", "2024_b", "2024_c", "2024_flat", "2024_none"]
    assert recordings.newest_recording(spark, str(root)) in ("2024_none", "2024_flat")
    (tmp_path / "x").mkdir()
    with pytest.raises(FileNotFoundError, match="no recordings found in"):
        recordings.sessions(spark, str(tmp_path))


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# all\nup  # one\n\ndown\nup\n")
    read = lambda p: [r.label for r in recordings.label_vocabulary(spark, str(tmp_path / p)).orderBy("nth").collect()]
    assert read("l.txt") == ["unlabeled", "up", "down"] and read("missing.txt") == ["unlabeled", "neutral"]
    (tmp_path / "m.txt").write_text("a\nunlabeled\n")
    assert read("m.txt") == ["unlabeled", "a", "unlabeled"]


def test_the_build(spark, root, built):
    assert {r.session: r.reason for r in built["refused"].collect()}.keys() == {"2024_flat", "2024_none"}
    sessions = {r.session: r for r in built["sessions"].collect()}
    assert all(s.n_unreadable == 1 + (s.session == "2024_c") and s.fps == 30 for s in sessions.values()) and built["rel"].count() == 60
    assert set(sessions) == {"2024_a", "2024_b", "2024_c"} and {s.split for s in sessions.values()} == {"train", "test"}
    frames_of = built["frames"].where("session = '2024_a'").orderBy("frame_index").collect()
    assert [r.label for r in frames_of] == LABELS and [r.label_id for r in frames_of] == [2] * 8 + [3] * 6 + [1] * 6
    assert frames_of[17].valid_frac == 0 and frames_of[3].valid_frac > 0.3
    clips = built["clips"].orderBy("clip_id").collect()
    assert [c.clip_id for c in clips] == list(range(len(clips))) and [(c.session, c.start) for c in clips] == sorted((c.session, c.start) for c in clips)
    assert {(c.start, c.label) for c in clips if c.session == "2024_a"} == {(0, "neutral"), (2, "neutral"), (4, "neutral"), (8, "smile"), (10, "smile"), (14, "blink"), (16, "blink")}
    one = preprocess.fit_frames(np.stack([scene(0.145, seed=k)[0] for k in range(6)]), PARAMS, SCALE)
    assert sessions["2024_a"].reference_mm == one["reference_mm"] and sessions["2024_a"].n_reference_frames == 6
    rows = {r.rule for r in built["warnings"].collect()}
    assert {"refused", "empty_split"} <= rows and "few_sessions" not in rows
    spec = json.loads(built["spec"].first()[0])
    assert spec["label_map"] == {"unlabeled": 0, "blink": 1, "neutral": 2, "smile": 3} and spec["counts"]["clips"] == len(clips) == 21
    assert spec["counts"]["frames_per_label"] == {"blink": 18, "neutral": 24, "smile": 18} and spec["refused_sessions"] == ["2024_flat", "2024_none"]
    assert spec["sessions"]["2024_b"]["split"] == sessions["2024_b"].split and spec["preproc_params"]["out_size"] == 16


def test_a_second_build_reuses_relabels_and_pins(spark, root, built, tmp_path):
    shutil.copytree(root / "2024_a", tmp_path / "r" / "2024_0")
    for name in ("2024_a", "2024_b", "2024_c"):
        shutil.copytree(root / name, tmp_path / "r" / name)
    log = (tmp_path / "r" / "2024_b" / "frame_timestamps.csv").read_text()
    (tmp_path / "r" / "2024_b" / "frame_timestamps.csv").write_text(log.replace("blink", "wink"))
    again = build.build(*inputs(spark, tmp_path / "r"), PARAMS, OPTIONS, before=built)
    actions = {r.session: r.action for r in again["sessions"].collect()}
    assert actions == {"2024_0": "build", "2024_a": "reuse", "2024_b": "relabel", "2024_c": "reuse"}
    was, now = ({r.session: (r.split, r.reference_mm, r.spread) for r in b["sessions"].collect()} for b in (built, again))
    assert all(now[s] == was[s] for s in was) and again["rel"].count() == 80
    assert again["frames"].where("session = '2024_b' AND label = 'wink'").count() == 6
    changed = build.build(*inputs(spark, tmp_path / "r"), Params(out_size=8), OPTIONS, before=built)
    assert {r.action for r in changed["sessions"].collect()} == {"build"}


def test_a_written_dataset_is_read_back(spark, built, tmp_path):
    path = str(tmp_path / "dataset")
    build.write(built, path)
    assert spark.read.csv(f"{path}/manifest_clips", header=True).count() == 21
    assert {r.session: r["split"] for r in recordings.previous_splits(spark, f"{path}/dataset_spec").collect()} == {r.session: r["split"] for r in built["splits"].collect()}
    assert recordings.previous_splits(spark, f"{path}/nothing").count() == 0
    back = build.read(spark, path)
    assert back["clips"].count() == 21 and back["frames"].count() == 60 and set(back) == set(built)
    assert build.dataset_clips(back, PARAMS, "train").count() == build.dataset_clips(built, PARAMS, "train").count()
    spec = built["spec"].first()[0]
    spark.createDataFrame([(spec.replace('"v2"', '"v1"'),)], "spec string").write.mode("overwrite").text(f"{path}/dataset_spec")
    with pytest.raises(ValueError, match="v1"):
        build.read(spark, path)
    assert build.read(spark, path, strict=False)["clips"].count() == 21


def test_quality_tiles(spark, built):
    rows = build.quality_tiles(built, PARAMS).where("session = '2024_a'").orderBy("nth").collect()
    assert [(r.nth, r.pos) for r in rows] == [(-1, None), (0, 0), (1, 4), (2, 9), (3, 14), (4, 19)]
    assert all(len(r.tile) == 256 and all(v is None or 0 <= v <= 255 for v in r.tile) for r in rows) and any(v is not None for v in rows[0].tile)


def test_quality_pictures(spark, built, tmp_path):
    import struct
    import zlib

    assert build.coloured(np.array([[0.0, np.nan], [127.5, 255.0]]), 4)[::2, ::2].tolist() == [[[0, 0, 128], [0, 0, 0]], [[128, 255, 128], [128, 0, 0]]]
    # The gates refuse a session that was fitted: it is shown as such.
    moved = built["sessions"].where("session = '2024_a'").select("session", F.lit("flat").alias("reason"))
    refused = built | {"sessions": built["sessions"].where("session <> '2024_a'"), "refused": built["refused"].unionByName(moved)}
    assert {(r.session, r.n) for r in build.quality_tiles(refused, PARAMS).where("refused").groupBy("session").agg(F.count("*").alias("n")).collect()} >= {("2024_a", 6)}
    pictures = build.quality_pictures(refused, PARAMS, 3)
    n = recordings.write_files(pictures, "name", "content", str(tmp_path / "qc"))
    names = {p.name for p in (tmp_path / "qc").iterdir()}
    assert len(names) == n and "2024_a_REFUSED.png" in names and {f"{r.session}.png" for r in refused["sessions"].collect()} <= names
    tiles = {r.nth: r.tile for r in build.quality_tiles(refused, PARAMS, 3).where("session = '2024_a'").collect()}
    data = (tmp_path / "qc" / "2024_a_REFUSED.png").read_bytes()
    assert struct.unpack(">II", data[16:24]) == (4 * 160, 160)
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]]), np.uint8).reshape(160, 1 + 3 * 640)
    image = np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8).reshape(160, 640, 3)
    for k, nth in enumerate(sorted(tiles)):
        for i, j in ((0, 0), (80, 80), (159, 30)):
            v = tiles[nth][i * 16 // 160 * 16 + j * 16 // 160]
            want = [0, 0, 0] if v is None else [round(min(1, max(0, 1.5 - abs(4 * v / 255 - c))) * 255) for c in (3, 2, 1)]
            assert image[i, 160 * k + j].tolist() == want


def test_training_samples(spark, built):
    absolute = build.dataset_clips(built, PARAMS, "train").collect()
    assert absolute and all(len(r.steps) == 4 and len(r.steps[0].depth) == 256 for r in absolute)
    values = np.array([s.depth for r in absolute for s in r.steps])
    assert np.isfinite(values).all() and abs(values).max() <= 1
    some = build.dataset_clips(built, PARAMS, None, "deform", labels=["smile", "neutral"], augment=7).collect()
    assert {(r.label, r.y) for r in some} == {("smile", 0), ("neutral", 1)} and len(some) == 15
    again = build.dataset_clips(built, PARAMS, None, "deform", labels=["smile", "neutral"], augment=7).collect()
    assert sorted(some) == sorted(again) and build.dataset_clips(built, PARAMS, "train", augment=3).count() == len(absolute)


def test_augmentation_moves_frames_and_reference_alike(spark):
    image = np.arange(64, dtype=float)
    d = spark.createDataFrame([(5, 0, image.tolist(), image.tolist()), (5, 1, image.tolist(), image.tolist()), (6, 0, image.tolist(), None)], "clip_id long, step int, rel array<double>, reference_image array<double>")
    still = {(r.clip_id, r.step): r for r in preprocess.augmented(d, 8, 1, depth_mm=2.0, noise_mm=0.0, dropout=0.0).collect()}
    a, b = (np.array(still[5, k].rel) - np.array(still[5, k].reference_image) for k in (0, 1))
    assert np.allclose(a, a[0]) and np.allclose(a, b) and 0 < abs(a[0]) <= 2 and still[6, 0].reference_image is None
    assert sorted(still[5, 0].reference_image) == image.tolist()
    lost = np.array(preprocess.augmented(d, 8, 1, dropout=0.5).first().rel, float)
    assert 8 < np.isnan(lost).sum() < 56


def test_gates(spark):
    rows = [("flat", 0.9, 0.0, 0.0, 1.0), ("saturated", 0.9, 1.0, 3.0, 1.0), ("thin", 0.2, 0.0, 3.0, 0.4), ("good", 0.5, 0.0, 3.0, 0.9)]
    d = spark.createDataFrame(rows, "session string, valid_frac double, rail_frac double, std_mm double, coverage double")
    assert {r.session: r.problems for r in build.gated(d).collect()} == {"flat": ["flat"], "saturated": ["saturated"], "thin": ["uncovered"], "good": []}
    assert not any(r.refused for r in build.gated(d, True).collect())


LENS = export.Lens(110.0, 110.0, W / 2, H / 2)


def test_export_of_a_recording(spark, root, tmp_path):
    log, images, _ = inputs(spark, root)
    log, images = log.where("session = '2024_a'"), images.where("session = '2024_a'")
    lens = export.intrinsics(recordings.metadata(spark, str(root))).where("session = '2024_a'").first()
    assert (lens.fx, lens.ppx, lens.distorted) == (110.0, W / 2, False)
    with pytest.raises(Exception, match="intrinsics"):
        export.intrinsics(recordings.metadata(spark, str(root)).withColumn("camera", F.col("camera").dropFields("depth_intrinsics.fy").withField("depth_intrinsics.fy", F.lit(None).cast("double")))).collect()
    assert export.parse_lens("1,2,3,4") == export.Lens(1, 2, 3, 4)
    region = export.face_region(images, log, PARAMS, SCALE).first()
    roi = (region.roi.x, region.roi.y, region.roi.side)
    mesh = export.export(log.where("pos < 6"), images, W, LENS, SCALE, PARAMS, roi=roi, reference_mm=region.reference_mm)
    r = mesh.first()
    assert mesh.count() == 1 and r.tag == "avg6from000000" and len(r.normals) == len(r.vertices) > 500 and all(n.nz <= 0 for n in r.normals)
    v = np.array([[p.x, p.y, p.z] for p in r.vertices])
    assert abs(np.ptp(v[:, 0]) / 110 - 0.7) < 0.5 and 10 < np.ptp(v[:, 2]) < 80
    metres = export.export(log.where("pos < 6"), images, W, LENS, SCALE, PARAMS, roi=roi, reference_mm=region.reference_mm, units="m", center=True).first()
    m = np.array([[p.x, p.y, p.z] for p in metres.vertices])
    np.testing.assert_allclose((v - v.mean(axis=0)) / 1000, m, atol=1e-9)
    assert len(metres.faces) == len(r.faces)
    one = export.export(log.where("pos = 3"), images, W, LENS, SCALE, PARAMS, roi=roi, step=2).first()
    assert one.tag == "frame000003" and 0.15 < len(one.vertices) / len(v) < 0.35
    sequence = export.export(log, images, W, LENS, SCALE, PARAMS, sequence=True, every=5)
    assert [x.tag for x in sequence.orderBy("tag").collect()] == [f"frame{k:06d}" for k in (0, 5, 10, 15)]
    far = export.export(log.where("pos = 3"), images, W, LENS, SCALE, PARAMS, reference_mm=5000.0).first()
    assert far.vertices == [] and far.faces == []
    metric = images.where("depth IS NOT NULL").withColumn("depth", depth.metric(F.col("depth"), SCALE))
    assert "550 mm" in export.why_empty(metric, 5000).first().advice or "surface" in export.why_empty(metric, 5000).first().advice
    points = export.iter_points(log, images, W, LENS, SCALE, label="blink", every=2, distance=0.16)
    assert sorted(x.frame_index for x in points.collect()) == [14, 16, 18]
    named = mesh.withColumn("name", text.export_name(F.col("session"), F.lit(None).cast("string"), F.col("tag"), True, "ply"))
    for binary in (True, False):
        folder = tmp_path / f"ply{binary}"
        assert recordings.write_files(export.with_ply(named, binary=binary, comments=("a",)), "name", "ply", str(folder)) == 1
        assert [p.name for p in folder.iterdir()] == ["2024_a_avg6from000000_mesh.ply"]
        back = recordings.read_ply(spark, f"{folder}/*.ply").first()
        np.testing.assert_allclose([[p.x, p.y, p.z] for p in back.vertices], v, atol=1e-3 if binary else 1e-4)
        assert back.faces == r.faces
    lines = export.obj_text(mesh, comments=("c",)).first().obj.split("\n")
    n = len(v)
    assert lines[0] == "# c" and lines[1].startswith("v ") and lines[1 + n].startswith("vn ") and lines[-1] == ""
    f = r.faces[0]
    assert lines[1 + 2 * n] == f"f {f.i0 + 1}//{f.i0 + 1} {f.i1 + 1}//{f.i1 + 1} {f.i2 + 1}//{f.i2 + 1}" and len(lines) == 2 + 2 * n + len(r.faces)


def readings(n, controls=()):
    rows = []
    for k in range(n):
        for nth, at, kind in controls:
            if at == k:
                rows.append(("s", k * 0.1, nth, None, None, None, kind))
        rows.append(("s", k * 0.1, 1000 + k, H, W, scene(0.15, seed=k, bulge=3.0 * (k > 8))[0].ravel().tolist(), None))
    return pd.DataFrame(rows, columns=["session", "at", "nth", "h", "w", "depth", "control"], dtype=object)


def mean_model(x):
    return x[0].mean() * 10, x[1].mean()


def run_live(spark, tmp_path, rows, parts, **given):
    kinds = "session string, at double, nth long, h int, w int, depth array<int>, control string"
    for lo, hi in zip([0, *parts], [*parts, len(rows)], strict=True):
        spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in rows.iloc[lo:hi].itertuples(index=False)], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at"))
    return live.run_available(live.live_readout(stream, mean_model, ["up", "down"], PARAMS, SCALE, length=3, every=2, alpha=0.6, warm_frames=4, **given), str(tmp_path / "out")).orderBy("ts").collect()


def test_live_equals_batch(spark, tmp_path):
    rows = readings(14)
    got = run_live(spark, tmp_path, rows, [5, 9], mode="deform")
    images = np.stack([np.array(d).reshape(H, W) for d in rows["depth"]])
    state = preprocess.fit_frames(images[:4], PARAMS, SCALE)
    d = spark.createDataFrame([("s", k, H, W, images[k].ravel().tolist()) for k in range(14)], "session string, pos int, h int, w int, depth array<int>")
    states = preprocess.fit(d.where("pos < 4"), PARAMS, SCALE)
    x = preprocess.model_input(F.col("rel"), "deform", PARAMS, F.col("reference_image"))
    rel = preprocess.transform(d.where("pos >= 4"), states, PARAMS, SCALE).join(states.select("session", "reference_image"), "session")
    inputs_of = {r.pos: (r.x.depth, r.x.mask) for r in rel.select("pos", x.alias("x")).collect()}
    assert states.first().reference_mm == state["reference_mm"]
    smoothed, want = None, []
    for count in range(1, 11):
        if count >= 3 and count % 2 == 0:
            clip = np.array([inputs_of[3 + k] for k in range(count - 2, count + 1)]).transpose(1, 0, 2)
            e = np.exp(np.array(mean_model(clip)))
            p = e / e.sum()
            smoothed = p if smoothed is None else 0.6 * smoothed + 0.4 * p
            want.append(smoothed)
    np.testing.assert_allclose([r.p for r in got], want, atol=1e-9)
    assert all(r.top_label == ["up", "down"][int(np.argmax(r.p))] and r.confidence == max(r.p) for r in got)
    told = "session string, ts timestamp, top_label string, confidence double, p array<double>, problem string"
    log = live.prediction_log(spark.createDataFrame(got, told), ["up", "down"]).first()
    assert log.p_up == f"{got[0].p[0]:.4f}" and log.host_time_unix == "0.700000"


def test_pauses_and_warming_again(spark, tmp_path):
    rows = readings(16, controls=((1, 7, "pause"), (2, 9, "pause"), (3, 11, "rewarm")))
    got = [round(r.ts.timestamp(), 3) for r in run_live(spark, tmp_path, rows, [8])]
    # 4 to 6 fill the buffer (count 3); 9, 10 after the pause aren't enough; 11 to 14 warm up; 15 is one frame.
    assert got == []
    reader = live.Reader(PARAMS, SCALE, "absolute", 2, 1, 0.6, 3)
    for k in range(3):
        assert reader.frame(scene(seed=k)[0], mean_model) is None
    fit = reader.fitted
    reader.control("rewarm")
    for _ in range(3):
        reader.frame(np.full((H, W), 9000), mean_model)
    assert reader.fitted is fit and reader.warming is None and "cm" in reader.problem
    assert reader.frame(scene(seed=5)[0], mean_model) is None and reader.frame(scene(seed=6)[0], mean_model) is not None


def test_exports_of_all_sessions(spark, root, tmp_path):
    """Each session by its own lens, face and distance; names, notes and files."""
    log, images, meta = inputs(spark, root)
    meta = recordings.metadata(spark, str(root)).select("session", "depth_scale", "camera")
    log, meta = (d.where("session IN ('2024_a', '2024_b')") for d in (log, meta))
    lens = meta.withColumn("camera", F.when(F.col("session") == "2024_b", F.col("camera").withField("depth_intrinsics.fx", F.lit(220.0))).otherwise(F.col("camera")))
    decode = lambda wanted: recordings.depth_frames(spark, str(root), wanted)
    how = export.How(label="neutral", expected_distance_m=0.145)
    got = {r.session: r for r in export.export_sessions(log, decode, lens, PARAMS, how).collect()}
    one = export.export_sessions(log.where("session = '2024_a'"), images, meta, PARAMS, export.How(label="neutral", expected_distance_m=0.145)).first()
    assert set(got) == {"2024_a", "2024_b"} and got["2024_a"].name == "2024_a_neutral_avg8from000000_mesh.ply" and len(got["2024_a"].vertices) > 300
    assert got["2024_a"].vertices == one.vertices and "temporal median of 8 frames" in one.note and one.note.endswith("labelled neutral")
    wide, narrow = (np.ptp([v.x for v in got[s].vertices]) for s in ("2024_a", "2024_b"))
    assert narrow < 0.7 * wide and got["2024_a"].advice is None and len(got["2024_a"].normals) == len(got["2024_a"].vertices)
    # The wall fills most of the view: what is measured is its distance, where there is no face.
    wall = export.export_sessions(log, decode, meta, PARAMS, export.How(label="neutral", auto_distance=True)).collect()
    measured = {r.session: r.distance for r in export.session_distances(images.where("filename = 'depth/depth_000000.png'"), SCALE).collect()}
    assert 500 < measured["2024_a"] < 600 and all(abs(v.z - measured[r.session]) <= 80 for r in wall for v in r.vertices[:50]) and len(wall) == 2
    # A frame that can't be read counts for nothing: 17 is broken in every session.
    broken = {r.tag for r in export.export_sessions(log, decode, meta, PARAMS, export.How(span=(15, 19))).collect()}
    assert broken == {"avg3from000015"}
    empty = export.export_sessions(log, images, meta, PARAMS, export.How(frame=3, depth_range=(2.0, 3.0), full_frame=True)).collect()
    assert len(empty) == 2 and all(r.vertices == [] and r.faces == [] and "a surface at" in r.advice and r.tag == "frame000003" for r in empty)
    points = export.How(sequence=True, every=5, points=True, decimate=2, center=True, units="m")
    rows = export.export_sessions(log, images, meta, PARAMS, points)
    assert {r.name for r in rows.collect()} == {f"{s}_3d/frame_{k:06d}.ply" for s in ("2024_a", "2024_b") for k in (0, 5, 10, 15)}
    assert all(r.faces == [] and abs(np.mean([v.z for v in r.vertices])) < 1e-9 for r in rows.collect())
    assert export.write_exports(rows, str(tmp_path / "out"), points) == 8
    assert sorted(p.name for p in (tmp_path / "out" / "2024_b_3d").iterdir()) == [f"frame_{k:06d}.ply" for k in (0, 5, 10, 15)]
    text_of = (tmp_path / "out" / "2024_b_3d" / "frame_000005.ply").read_bytes()[:400]
    assert b"comment from 2024_b" in text_of and b"comment units m; camera axes" in text_of and b"comment frame 5 label=neutral" in text_of


def test_the_face_is_looked_for_in_the_first_neutral_rows(spark, monkeypatch):
    """Two neutral rows at the start and more after place 5000: both count."""
    rows = [("s", k, f"f{k}", "neutral" if k < 2 or k > 5000 else "x") for k in [*range(0, 20), *range(5001, 5006)]]
    log = spark.createDataFrame(rows, "session string, pos int, filename string, label string")
    images = spark.createDataFrame([("s", f"f{p}", H, W, scene(0.15, seed=p)[0].ravel().tolist()) for _, p, _, x in rows if x == "neutral"], "session string, filename string, h int, w int, depth array<int>")
    r = export.face_region(images, log, PARAMS, SCALE).first()
    assert r.roi is not None and r.reference_mm == preprocess.fit(images, PARAMS, SCALE).first().reference_mm
    monkeypatch.setattr(export, "FACE_FRAMES", 2)
    assert export.face_region(images, log, PARAMS, SCALE).first().roi is None


def test_a_warm_up_ends_and_tells_its_problem(spark, tmp_path):
    """Far frames fail to fit, the next four do; a frame of another shape is told of."""
    far = np.full((H, W), 9000)
    good = [scene(0.15, seed=k)[0] for k in range(12)]
    shown = [*(("far", far, k * 0.1) for k in range(4)), *(("warm", good[k], 10.0 + 4.9 * k) for k in range(5)), *(("clip", good[5 + k], 40.0 + k) for k in range(4)), ("odd", far[:, :-2], 50.0), ("clip", good[9], 51.0), ("clip", good[10], 52.0)]
    rows = pd.DataFrame([("s", at, k, *x.shape, x.ravel().tolist(), None) for k, (_, x, at) in enumerate(shown)], columns=["session", "at", "nth", "h", "w", "depth", "control"], dtype=object)
    got = run_live(spark, tmp_path, rows, [2, 6, 11])
    # Four frames up to 24.7 s are the warm-up; those at 42 and 51 s are the fourth and sixth after it.
    told = [(round(r.ts.timestamp(), 3), r.problem) for r in got]
    assert "cm" in got[0].problem and got[0].p is None and told[0][0] == 0.3
    assert told[1:] == [(42.0, None), (50.0, f"a frame of {H}x{W - 2}, the session is fitted on {H}x{W}"), (51.0, None)]


def test_too_few_frames_are_no_warm_up():
    reader = live.Reader(PARAMS, SCALE, "absolute", 2, 1, 0.6, 45)
    image = scene(seed=1)[0]
    assert reader.frame(image, mean_model, 0.0) is None and reader.frame(image, mean_model, 19.9) is None and reader.frame(image, mean_model, 20.0) is None
    assert reader.reports == ["the warm-up got 2 frames"] and len(reader.warming) == 1 and reader.since == 20.0
    for k in range(3):
        reader.frame(scene(seed=k)[0], mean_model, 21.0 + k)
    assert reader.frame(image, mean_model, 40.0) is None and reader.warming is None and len(reader.buffer) == 1
    other = live.Reader(PARAMS, SCALE, "absolute", 2, 1, 0.6, 45)
    other.restore(reader.kept())
    assert other.fitted["roi"] == reader.fitted["roi"] and np.array_equal(other.buffer[0], reader.buffer[0], equal_nan=True) and other.count == 1
    assert other.frame(image[:, :-1], mean_model, 41.0) is None and "the session is fitted on" in other.reports[0]
    assert other.frame(image, mean_model, 42.0).tolist() == reader.frame(image, mean_model, 42.0).tolist()


def test_snapshots_survive_broken_builds_and_bytes(spark, root, built, tmp_path, monkeypatch):
    path = str(tmp_path / "dataset")
    assert snapshots.load(spark, path) is None
    first = snapshots.commit(built, path)
    images = lambda tables: {(r.session, r.pos): r.rel for r in tables["rel"].collect()}
    files = lambda: sorted(p for p in (tmp_path / "dataset" / "rel").rglob("*.parquet"))
    back, old = snapshots.load(spark, path), files()
    assert images(back) == images(built) and back["clips"].count() == 21 and len(old) == 3
    # One session is changed; the build dies before the rename, and what was there is still read.
    shutil.copytree(root, tmp_path / "r")
    log = (tmp_path / "r" / "2024_b" / "frame_timestamps.csv").read_text()
    (tmp_path / "r" / "2024_b" / "frame_timestamps.csv").write_text(log.replace("depth/depth_000003.png", "depth/depth_000004.png"))
    again = build.build(*inputs(spark, tmp_path / "r"), PARAMS, OPTIONS, before=back)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            snapshots.commit(again, path)
    assert snapshots.current(spark, path)["snapshot"] == first and images(snapshots.load(spark, path)) == images(built)
    actions = {r.session: r.action for r in again["sessions"].collect()}
    second = snapshots.commit(again, path)
    now = snapshots.load(spark, path)
    assert second != first and {k: v for k, v in images(now).items() if k[0] != "2024_b"} == {k: v for k, v in images(built).items() if k[0] != "2024_b"}
    # Sessions that didn't change keep their files: only those built are in the new snapshot.
    assert sorted({p.parent.name for p in files() if f"snapshot={second}" in str(p)}) == [f"session={s}" for s, a in sorted(actions.items()) if a == "build"] and actions["2024_a"] == "reuse"
    # A broken byte: the session is built again, the others are reused.
    broken = next(p for p in old if "session=2024_a" in str(p))
    data = bytearray(broken.read_bytes())
    data[len(data) // 2] ^= 1
    broken.write_bytes(bytes(data))
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert [r.session for r in snapshots.broken(spark, path).collect()] == ["2024_a"]
    mended = build.build(*inputs(spark, tmp_path / "r"), PARAMS, OPTIONS, before=snapshots.load(spark, path))
    assert {r.session: r.action for r in mended["sessions"].collect()} == {"2024_a": "build", "2024_b": "reuse", "2024_c": "reuse"}
    snapshots.commit(mended, path)
    assert snapshots.broken(spark, path).isEmpty() and images(snapshots.load(spark, path)) == images(now | {"rel": mended["rel"]})
