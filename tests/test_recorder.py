"""PNG images against the plain definition of their filters; recording a stream, also with batches that come twice."""

import numpy as np

from fathom.sources import png, recorder, recordings
from tests.test_sources import png16


def test_any_filters_and_shapes_are_decoded():
    r = np.random.default_rng(1)
    shapes = [(1, 1), (1, 9), (9, 1), (2, 2), (13, 7), (7, 13)]
    images = [r.integers(0, 65536, shapes[k % 6]) if k % 4 else np.full(shapes[k % 6], 65535 * (k % 8 == 0)) for k in range(36)]
    data = [png16(x, r.integers(0, 5, 13).tolist()) for x in images]
    got = png.decode_many([*data, b"", None, b"\x89PNG\r\n\x1a\n", data[3][:40], data[5].replace(b"IDAT", b"IDAX")])
    assert all((g == x).all() and g.shape == x.shape for g, x in zip(got, images)) and got[36:] == [None] * 5
    for x in images:
        assert (png.decode_png16(png.encode_png16(x)) == x).all()


def frame(k, session="r1", **other):
    image = np.random.default_rng(k).integers(0, 3000, (5, 6))
    return {"session": session, "frame_index": k, "h": 5, "w": 6, "depth": image.ravel().tolist(), "device_timestamp_ms": 33.25 * k, "host_time_unix": 1e9 + k / 30, "label": ["neutral", "", 'a "b", c'][k % 3], "trial_id": k // 4} | other


def test_what_is_recorded_is_read_back(spark, tmp_path):
    rows = [frame(k) for k in range(7)] + [frame(7, h=9), frame(8, depth=None), frame(9, depth=[70000] * 30), frame(0, "r2")]
    for lo, hi in ((0, 4), (4, 11)):
        spark.createDataFrame(rows[lo:hi], recorder.FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    stream = spark.readStream.schema(recorder.FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    recorder.record(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
    assert recorder.finish(spark, root, {"program": "test"}) == 2

    def seen():
        log = [tuple(r) for r in recordings.frame_log(spark, root).orderBy("session", "pos").collect()]
        images = {(r.session, r.filename): r.depth for r in recordings.depth_frames(spark, root).collect()}
        meta = {r.session: (r.program, r.frames_saved, r.frames_failed_to_write, r.label_frame_counts, r.effective_fps) for r in recordings.metadata(spark, root).collect()}
        return log, images, meta

    log, images, meta = seen()
    assert [(r[0], r[1], r[2], r[7], r[8]) for r in log] == [("r1", k, k, rows[k]["label"] or "unlabeled", k // 4) for k in range(7)] + [("r2", 0, 0, "neutral", 0)]
    assert images == {(r["session"], f"depth/depth_{r['frame_index']:06d}.png"): r["depth"] for r in [*rows[:7], rows[10]]}
    assert meta["r1"] == ("test", 7, 3, {"neutral": 3, "unlabeled": 2, 'a "b", c': 2}, 30.0) and meta["r2"][:3] == ("test", 1, 0)
    # The same batches once more, as after a driver that was lost before it committed them, and one with frames seen before.
    again = recorder.sink(root)
    files = sorted(spark.read.parquet(f"{root}/_log").select("batch").distinct().toPandas()["batch"])
    for batch in files:
        own = spark.createDataFrame(rows[0:4] if batch == 0 else rows[4:11], recorder.FRAME)
        again(own, batch)
    again(spark.createDataFrame([frame(2, label="later"), frame(8, depth=None)], recorder.FRAME), 7)
    recorder.finish(spark, root, {"program": "test"})
    assert seen() == (log, images, meta)
