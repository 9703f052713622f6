"""Recordings written here and read back; live predictions with a pause."""

import json
import struct
import zlib

import numpy as np
import pandas as pd

from fathom.sources import recordings
from fathom.streaming import live


def png16(image, filters):
    """A 16-bit grey PNG whose rows use the given filters."""
    raw = image.astype(">u2").view(np.uint8).reshape(len(image), -1).astype(int)
    rows = b""
    for y, line in enumerate(raw):
        up = raw[y - 1] if y else np.zeros_like(line)
        a, c = np.append([0, 0], line[:-2]), np.append([0, 0], up[:-2])
        p = a + up - c
        near = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
        guess = [0 * line, a, up, (a + up) // 2, near][filters[y % len(filters)]]
        rows += bytes([filters[y % len(filters)]]) + ((line - guess) & 255).astype(np.uint8).tobytes()
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], len(image), 16, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def test_recordings(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 65536, (11, 7))
    (tmp_path / "s1" / "depth").mkdir(parents=True)
    (tmp_path / "s1" / "metadata.json").write_text(json.dumps({"program": "p", "frames_saved": 2}))
    (tmp_path / "s1" / "frame_timestamps.csv").write_text("frame_index,filename,device_timestamp_ms,host_time_unix,host_time_iso,label,trial_id\n5,depth/depth_000005.png,1.5,2,x,,\n3,depth/depth_000003.png,,2,x,up,4\n")
    (tmp_path / "s1" / "depth" / "depth_000005.png").write_bytes(png16(image, [0, 1, 2, 3, 4]))
    (tmp_path / "s1" / "depth" / "depth_000003.png").write_bytes(b"no image")
    assert [(r.session, r.frames_saved) for r in recordings.metadata(spark, str(tmp_path)).collect()] == [("s1", 2)]
    log = recordings.frame_log(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.session, r.pos, r.frame_index, r.label, r.trial_id) for r in log] == [("s1", 0, 5, "unlabeled", 0), ("s1", 1, 3, "up", 4)]
    got = {r.filename: r for r in recordings.depth_frames(spark, str(tmp_path)).collect()}
    assert got["depth/depth_000003.png"].depth is None
    one = recordings.depth_frames(spark, str(tmp_path), spark.createDataFrame([("s1", "depth/depth_000005.png"), ("s2", "x")], "session string, filename string"))
    assert [r.filename for r in one.collect()] == ["depth/depth_000005.png"]
    good = got["depth/depth_000005.png"]
    assert (good.h, good.w) == image.shape and good.depth == image.ravel().tolist()


def test_no_window_spans_a_pause(spark, tmp_path):
    rows = pd.DataFrame({"session": 1, "ts": range(12), "event_id": range(12), "value": [float(k) for k in range(12)], "paused": [k == 5 for k in range(12)]})
    for lo, hi in ((0, 7), (7, 12)):
        spark.createDataFrame(rows[lo:hi]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.run_available(live.live_predictions(stream, length=3, every=2, alpha=0.6), str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r.pos, round(r.smoothed, 12)) for r in got] == [(2, 1.0), (4, 1.8), (8, 7.0), (10, 7.8)]
