"""The preprocessing on made scenes: a face before a wall, clutter, holes, drift."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import preprocess
from fathom.operators.preprocess import Params

H, W, SCALE = 120, 212, 0.0001
SMALL = Params(out_size=32)


def scene(ref_m=0.15, bulge=0.0, seed=0, clutter=False, face=True, h=H, w=W):
    """A raw frame and where the face is: a bump on an ellipse before a far wall."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    nx, ny = (x - w / 2) / (0.115 * w), (y - h / 2) / (0.19 * h)
    square = nx**2 + ny**2
    inside = (square < 3) & face
    d = np.where(inside, ref_m + 0.02 - 0.028 * np.exp(-square / 1.2), 0.55)
    d -= np.where(inside, bulge / 1000 * np.exp(-((nx - 0.4) ** 2 + (ny - 0.5) ** 2) / 0.1), 0)
    if clutter:
        d[int(0.85 * h) :] = np.linspace(0.2, 0.35, w)[None, :]
        d[: int(0.08 * h)] = 0.12
        d[int(0.3 * h) : int(0.34 * h), : int(0.12 * w)] = 0.095
    d += r.normal(0, 0.0004, (h, w))
    raw = np.rint(d / SCALE)
    raw[r.random((h, w)) < 0.01] = 0
    return raw.astype(np.int32), inside


def stack(n=12, **given):
    return np.stack([scene(seed=k, **given)[0] for k in range(n)])


def relative(state, raw, params=SMALL):
    roi = state["roi"]
    return preprocess.relative_frame(raw, (roi["x"], roi["y"], roi["side"]), state["reference_mm"], params, SCALE)


@pytest.fixture(scope="module")
def neutral():
    state = preprocess.fit_frames(stack(), SMALL, SCALE)
    assert "problem" not in state
    return state


def test_square_regions_stay_inside():
    for box in ((10, 10, 60, 40), (200, 100, 424, 240), (0, 0, 2, 2), (-5, 300, 500, 400)):
        x, y, side = preprocess.square_roi(box, (240, 424), 1.35)
        assert side >= 8 and 0 <= x <= 424 - side and 0 <= y <= 240 - side
    assert preprocess.square_roi((10, 20, 30, 44), (240, 424), 1.25) == (5, 17, 30)


def test_clutter_doesnt_move_the_fit(neutral):
    state = preprocess.fit_frames(stack(clutter=True), SMALL, SCALE)
    assert abs(state["reference_mm"] - neutral["reference_mm"]) < 20
    raw, inside = scene(seed=99, clutter=True)
    roi = state["roi"]
    box = np.zeros_like(inside)
    box[roi["y"] : roi["y"] + roi["side"], roi["x"] : roi["x"] + roi["side"]] = True
    assert (inside & box).sum() / box.sum() > 0.35 and (inside & box).sum() / inside.sum() > 0.9
    rel = relative(state, raw)
    valid, rail, std, _ = preprocess.image_stats(rel, SMALL.clip_mm)
    assert rail < 0.02 and std > 1 and valid > 0.3
    assert np.nanmax(np.abs(relative(state, scene(seed=99, clutter=True, bulge=3)[0]) - rel)) > 1


def test_a_given_region_is_honoured_or_refused():
    state = preprocess.fit_frames(stack(), Params(out_size=32, roi_override=(80, 40, 40)), SCALE)
    assert state["roi"] == {"x": 80, "y": 40, "side": 40} and 118 < state["reference_mm"] < 175
    for box in ((200, 40, 40), (-1, 0, 40), (0, 0, 4)):
        assert "does not fit" in preprocess.fit_frames(stack(3), Params(roi_override=box), SCALE)["problem"]
    with pytest.raises(ValueError):
        Params(roi_override=(1, 2))


def test_what_isnt_a_face_is_refused():
    assert "cm" in preprocess.fit_frames(stack(3, face=False), SMALL, SCALE)["problem"]
    assert "cm" in preprocess.fit_frames(np.full((5, 40, 60), 9000), SMALL, SCALE)["problem"]
    flat = np.full((5, 60, 100), 5500)
    flat[:, 20:40, 30:70] = 1500
    assert "flat" in preprocess.fit_frames(flat, SMALL, SCALE)["problem"]
    assert "from the expected" in preprocess.fit_frames(stack(5, ref_m=0.19), Params(out_size=32, ref_tolerance_m=0.02), SCALE)["problem"]
    assert "no depth at all" in preprocess.fit_frames(np.zeros((2, 20, 20)), SMALL, SCALE)["problem"]


def test_distance_doesnt_matter():
    images = []
    for ref in (0.13, 0.17):
        state = preprocess.fit_frames(stack(ref_m=ref), SMALL, SCALE)
        images.append(relative(state, scene(seed=50, ref_m=ref)[0]))
    both = np.isfinite(images[0]) & np.isfinite(images[1])
    assert both.mean() > 0.35 and abs(np.median(images[0][both] - images[1][both])) < 1


def test_deformation_survives(neutral):
    d = relative(neutral, scene(seed=60, bulge=12)[0]) - relative(neutral, scene(seed=60)[0])
    assert np.nanmax(np.abs(d)) > 5


def test_drift_of_a_frame_is_taken_off(neutral):
    params = Params(out_size=32, per_frame_dc="roi_median")
    a, b = (np.nanmedian(relative(neutral, scene(seed=70, ref_m=m)[0], params)) for m in (0.150, 0.153))
    assert abs(a - b) < 0.5
    with pytest.raises(ValueError):
        Params(per_frame_dc="other")
    with pytest.raises(ValueError, match="unknown"):
        Params.of(out=3)


def test_reference_is_the_median_of_the_surface():
    """Against medians by plain loops on a small stack."""
    r = np.random.default_rng(3)
    frames = 1500 + r.integers(-200, 200, (7, 20, 24)) + (np.arange(24) * 6)[None, None, :]
    frames[r.random(frames.shape) < 0.1] = 0
    params = Params(out_size=6, clip_mm=15, min_component_frac=0, roi_margin=1.0)
    state = preprocess.fit_frames(frames, params, SCALE)
    near, far = params.band
    d = frames * SCALE
    stable = [[sum(near < v < far for v in d[:, y, x]) / 7 >= 0.5 for x in range(24)] for y in range(20)]
    own = [v for y in range(20) for x in range(24) if stable[y][x] for v in d[:, y, x] if near < v < far]
    assert abs(state["reference_mm"] - np.median(own) * 1000) < 1e-9
    roi = state["roi"]
    cell = roi["side"] / 6
    for v in range(6):
        for u in range(6):
            total = cover = 0.0
            for y in range(roi["side"]):
                for x in range(roi["side"]):
                    part = max(0, min(y + 1, (v + 1) * cell) - max(y, v * cell)) * max(0, min(x + 1, (u + 1) * cell) - max(x, u * cell)) / cell**2
                    good = [s * 1000 for s in d[:, y + roi["y"], x + roi["x"]] if s > 0 and abs(s * 1000 - state["reference_mm"]) <= 15]
                    if part and good:
                        total += part * (np.median(good) - state["reference_mm"])
                        cover += part
            got = state["reference_image"][v * 6 + u]
            assert (got is None) == (cover <= 0.25) and (got is None or abs(got - total / cover) < 1e-9)


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for s, ref in (("a", 0.15), ("b", 0.16)):
        rows += [(s, k, H, W, scene(ref, seed=k)[0].ravel().tolist()) for k in range(6)]
    rows += [("a", 6, None, None, None), ("b", 6, 10, 10, [1500] * 100), ("c", 0, 20, 20, [9000] * 400), ("d", 0, None, None, None)]
    return spark.createDataFrame(rows, "session string, pos int, h int, w int, depth array<int>")


def test_sessions_are_fitted_and_their_frames_made_relative(spark, tables, tmp_path):
    states = preprocess.fit(tables.where("pos < 5"), SMALL, SCALE, least=1)
    got = {r.session: r for r in states.collect()}
    assert got["a"].problem is None and "cm" in got["c"].problem and "readable" in got["d"].problem
    alone = preprocess.fit_frames(stack(5), SMALL, SCALE)
    assert got["a"].reference_mm == alone["reference_mm"] and got["a"].reference_image == alone["reference_image"] and got["a"].n_reference_frames == 5
    made = {(r.session, r.pos): r for r in preprocess.transform(tables, states, SMALL, SCALE).collect()}
    assert len(made) == 14 and made["b", 6].misfit and made["b", 6].rel is None
    hole = made["a", 6]
    assert hole.rel == [None] * 1024 and (hole.valid_frac, hole.rail_frac, hole.std_mm, hole.median_mm, hole.face_coverage) == (0, 0, 0, None, 0)
    want = relative(alone, scene(0.15, seed=3)[0])
    np.testing.assert_array_equal(np.array(made["a", 3].rel, float), want.ravel())
    assert made["a", 3].face_coverage > made["a", 3].valid_frac and 0.9 < made["a", 3].face_coverage <= 1
    saved = preprocess.state_json(states, SMALL, SCALE)
    back = {r.session: r for r in preprocess.states_from_json(saved).collect()}
    assert set(back) == {"a", "b"} and back["a"].reference_image == got["a"].reference_image and back["b"].roi == got["b"].roi and back["a"].fit_notes == got["a"].fit_notes
    stale = saved.withColumn("state", F.regexp_replace("state", '"v2"', '"v1"'))
    assert preprocess.states_from_json(stale, strict=False).count() == 2
    with pytest.raises(Exception, match="version"):
        preprocess.states_from_json(stale).collect()
    again = {(r.session, r.pos): r.rel for r in preprocess.transform(tables, preprocess.states_from_json(saved), SMALL, SCALE).collect()}
    assert again["a", 3] == made["a", 3].rel


def test_model_inputs(spark):
    d = spark.sql("SELECT array(10D, NULL, 1e6D, -5D) AS a, array(1D, 1D, NULL, 5D) AS b")
    p = Params()
    absolute = d.select(preprocess.model_input(F.col("a"), "absolute", p).alias("m")).first().m
    assert absolute.depth == [0.25, 0.0, 1.0, -0.125] and absolute.mask == [1, 0, 1, 1]
    deform = d.select(preprocess.model_input(F.col("a"), "deform", p, F.col("b")).alias("m")).first().m
    assert deform.depth == [0.45, 0.0, 0.0, -0.5] and deform.mask == [1, 0, 0, 1]
    moved = spark.sql("SELECT array(39D, 33D) AS a, array(39D, 39D) AS b").select(preprocess.model_input(F.col("a"), "deform", p, F.col("b")).alias("m")).first().m
    assert moved.depth == [0.0, -0.3]  # clipped after the difference
    assert (preprocess.input_scale(p, "deform"), preprocess.input_scale(p, "absolute")) == (20.0, 40.0)
    for mode, ref in (("other", None), ("deform", None)):
        with pytest.raises(ValueError):
            preprocess.model_input(F.col("a"), mode, p, ref)
