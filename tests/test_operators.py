"""Small cases whose results follow by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import depth, frames, splits


def frame_rows(spark, labels, trials=None, step=33.0):
    rows = [("s", i, x, i * step, 1.0, (trials or [0] * len(labels))[i], 1) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "session string, pos int, label string, t_ms double, value double, trial int, valid int")


def test_splits_repeat_every_five(spark):
    names = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in range(1, 21)], "session string")
    got = [r.split for r in splits.assign_splits(names).orderBy("session").collect()]
    assert got == ["train", "test", "train", "val", "train"] * 4


def test_splits_without_val(spark):
    names = spark.createDataFrame([(f"{i:02d}",) for i in range(10)], "session string")
    got = [r.split for r in splits.assign_splits(names, val=0.0).orderBy("session").collect()]
    assert got == ["train", "train", "test", "train", "train", "train", "train", "test", "train", "train"]


def test_pinned_sessions_stay(spark):
    names = spark.createDataFrame([(f"{i:02d}",) for i in range(20)], "session string")
    old = splits.assign_splits(names.limit(6))
    new = {r.session: r.split for r in splits.assign_splits(names, previous=old).collect()}
    assert all(new[r.session] == r.split for r in old.collect()) and len(new) == 20


def test_modal_label_takes_the_first_of_equals(spark):
    d = frame_rows(spark, ["b", "a", "a", "b"])
    clip = frames.clip_candidates(d, 4, 4).first()
    assert (clip.label, clip.n_label) == ("b", 2)


def test_clips_have_no_partial_tail_and_straddling_comes_first(spark):
    d = frame_rows(spark, ["x"] * 40, [0] * 20 + [1] * 20)
    clips = frames.clip_verdicts(frames.clip_candidates(d), 83.3).orderBy("start").collect()
    assert [c.start for c in clips] == [0, 4, 8, 12, 16, 20, 24]
    assert [c.reason for c in clips] == [None, None, "straddles_trial", "straddles_trial", "straddles_trial", None, None]


def test_time_gap_ignores_the_step_into_the_window(spark):
    d = frame_rows(spark, ["x"] * 32).withColumn("t_ms", F.col("t_ms") + F.when(F.col("pos") >= 16, 1000.0).otherwise(0.0))
    reason = {c.start: c.reason for c in frames.clip_verdicts(frames.clip_candidates(d), 83.3).collect()}
    assert reason == {0: None, 4: "time_gap", 8: "time_gap", 12: "time_gap", 16: None}


def test_reference_is_the_earliest_longest_run(spark):
    d = frame_rows(spark, ["n"] * 3 + ["a"] + ["n"] * 3)
    assert [r.pos for r in frames.reference_rows(d, "n", 0.1, 30, 3).orderBy("pos").collect()] == [0, 1, 2]
    assert frames.reference_rows(d, "n", 0.1, 30, 4).count() == 0
    assert frames.reference_rows(d, "n", 0.1, 30, 4, fallback=True).count() == 4


def test_deform_masks_then_clips(spark):
    d = spark.sql("SELECT array(39D, 33D, NULL, 1000D) AS a, array(39D, 39D, 1D, 0D) AS b")
    r = d.select(depth.deform(F.col("a"), F.col("b"), 20.0).alias("m")).first().m
    assert r.depth == [0.0, -0.3, 0.0, 1.0] and r.mask == [1.0, 1.0, 0.0, 1.0]


def one_image(spark, values):
    return spark.createDataFrame([(1, values)], "k int, image array<double>")


def test_resize_isnt_diluted_by_missing_pixels(spark):
    d = one_image(spark, [7.0 if (i % 4) < 2 else None for i in range(16)])
    assert depth.resized(d, "image", 4, 2, 0.3).first().image == [7.0, None, 7.0, None]
    # Cells that cut pixels: three columns into two.
    d = one_image(spark, [1.0, 2.0, 4.0] * 3)
    got = depth.resized(d, "image", 3, 2, 0.3).first().image
    np.testing.assert_allclose(got, [4 / 3, 10 / 3] * 2)


def test_half_and_part_of_an_image_keep_their_values():
    half = np.zeros((64, 64), bool)
    half[:32] = True
    got = depth.masked_resize(np.full((64, 64), 5.0), half, 16, 0.25)
    np.testing.assert_allclose(got[:8], 5.0)
    assert np.isnan(got[8:]).all()
    for share in (0.1, 0.3, 0.5, 0.7):
        valid = np.arange(64)[None, :] < share * 64
        got = depth.masked_resize(np.full((64, 64), 7.0), np.broadcast_to(valid, (64, 64)), 8, 0.25)
        np.testing.assert_allclose(got[np.isfinite(got)], 7.0)


def test_empty_frame_statistics(spark):
    r = depth.frame_stats(one_image(spark, [None, None]), "image", 40.0).first()
    assert (r.valid_frac, r.rail_frac, r["std"], r.median) == (0.0, 1.0, 0.0, None)


def test_flat_grid_gives_two_triangles_per_cell(spark):
    d = one_image(spark, [1.0] * 9)
    m = depth.meshes(d, "image", 3, 10, 10, 1, 1, 1.0).first()
    assert [(f.i0, f.i1, f.i2) for f in m.faces] == [(0, 1, 3), (1, 2, 4), (3, 4, 6), (4, 5, 7), (1, 4, 3), (2, 5, 4), (4, 7, 6), (5, 8, 7)]
    assert all((n.nx, n.ny, n.nz) == (0, 0, -1) for n in m.normals) and len(m.vertices) == 9
    assert depth.meshes(d, "image", 3, 10, 10, 1, 1, 0.1).first().faces == []


def test_gradients_fill_holes_with_the_median(spark):
    r = depth.gradients(one_image(spark, [1.0, None, 5.0, 1.0, 2.0, 9.0]), "image", 3).first()
    gy, gx = np.gradient(np.array([[1.0, 2.0, 5.0], [1.0, 2.0, 9.0]]))
    assert r.gx == gx.ravel().tolist() and r.gy == gy.ravel().tolist()


def test_parts_against_a_flood_fill():
    r = np.random.default_rng(2)
    for shape in ((1, 1), (1, 9), (7, 1), (13, 17), (40, 30)):
        inside = r.random(shape) < 0.45
        got = depth.parts(inside)
        want, n = np.full(shape, -1), 0
        for start in zip(*np.nonzero(inside), strict=True):
            if want[start] < 0:
                todo = [start]
                want[start] = n
                while todo:
                    y, x = todo.pop()
                    for v in range(max(0, y - 1), min(shape[0], y + 2)):
                        for u in range(max(0, x - 1), min(shape[1], x + 2)):
                            if inside[v, u] and want[v, u] < 0:
                                want[v, u] = n
                                todo.append((v, u))
                n += 1
        assert (got == want).all()


def test_largest_surface_is_kept_or_all(spark):
    d = one_image(spark, [1.0, None, 1.0, 1.0, None, 1.0, None, None, None, None, None, 1.0])
    r = depth.keep_largest_surface(d, "image", 3, 2).first()
    assert r.others == 2 and [i for i, v in enumerate(r.image) if v] == [0, 3]
    assert depth.keep_largest_surface(d, "image", 3, 200).first().others == 0


def test_suggested_distance(spark):
    few = spark.createDataFrame([(100.0,)] * 3, "d double")
    assert tuple(depth.distance_histogram(few, 50, 900, 43, 500, 80).first()) == (None, 0.0)
    many = spark.createDataFrame([(float(100 + i % 3),) for i in range(600)] + [(800.0,)] * 200, "d double")
    r = depth.distance_histogram(many, 50, 900, 43, 500, 80).first()
    assert abs(r.distance - (50 + 2.5 * 850 / 43)) < 1e-9 and r.share == 0.75


def test_average_depth_drops_what_moves(spark):
    rows = [(1, [1.0, 1.0, 0.0]), (1, [1.1, 9.0, 0.0]), (1, [1.2, 5.0, 4.0])]
    px = depth.average_depth(depth.pixels(spark.createDataFrame(rows, "k int, image array<double>"), "image", 3), "k", 0.5)
    got = {r.px: (r.d, r.dropped) for r in px.collect()}
    assert got == {0: (1.1, False), 1: (None, True), 2: (None, True)}
    assert abs(depth.dropped_share(px, "k").first().share - 2 / 3) < 1e-12


def test_the_smoothed_value(spark):
    """By hand: 0.6 of the value before, 0.4 of the new one; 0, 10 give 4, and 1, 2, 3 give 0.6 * 1.4 + 1.2."""
    for values, want in (([0, 10], 4.0), ([1, 2, 3], 2.04), ([7], 7.0)):
        d = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(values)], "session string, pos int, v double")
        assert abs(frames.ema_last(d, "v").first().ema - want) < 1e-12
        assert abs(d.agg(frames.ema(F.sort_array(F.collect_list("v"))).alias("e")).first().e - want) < 1e-12
    assert frames.blend(3.0, 5.0, 0.0) == frames.blend(3.0, 5.0, -1.0) == 5.0


def test_many_names_are_split_by_their_ranks(spark):
    names = spark.range(0, 20000, 1, 7).select(F.format_string("%08d", "id").alias("session"))
    got = splits.assign_splits(names).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 12000, "test": 4000, "val": 4000}


def test_clips_of_the_default_sessions(spark):
    """Hand-counted: a second of neutral, then one second (or 0.7) of each of four labels; the first is neutral again, in the same trial."""

    def clips(n):
        labels, trials = ["neutral"] * (30 + n), [0] * (30 + n)
        for k in (1, 2, 3):
            labels += [f"condition_{k}"] * n
            trials += [k] * n
        rows = frames.clip_verdicts(frames.clip_candidates(frame_rows(spark, labels, trials)), 83.3).collect()
        kept = [r.label for r in rows if r.reason is None]
        return len(rows), [kept.count(x) for x in sorted(set(kept), reverse=True)], sum(r.reason == "straddles_trial" for r in rows)

    assert clips(30) == (34, [12, 4, 4, 4], 10)
    assert clips(21) == (25, [9, 1, 2, 2], 11)


def test_clip_frames_repeat_the_last_and_stay_inside(spark):
    lengths = spark.createDataFrame([("s", 10)], "session string, n_frames int")
    clip = spark.createDataFrame([("s", 7, 5)], "session string, start int, length int")
    assert [r.pos for r in frames.clip_frames(clip, lengths).orderBy("step").collect()] == [7, 8, 9, 9, 9]
    moved = [frames.clip_frames(clip.withColumn("start", F.lit(4)), lengths, 2, k).agg(F.min("pos")).first()[0] for k in range(12)]
    assert set(moved) <= {2, 3, 4, 5} and len(set(moved)) > 1


def test_trials_toggle_on_and_off_across_recordings(spark):
    rows = [("a", i, i in (1, 3, 5)) for i in range(7)] + [("b", i, i == 2) for i in range(4)]
    d = frames.trial_numbers(spark.createDataFrame(rows, "session string, pos int, key boolean"), F.col("key"), ("session", "pos"))
    assert [r.trial_id for r in d.orderBy("session", "pos").collect()] == [0, 1, 1, 0, 0, 2, 2, 2, 2, 0, 0]


def test_selecting_rows_names_the_step_that_finds_none(spark):
    d = frame_rows(spark, ["a"] * 4 + ["b"] * 4, [0] * 6 + [1] * 2).withColumn("frame_index", F.col("pos") + 100)
    assert [r.pos for r in frames.select_rows(d, label="b", trial=0, span=(104, 106)).orderBy("pos").collect()] == [4, 5]
    assert frames.select_rows(d, frame=101, span=(0, 1)).count() == 1
    for given, message in (({"label": "c"}, "labelled 'c'"), ({"label": "a", "trial": 1}, "trial 1"), ({"span": (0, 5)}, "range 0:5")):
        with pytest.raises(ValueError, match=message):
            frames.select_rows(d, **given)


def test_even_samples_reach_both_ends(spark):
    lengths = spark.createDataFrame([("a", 12), ("b", 3), ("c", 1), ("d", 0)], "session string, n_frames int")
    got = {}
    for r in frames.even_sample(lengths).orderBy("session", "nth").collect():
        got.setdefault(r.session, []).append(r.pos)
    assert got == {s: np.linspace(0, n - 1, min(5, n)).astype(int).tolist() for s, n in (("a", 12), ("b", 3), ("c", 1))}


def test_labels_carry_on(spark):
    f = spark.createDataFrame([("s", float(t)) for t in range(5)], "session string, elapsed_s double")
    e = spark.createDataFrame([("s", 1.0, "label", "up"), ("s", 2.5, "trial_start", "1"), ("s", 3.5, "label", "down")], "session string, elapsed_s double, kind string, value string")
    assert [r.label for r in frames.carried_labels(f, e).orderBy("elapsed_s").collect()] == ["unlabeled", "up", "up", "up", "down"]


def test_statistics_across_images_need_no_rows_of_pixels(spark, monkeypatch):
    """Strips of three pixels and less against plain numpy, with holes, a null image and a short one."""
    r = np.random.default_rng(8)
    stack = {k: np.where(r.random((n, 11)) < 0.3, 0.0, r.normal(5, 1, (n, 11))) for k, n in (("a", 9), ("b", 2))}
    rows = [(k, x.tolist()) for k, v in stack.items() for x in v] + [("a", None), ("c", [1.0] * 4)]
    d = spark.createDataFrame(rows, "k string, image array<double>").repartition(4)
    monkeypatch.setattr(depth, "STRIP_CELLS", 30)
    got = {x.k: x for x in depth.average_images(d, "k", "image", 2.0, scale=2.0).collect()}
    for k, v in stack.items():
        v = np.where(v > 0, v, np.nan) * 2
        n = np.isfinite(v).sum(axis=0)
        low, middle, high = (np.array([np.percentile(c[np.isfinite(c)], q) if np.isfinite(c).any() else np.nan for c in v.T]) for q in (10, 50, 90))
        good = (n >= 3) & (high - low <= 2.0)
        np.testing.assert_allclose(np.array(got[k].image, float), np.where(good, middle, np.nan))
        assert got[k].dropped == (~good & (n > 0)).tolist() and got[k].n == len(v)
        assert got[k].share == (~good & (n > 0)).sum() / (n > 0).sum()
        median = np.array(depth.median_images(d.where(F.col("k") == k), "k", "image").first().image)
        np.testing.assert_allclose(median, np.median(stack[k], axis=0))
        inside = depth.inside_shares(d, "k", "image", 4.5, 5.5).where(F.col("k") == k).first()
        assert inside.n == len(v) and np.allclose(inside.shares, ((stack[k] > 4.5) & (stack[k] < 5.5)).mean(axis=0))
    assert got["c"].image == [None] * 4 and got["c"].share == 1.0
