"""Queries of the depth preprocessing, the build and the export over frames made of the given tables.

Four embeddings of 64 numbers are the quadrants of a 16 x 16 frame of raw depths
in units of 0.1 mm around 150 mm, with some holes; frames go to three sessions in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import build, depth, export, frames, network, preprocess, training
from fathom.operators.preprocess import Params
from fathom.operators.tables import shared_path, stored
from fathom.plans.catalogue import CLIPS, EVENT_SPLIT, FRAMES, MESH, PIXELS, event_clips, event_frames, image_meshes, images, query, read
from fathom.sources import ply
from fathom.streaming import live

SCALE = 0.0001
PARAMS = Params(out_size=5, expected_distance_m=0.16, search_band_m=0.01, clip_mm=12.0, deform_clip_mm=6.0, roi_margin=1.0, min_relief_mm=0.5, coverage_thresh=0.3)
#: The side of a frame's quadrants.
QUADRANT = 8
#: Frames that a session is fitted on.
REFERENCE = 20


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, pos, h, w, depth."""
    d = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("frame"), (F.col("vec_id") % 4).alias("q"), "vec_id", "embedding")
    raw = F.transform("embedding", lambda e, i: F.when((F.col("vec_id") * 7 + i * 3) % 37 == 0, 0).otherwise(1500 + F.floor(e.cast("double") * 1000)).cast("int"))
    # get(), as Spark may evaluate depth of a frame with too few quadrants before it is dropped.
    d = d.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("q", raw.alias("raw")))).alias("x")).where(F.size("x") == 4)
    row = lambda r: F.concat(*[F.slice(F.get("x", side + F.floor(r / 8).cast("int") * 2)["raw"], (r % 8) * 8 + 1, 8) for side in (0, 1)])
    depth_of = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), row))
    return d.select((F.col("frame") % 3).alias("session"), F.floor(F.col("frame") / 3).cast("int").alias("pos"), F.lit(16).alias("h"), F.lit(16).alias("w"), depth_of.alias("depth"))


def fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The frames and the states of their sessions."""
    raw = raw_frames(spark, sf_dir)
    return raw, stored(preprocess.fit(raw.where(F.col("pos") < REFERENCE), PARAMS, SCALE), "states")


RAW = """e AS (SELECT vec_id, vec_id // 4 AS frame, vec_id % 4 AS q, i, embedding[i + 1]::DOUBLE AS e FROM (SELECT *, unnest(range(0, 64)) AS i FROM embeddings)),
  raw AS (SELECT frame % 3 AS session, frame // 3 AS pos, q // 2 * 8 + i // 8 AS r, q % 2 * 8 + i % 8 AS c, CASE WHEN (vec_id * 7 + i * 3) % 37 = 0 THEN 0 ELSE 1500 + floor(e * 1000)::INT END AS raw
    FROM e WHERE frame IN (SELECT vec_id // 4 FROM embeddings GROUP BY 1 HAVING count(*) = 4)),
  px AS (SELECT *, raw * 0.0001::DOUBLE AS d FROM raw)"""

NEAR, FAR = PARAMS.band
SIZE = PARAMS.out_size

FIT = f"""{RAW}, ref AS (SELECT * FROM px WHERE pos < {REFERENCE}),
  stable AS (SELECT session, r, c, r * 16 + c AS px FROM ref GROUP BY session, r, c HAVING avg((d > {NEAR!r}::DOUBLE AND d < {FAR!r}::DOUBLE)::INT) >= 0.5),
  w(session, px, r, c, root) AS (
    SELECT session, px, r, c, px FROM stable
    UNION
    SELECT s.session, s.px, s.r, s.c, w.root FROM w JOIN stable s ON s.session = w.session AND abs(s.r - w.r) <= 1 AND abs(s.c - w.c) <= 1
  ), part AS (SELECT session, px, min(root) AS root FROM w GROUP BY session, px),
  best AS (SELECT session, root, count(*) AS area FROM part GROUP BY session, root HAVING count(*) >= 32 QUALIFY row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, root) = 1),
  face AS (SELECT part.session, px // 16 AS r, px % 16 AS c FROM part JOIN best USING (session, root)),
  box AS (SELECT session, min(c) AS x0, min(r) AS y0, max(c) + 1 AS x1, max(r) + 1 AS y1 FROM face GROUP BY 1),
  sides AS (SELECT *, greatest(8, least(greatest(x1 - x0, y1 - y0), 16)) AS side FROM box),
  roi AS (SELECT session, side, greatest(0, least(round_even((x0 + x1) / 2 - side / 2, 0)::INT, 16 - side)) AS x, greatest(0, least(round_even((y0 + y1) / 2 - side / 2, 0)::INT, 16 - side)) AS y FROM sides),
  mm AS (SELECT session, median(d) * 1000 AS reference FROM ref JOIN face USING (session, r, c) WHERE d > {NEAR!r}::DOUBLE AND d < {FAR!r}::DOUBLE GROUP BY 1),
  mid AS (SELECT session, r, c, median(d * 1000) AS m, stddev_pop(d * 1000) AS s FROM ref JOIN mm USING (session) WHERE d > 0 AND abs(d * 1000 - reference) <= 12 GROUP BY session, r, c),
  cell AS (SELECT unnest(range(0, {SIZE})) AS k),
  share AS (SELECT session, k, p, (least((k + 1) * (side / {SIZE}), p + 1) - greatest(k * (side / {SIZE}), p)) / (side / {SIZE}) AS share FROM roi, cell, (SELECT unnest(range(0, 16)) AS p)
    WHERE least((k + 1) * (side / {SIZE}), p + 1) > greatest(k * (side / {SIZE}), p)),
  grid AS (SELECT roi.session, a.k AS v, b.k AS u, roi.y + a.p AS r, roi.x + b.p AS c, a.share * b.share AS share FROM roi JOIN share a ON a.session = roi.session JOIN share b ON b.session = roi.session),
  image AS (SELECT g.session, v, u, sum(share * (m - reference)) AS total, coalesce(sum(share) FILTER (m IS NOT NULL), 0) AS cover
    FROM grid g JOIN mm USING (session) LEFT JOIN mid ON mid.session = g.session AND mid.r = g.r AND mid.c = g.c GROUP BY g.session, v, u),
  reference_image AS (SELECT session, v, u, CASE WHEN cover > {PARAMS.coverage_thresh} THEN total / cover END AS mm FROM image),
  rel AS (SELECT g.session, x.pos, v, u, sum(share * (d * 1000 - reference)) FILTER (d > 0 AND abs(d * 1000 - reference) <= 12) AS total, coalesce(sum(share) FILTER (d > 0 AND abs(d * 1000 - reference) <= 12), 0) AS cover
    FROM grid g JOIN mm USING (session) JOIN px x ON x.session = g.session AND x.r = g.r AND x.c = g.c GROUP BY g.session, x.pos, v, u),
  relative AS (SELECT session, pos, v, u, CASE WHEN cover > {PARAMS.coverage_thresh} THEN total / cover END AS mm FROM rel)"""

#: A third of a step: no finite decimal stands at one, where the order of sums would tell.
THIRD = 1 / 3


def steps(x: Column | str, scale: float = 1e4) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) * scale + THIRD)


@query(f"""WITH RECURSIVE {FIT}, relief AS (SELECT session, quantile_cont(m, 0.95) - quantile_cont(m, 0.05) AS relief, median(s) AS spread FROM mid JOIN face USING (session, r, c) GROUP BY 1)
  SELECT session, x::INT AS x, y::INT AS y, side::INT AS side, floor(reference * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS reference, area::INT AS pixels, floor(relief * 100 + 0.5)::BIGINT AS relief, floor(spread * 1000 + 0.5)::BIGINT AS spread
  FROM roi JOIN mm USING (session) JOIN best USING (session) JOIN relief USING (session)""")
def fit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, states = fitted(spark, sf_dir)
    note = F.col("fit_notes")
    return states.where("problem IS NULL").select(
        "session",
        "roi.*",
        steps("reference_mm", 1e6).alias("reference"),
        note["component_pixels"].alias("pixels"),
        F.floor(note["surface_relief_mm"] * 100 + 0.5).alias("relief"),
        F.floor(note["reference_temporal_std_mm"] * 1000 + 0.5).alias("spread"),
    )


@query(f"WITH RECURSIVE {FIT} SELECT session, (v * {SIZE} + u)::INT AS cell, floor(mm * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS mm FROM reference_image")
def reference_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, states = fitted(spark, sf_dir)
    return states.select("session", F.posexplode("reference_image").alias("cell", "mm")).withColumn("mm", steps("mm"))


@query(f"WITH RECURSIVE {FIT} SELECT session, floor(count(mm) / count(*) * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS share FROM reference_image GROUP BY 1")
def reference_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, states = fitted(spark, sf_dir)
    return states.where("problem IS NULL").select("session", steps("fit_notes.reference_valid_frac").alias("share"))


@query(f"WITH RECURSIVE {FIT} SELECT session, pos, (v * {SIZE} + u)::INT AS cell, floor(mm * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS mm FROM relative")
def relative_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, states = fitted(spark, sf_dir)
    d = preprocess.transform(raw, states, PARAMS, SCALE, QUADRANT)
    return d.select("session", F.col("pos").cast("long").alias("pos"), F.posexplode("rel").alias("cell", "mm")).withColumn("mm", steps("mm"))


FACE_STATS = f"""{FIT}, fs AS (SELECT r.session, r.pos, count(r.mm) / count(*) AS valid_frac, coalesce(avg((abs(r.mm) >= 12 - 1e-3)::INT), 1) AS rail_frac, coalesce(stddev_pop(r.mm), 0) AS std_mm,
    median(r.mm) AS median_mm, count(r.mm) FILTER (i.mm IS NOT NULL) / count(i.mm) AS coverage FROM relative r JOIN reference_image i USING (session, v, u) GROUP BY r.session, r.pos)"""


@query(f"WITH RECURSIVE {FACE_STATS} SELECT session, pos, valid_frac, rail_frac, floor(std_mm * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS std_mm, floor(median_mm * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS median_mm, coverage AS face_coverage FROM fs")
def face_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, states = fitted(spark, sf_dir)
    d = preprocess.transform(raw, states, PARAMS, SCALE, QUADRANT)
    return d.select("session", F.col("pos").cast("long").alias("pos"), "valid_frac", "rail_frac", steps("std_mm").alias("std_mm"), steps("median_mm").alias("median_mm"), "face_coverage")


@query(f"""WITH RECURSIVE {FACE_STATS}, s AS (SELECT session, avg(valid_frac) AS valid, avg(rail_frac) AS rail, median(std_mm) AS std, avg(coverage) AS cover, count(*) AS n FROM fs GROUP BY 1)
  SELECT session, n AS n_frames, floor(valid * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS valid_frac, floor(cover * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS coverage,
  concat_ws(',', CASE WHEN rail > 0.02 THEN 'saturated' END, CASE WHEN std < 0.5 THEN 'flat' END, CASE WHEN cover < 0.5 THEN 'uncovered' END) AS problems FROM s""")
def session_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, states = fitted(spark, sf_dir)
    d = build.gated(build.session_rollup(preprocess.transform(raw, states, PARAMS, SCALE)))
    return d.select("session", "n_frames", steps("valid_frac", 1e6).alias("valid_frac"), steps("coverage", 1e6).alias("coverage"), F.array_join("problems", ",").alias("problems"))


def inputs(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    raw, states = fitted(spark, sf_dir)
    d = preprocess.transform(raw, states, PARAMS, SCALE, QUADRANT).select("session", "pos", "rel")
    d = d.join(F.broadcast(states.select("session", "reference_image")), "session")  # three sessions
    x = preprocess.model_input(F.col("rel"), mode, PARAMS, F.col("reference_image") if mode == "deform" else None)
    d = d.select("session", F.col("pos").cast("long").alias("pos"), x.alias("x"))
    total = F.aggregate("x.depth", F.lit(0).cast("long"), lambda s, v: s + steps(v, 1e3))
    return d.select("session", "pos", total.alias("depth"), F.aggregate("x.mask", F.lit(0.0), lambda s, v: s + v).cast("long").alias("mask"))


@query(f"""WITH RECURSIVE {FIT} SELECT r.session, r.pos, sum(CASE WHEN r.mm IS NULL OR i.mm IS NULL THEN 0 ELSE floor(greatest(-1, least(1, (r.mm - i.mm) / 6)) * 1e3 + 1 / 3.0::DOUBLE) END)::BIGINT AS depth,
  count(r.mm - i.mm) AS mask FROM relative r JOIN reference_image i USING (session, v, u) GROUP BY r.session, r.pos""")
def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs(spark, sf_dir, "deform")


@query(f"""WITH RECURSIVE {FIT} SELECT session, pos, sum(CASE WHEN mm IS NULL THEN 0 ELSE floor(greatest(-1, least(1, mm / 12)) * 1e3 + 1 / 3.0::DOUBLE) END)::BIGINT AS depth, count(mm) AS mask
  FROM relative GROUP BY session, pos""")
def absolute_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs(spark, sf_dir, "absolute")


@query(f"WITH {RAW}, s AS (SELECT session, r, c, stddev_pop(d * 1000) AS s FROM px WHERE d > 0 GROUP BY session, r, c) SELECT session, floor(median(s) * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS std FROM s GROUP BY 1")
def temporal_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw_frames(spark, sf_dir).select("session", F.transform(depth.metric(F.col("depth"), SCALE), lambda x: x * 1000).alias("image"))
    return depth.temporal_std(depth.pixels(d, "image", 16), "session").select("session", steps("std", 1e6).alias("std"))


@query(f"WITH {RAW} SELECT session, pos, floor(median(raw) FILTER (raw > 0) * 1e3 + 1 / 3.0::DOUBLE)::BIGINT AS centre FROM px WHERE r BETWEEN 4 AND 12 AND c BETWEEN 4 AND 12 GROUP BY session, pos")
def centre_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.centre_readout(raw_frames(spark, sf_dir), "depth", 16)
    return d.select("session", F.col("pos").cast("long").alias("pos"), steps("centre", 1e3).alias("centre"))


@query(f"WITH {RAW} SELECT session, pos, count(*) FILTER (d BETWEEN 0.13 AND 0.17 AND r >= 3 AND r < 12 AND c >= 2 AND c < 11) AS n, sum(raw) FILTER (d BETWEEN 0.13 AND 0.17 AND r >= 3 AND r < 12 AND c >= 2 AND c < 11)::BIGINT AS total FROM px GROUP BY session, pos")
def band_and_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = depth.metric(F.col("depth"), SCALE)
    kept = depth.in_box(depth.in_band(metric, 0.13, 0.17), 16, 2, 3, 9)
    d = raw_frames(spark, sf_dir).select("session", F.col("pos").cast("long").alias("pos"), F.filter(kept, lambda x: x.isNotNull()).alias("x"))
    raw = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + F.rint(v / SCALE).cast("long"))
    return d.select("session", "pos", F.size("x").cast("long").alias("n"), F.when(F.size("x") > 0, raw).alias("total"))


@query(f"""WITH {RAW} SELECT session, pos, (r // 3 * 6 + c // 3)::INT AS px, floor((c - 7.5) * d / 12 * 1e7 + 1 / 3.0::DOUBLE)::BIGINT AS x, floor((r - 7.5) * d / 12 * 1e7 + 1 / 3.0::DOUBLE)::BIGINT AS y, raw AS z
  FROM px WHERE r % 3 = 0 AND c % 3 = 0 AND raw > 0""")
def decimated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = depth.decimated(depth.metric(F.col("depth"), SCALE), 16, 16, 3)
    d = raw_frames(spark, sf_dir).select("session", F.col("pos").cast("long").alias("pos"), small.alias("image"))
    d = d.select("session", "pos", F.posexplode(depth.deproject(F.col("image"), 6, 12.0, 12.0, 7.5, 7.5, 1.0, 3)).alias("px", "p")).where("p IS NOT NULL")
    return d.select("session", "pos", "px", steps("p.x", 1e7).alias("x"), steps("p.y", 1e7).alias("y"), F.rint(F.col("p.z") / SCALE).cast("int").alias("z"))


@query(f"""WITH {RAW}, m AS (SELECT session, pos, r, c, d, (c - 7.5) * d / 12 AS x, (r - 7.5) * d / 12 AS y FROM px WHERE d > 0)
  SELECT session, pos, floor((max(x) - min(x)) * 1e6 + 0.3183::DOUBLE)::BIGINT AS dx, floor((max(y) - min(y)) * 1e6 + 0.3183::DOUBLE)::BIGINT AS dy, floor((max(d) - min(d)) * 1e6 + 0.3183::DOUBLE)::BIGINT AS dz,
  floor(avg(x) * 1e6 + 0.3183::DOUBLE)::BIGINT AS x, floor(avg(y) * 1e6 + 0.3183::DOUBLE)::BIGINT AS y, floor(avg(d) * 1e6 + 0.3183::DOUBLE)::BIGINT AS z FROM m GROUP BY session, pos""")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw_frames(spark, sf_dir).select(F.struct("session", "pos").alias("k"), depth.metric(F.col("depth"), SCALE).alias("image"))
    d = d.select("k", F.explode(depth.deproject(F.col("image"), 16, 12.0, 12.0, 7.5, 7.5)).alias("p")).where("p IS NOT NULL").select("k", "p.*")
    d = depth.extents(d, "k")
    return d.select("k.session", F.col("k.pos").cast("long").alias("pos"), *[F.floor(F.col(c) * 1e6 + 0.3183).alias(c) for c in ("dx", "dy", "dz", "x", "y", "z")])


@query(f"""WITH {PIXELS}, z AS (SELECT vec_id, px, d, quantile_cont(d, 0.02) OVER (PARTITION BY vec_id) AS lo, quantile_cont(d, 0.98) OVER (PARTITION BY vec_id) AS hi FROM p)
  SELECT vec_id, px::INT AS px, floor(greatest(0, least(1, (d - lo) / greatest(1e-6, hi - lo))) * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS shade FROM z""")
def depth_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images(spark, sf_dir).select("vec_id", F.posexplode("image").alias("px", "z"))
    return depth.depth_shades(d, "vec_id").select("vec_id", "px", steps("shade", 1e6).alias("shade"))


@query(f"""WITH RECURSIVE {RAW}, q AS (SELECT session, pos, r, c, r * 16 + c AS px FROM px WHERE d BETWEEN 0.15 AND 0.17),
  w(session, pos, px, r, c, root) AS (SELECT session, pos, px, r, c, px FROM q UNION
    SELECT q.session, q.pos, q.px, q.r, q.c, w.root FROM w JOIN q ON q.session = w.session AND q.pos = w.pos AND abs(q.r - w.r) <= 1 AND abs(q.c - w.c) <= 1),
  part AS (SELECT session, pos, px, min(root) AS root FROM w GROUP BY session, pos, px), n AS (SELECT session, pos, root, count(*) AS n FROM part GROUP BY ALL)
  SELECT session, pos, CASE WHEN max(n) >= 40 THEN max(n) ELSE sum(n) END::INT AS n, CASE WHEN max(n) >= 40 THEN count(*) - 1 ELSE 0 END::INT AS others FROM n GROUP BY session, pos""")
def kept_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw_frames(spark, sf_dir).select("session", F.col("pos").cast("long").alias("pos"), depth.in_band(depth.metric(F.col("depth"), SCALE), 0.15, 0.17).alias("image"))
    d = depth.keep_largest_surface(d, "image", 16, 40)
    return d.select("session", "pos", F.size(F.filter("image", lambda x: x.isNotNull())).alias("n"), "others").where("n > 0")


@query(f"""WITH {RAW}, d AS (SELECT d * 1000 AS d FROM px WHERE d * 1000 > 50 AND d * 1000 < 900), b AS (SELECT least(floor((d - 50) / (850 / 43.0::DOUBLE)), 42) AS bin, count(*) AS n FROM d GROUP BY 1),
  c AS (SELECT 50 + (bin + 0.5) * (850 / 43.0::DOUBLE) AS distance FROM b QUALIFY row_number() OVER (ORDER BY n DESC, bin) = 1)
  SELECT floor(distance * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS distance, floor(avg((abs(d - distance) <= 80)::INT) * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS share FROM d, c GROUP BY distance""")
def measured_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = export.measured_distance(raw_frames(spark, sf_dir).select(depth.metric(F.col("depth"), SCALE).alias("depth")))
    return d.select(steps("distance", 1e6).alias("distance"), steps("share", 1e6).alias("share"))


@query(f"""WITH RECURSIVE {RAW}, q AS (SELECT session, pos, r, c, r * 16 + c AS px, raw, d FROM px WHERE d BETWEEN 0.15 AND 0.17 AND session = 1 AND pos % 2 = 0),
  w(session, pos, px, r, c, root) AS (SELECT session, pos, px, r, c, px FROM q UNION
    SELECT q.session, q.pos, q.px, q.r, q.c, w.root FROM w JOIN q ON q.session = w.session AND q.pos = w.pos AND abs(q.r - w.r) <= 1 AND abs(q.c - w.c) <= 1),
  part AS (SELECT pos, px, min(root) AS root FROM w GROUP BY pos, px),
  best AS (SELECT pos, root, count(*) AS n FROM part GROUP BY pos, root QUALIFY row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, root) = 1),
  kept AS (SELECT q.* FROM q JOIN part USING (pos, px) JOIN best ON best.pos = q.pos AND (best.root = part.root OR best.n < 200))
  SELECT pos AS frame_index, count(*) AS n, floor(sum((c - 7.5) * d / 12 * 1000) * 1e4 + 0.3183::DOUBLE)::BIGINT AS x, floor(sum((r - 7.5) * d / 12 * 1000) * 1e4 + 0.3183::DOUBLE)::BIGINT AS y, sum(raw)::BIGINT AS z FROM kept GROUP BY pos""")
def point_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other frame of one session as points between 150 and 170 mm, their largest surface if it has 200 pixels."""
    raw = raw_frames(spark, sf_dir)
    name = text.frame_filename(F.col("pos"))
    label = F.concat(F.lit("session "), F.col("session").cast("string"))
    log = raw.select("session", "pos", F.col("pos").alias("frame_index"), name.alias("filename"), label.alias("label"))
    pictures = raw.select("session", name.alias("filename"), "h", "w", "depth")
    d = export.iter_points(log, pictures, 16, export.Lens(12.0, 12.0, 7.5, 7.5), SCALE, label="session 1", every=2, distance=0.16, half_mm=10.0)
    d = d.select("frame_index", F.explode("points").alias("p")).where("p IS NOT NULL").groupBy(F.col("frame_index").cast("long").alias("frame_index"))
    return d.agg(F.count("*").alias("n"), F.floor(F.sum("p.x") * 1e4 + 0.3183).alias("x"), F.floor(F.sum("p.y") * 1e4 + 0.3183).alias("y"), F.sum(F.rint(F.col("p.z") * 10).cast("long")).alias("z"))


@query(f"""WITH {PIXELS}, q AS (SELECT *, (u - 3.5) * d / 6.0 AS x, (v - 3.5) * d / 6.0 AS y, (row_number() OVER (PARTITION BY vec_id ORDER BY v, u) - 1)::INT AS id FROM p WHERE d > 0),
  t AS (
    SELECT a.vec_id, 0 AS kind, a.v, a.u, a.id i0, b.id i1, c.id i2, a.x ax, a.y ay, a.d az, b.x bx, b.y by_, b.d bz, c.x cx, c.y cy, c.d cz
    FROM q a JOIN q b ON b.vec_id = a.vec_id AND b.u = a.u + 1 AND b.v = a.v JOIN q c ON c.vec_id = a.vec_id AND c.u = a.u AND c.v = a.v + 1
    UNION ALL
    SELECT a.vec_id, 1, a.v, a.u, a.id, b.id, c.id, a.x, a.y, a.d, b.x, b.y, b.d, c.x, c.y, c.d
    FROM q a JOIN q b ON b.vec_id = a.vec_id AND b.u = a.u AND b.v = a.v + 1 JOIN q c ON c.vec_id = a.vec_id AND c.u = a.u - 1 AND c.v = a.v + 1
  ), f AS (SELECT * FROM t WHERE sqrt((ax-bx)**2 + (ay-by_)**2 + (az-bz)**2) < 0.1 AND sqrt((cx-bx)**2 + (cy-by_)**2 + (cz-bz)**2) < 0.1 AND sqrt((ax-cx)**2 + (ay-cy)**2 + (az-cz)**2) < 0.1),
  vt AS (SELECT vec_id, string_agg(printf('v %.4f %.4f %.4f', x, y, d), chr(10) ORDER BY id) AS lines FROM q GROUP BY 1),
  ft AS (SELECT vec_id, string_agg('f ' || (i0 + 1) || ' ' || (i1 + 1) || ' ' || (i2 + 1), chr(10) ORDER BY kind, v, u) AS lines FROM f GROUP BY 1)
  SELECT e.vec_id, md5(concat_ws(chr(10), vt.lines, ft.lines) || chr(10)) AS digest FROM embeddings e LEFT JOIN vt USING (vec_id) LEFT JOIN ft USING (vec_id)""")
def obj_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.obj_text(image_meshes(spark, sf_dir), normals=False).select("vec_id", F.md5("obj").alias("digest"))


@query(f"""WITH {PIXELS}, z AS (SELECT vec_id, px, u, v, CASE WHEN d > 0 THEN d * 1000 END AS z FROM p), m AS (SELECT vec_id, median(z) AS m FROM z GROUP BY 1),
  a AS (SELECT *, coalesce(z, m) AS full_z, (u - 3.5) * z / 6.0 AS x, (v - 3.5) * z / 6.0 AS y FROM z JOIN m USING (vec_id)),
  g AS (SELECT *, (coalesce(lead(full_z) OVER r, full_z) - coalesce(lag(full_z) OVER r, full_z)) / CASE WHEN u IN (0, 7) THEN 1 ELSE 2 END AS gx,
    (coalesce(lead(full_z) OVER c, full_z) - coalesce(lag(full_z) OVER c, full_z)) / CASE WHEN v IN (0, 7) THEN 1 ELSE 2 END AS gy, abs(lead(x) OVER r - x) AS dx, abs(lead(y) OVER c - y) AS dy
    FROM a WINDOW r AS (PARTITION BY vec_id, v ORDER BY u), c AS (PARTITION BY vec_id, u ORDER BY v)),
  p2 AS (SELECT vec_id, coalesce(nullif(median(dx), 0), 1) AS px_x, coalesce(nullif(median(dy), 0), 1) AS px_y FROM g GROUP BY 1),
  n AS (SELECT g.vec_id, px, z, -gx / px_x AS nx, -gy / px_y AS ny FROM g JOIN p2 USING (vec_id)),
  s AS (SELECT *, (-0.35 * nx - 0.55 * ny - 1.0) / sqrt(nx * nx + ny * ny + 1) / sqrt(0.35::DOUBLE * 0.35 + 0.55::DOUBLE * 0.55 + 1) AS lit FROM n)
  SELECT vec_id, count(z) AS n, round(avg(floor(greatest(0, least(1, 0.18::DOUBLE + 0.85::DOUBLE * greatest(0, least(1, -lit)))) * 255)) FILTER (z IS NOT NULL))::BIGINT AS shade FROM s GROUP BY 1""")
def shaded_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean brightness of each lit image, as a whole number."""
    d = depth.shaded(images(spark, sf_dir), "image", 8, 6.0, 6.0, 3.5, 3.5).select("vec_id", F.explode("shade").alias("s"))
    return d.groupBy("vec_id").agg(F.count("s").alias("n"), F.round(F.avg("s")).cast("long").alias("shade"))


@query(f"WITH {RAW}, m AS (SELECT session, median(raw) FILTER (raw > 0) / 10 AS mm FROM px GROUP BY 1) SELECT session, floor(CASE WHEN session = 1 THEN 6 ELSE greatest(5, mm * 0.05::DOUBLE) END * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS tolerance FROM m")
def spread_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw_frames(spark, sf_dir).select("session", F.explode("depth").alias("raw")).where("raw > 0").groupBy("session").agg((F.median("raw") / 10).alias("mm"))
    d = d.withColumn("mm", F.when(F.col("session") != 1, F.col("mm")))  # one session without a reference
    return d.select("session", steps(depth.spread_tolerance_mm(F.col("mm")), 1e6).alias("tolerance"))


# Clips and manifests of events.


@query(CLIPS + f"""SELECT (row_number() OVER (ORDER BY session, start) - 1)::BIGINT AS clip_id, session, start::INT AS start, 16::BIGINT AS length, label, coalesce(label_id, 0) AS label_id, trial::INT AS trial_id, split,
  round(n_label / 16.0, 3)::DOUBLE AS purity FROM (SELECT *, {EVENT_SPLIT} AS split FROM v WHERE reason IS NULL)
  LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label)::INT AS label_id FROM (SELECT DISTINCT event_type AS label FROM events)) USING (label)""")
def manifest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.manifest_clips(event_clips(spark, sf_dir), event_splits(spark, sf_dir), event_labels(spark, sf_dir))


def event_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("session") % 5
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct().withColumn("split", F.when(part == 0, "test").when(part == 1, "val").otherwise("train"))


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.label_ids(read(spark, sf_dir, "events").select(F.col("event_type").alias("label")))


@query(f"""WITH {FRAMES} SELECT session, pos AS frame_index, label, coalesce(label_id, 0) AS label_id, trial::INT AS trial_id, {EVENT_SPLIT} AS split, round(valid::DOUBLE, 4) AS valid_frac, floor(t_ms)::BIGINT AS t_ms
  FROM f LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label)::INT AS label_id FROM (SELECT DISTINCT event_type AS label FROM events)) USING (label)""")
def manifest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_frames(spark, sf_dir).withColumns({"valid_frac": F.col("valid").cast("double"), "device_timestamp_ms": F.floor("t_ms"), "host_time_unix": F.lit(None)})
    return build.manifest_frames(d, event_splits(spark, sf_dir), event_labels(spark, sf_dir)).drop("host_time_unix").withColumnRenamed("device_timestamp_ms", "t_ms")


@query(CLIPS + f""", dealt AS (SELECT *, {EVENT_SPLIT} AS split FROM v)
  SELECT 'clips' AS kind, split, label, count(*) AS n FROM dealt WHERE reason IS NULL GROUP BY GROUPING SETS ((split), (label), (split, label), ())
  UNION ALL SELECT 'rejected', NULL, reason, count(*) FROM dealt WHERE reason IS NOT NULL GROUP BY reason""")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.clip_counts(event_clips(spark, sf_dir), event_splits(spark, sf_dir))


@query(CLIPS + """, n AS (SELECT session, max(pos) + 1 AS n FROM f GROUP BY 1), x AS (SELECT v.session, v.start, n, unnest(range(0, 24)) AS step FROM v JOIN n USING (session) WHERE reason IS NULL)
  SELECT x.session, x.start::INT AS start, sum(f.pos * (step + 1))::BIGINT AS places, floor(sum(value) * 1e3 + 1 / 3.0::DOUBLE)::BIGINT AS total FROM x JOIN f ON f.session = x.session AND f.pos = least(x.start + step, n - 1) GROUP BY ALL""")
def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips read as 24 frames, so that the last ones of a session repeat its last frame."""
    f = event_frames(spark, sf_dir)
    lengths = f.groupBy("session").agg(F.count("*").alias("n_frames"))
    clips = event_clips(spark, sf_dir).where("reason IS NULL").select("session", "start", F.lit(24).alias("length"))
    d = frames.clip_frames(clips, lengths).join(f.select("session", "pos", "value"), ["session", "pos"])
    return d.groupBy("session", "start").agg(F.sum(F.col("pos") * (F.col("step") + 1)).alias("places"), steps(F.sum("value"), 1e3).alias("total"))


@query(f"""WITH {FRAMES}, n AS (SELECT session, count(*) AS n FROM f GROUP BY 1), k AS (SELECT session, n, least(5, n) AS m, unnest(range(0, least(5, n))) AS nth FROM n)
  SELECT session, nth::INT AS nth, CASE WHEN nth = m - 1 THEN CASE WHEN m > 1 THEN n - 1 ELSE 0 END ELSE floor(nth * ((n - 1) / (m - 1)::DOUBLE)) END::INT AS pos FROM k""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.even_sample(event_frames(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n_frames")), 5)


@query(f"""WITH {FRAMES}, e AS (SELECT session, pos, CASE WHEN label IN ('signup', 'purchase', 'error') THEN label END AS mark FROM f)
  SELECT session, pos, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos), 'unlabeled') AS label FROM e""")
def carried_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_frames(spark, sf_dir).select("session", F.col("pos").cast("double").alias("elapsed_s"), "pos", F.col("label").alias("value"))
    events = d.where("value IN ('signup', 'purchase', 'error')").withColumn("kind", F.lit("label"))
    return frames.carried_labels(d.select("session", "elapsed_s", "pos"), events).select("session", "pos", "label")


@query(f"""WITH {FRAMES}, s AS (SELECT *, CASE WHEN label = 'error' THEN 'failed' WHEN value > 150 THEN 'dropped' ELSE 'saved' END AS status FROM f),
  a AS (SELECT session, count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status = 'failed') AS failed,
    max(t_ms) FILTER (status = 'saved') - min(t_ms) FILTER (status = 'saved') AS span FROM s GROUP BY 1),
  l AS (SELECT session, string_agg(label || '=' || n, ',' ORDER BY label) AS labels FROM (SELECT session, label, count(*) AS n FROM s WHERE status = 'saved' GROUP BY ALL) GROUP BY 1)
  SELECT session, saved, dropped, failed, CASE WHEN span > 0 THEN round((saved - 1) / (span / 3600000), 2) ELSE 0 END AS rate, labels FROM a LEFT JOIN l USING (session)""")
def capture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of events stands for a second of frames."""
    status = F.when(F.col("label") == "error", "failed").when(F.col("value") > 150, "dropped").otherwise("saved")
    d = frames.capture_counts(event_frames(spark, sf_dir).withColumn("status", status).withColumn("t_ms", F.col("t_ms") / 3600))
    labels = F.array_join(F.transform(F.map_entries("label_frames"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return d.select("session", "saved", "dropped", "failed", F.col("effective_fps").alias("rate"), labels.alias("labels"))


@query("""WITH b AS (SELECT l_orderkey % 50 AS epoch, count(*) AS n, avg(l_discount) AS loss FROM lineitem GROUP BY l_orderkey % 50, l_linenumber)
  SELECT epoch, floor(sum(loss * n) / sum(n) * 1e6 + 0.3183::DOUBLE)::BIGINT AS loss FROM b GROUP BY 1""")
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.operators.metrics import mean_loss as mean

    d = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("epoch"), "l_linenumber").agg(F.count("*").alias("n"), F.avg("l_discount").alias("loss"))
    return mean(d, "epoch").select("epoch", F.floor(F.col("loss") * 1e6 + 0.3183).alias("loss"))


# Texts.


@query("""SELECT event_id, printf('depth/depth_%06d.png', event_id::INT) AS filename, 's' || user_id || '_' || CASE WHEN event_type = 'view' THEN '' ELSE event_type || '_' END || printf('frame%06d', event_id::INT) || '_mesh.ply' AS export,
  strftime(make_timestamp(floor(epoch_us(ts) / 1000)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS iso FROM events""")
def names_and_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") != "view", F.col("event_type"))
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    index = F.col("event_id").cast("int")
    unix = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return read(spark, sf_dir, "events").select(
        "event_id", text.frame_filename(index).alias("filename"), text.export_name(session, label, text.frame_tag(index), True, "ply").alias("export"), text.iso_ms(unix).alias("iso")
    )


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || ',' || event_id || ', 64' WHEN 1 THEN user_id || ':' || event_id WHEN 2 THEN user_id || ',x,3' ELSE props END AS given FROM events)
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN split_part(given, ',', 1)::INT END AS x, CASE WHEN event_id % 4 = 0 THEN split_part(given, ',', 2)::INT END AS y, CASE WHEN event_id % 4 = 0 THEN 64 END AS side,
  CASE WHEN event_id % 4 = 1 THEN split_part(given, ':', 2)::INT END AS "end" FROM t""")
def parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.col("event_id") % 4
    given = F.when(kind == 0, F.concat(user, F.lit(","), event, F.lit(", 64"))).when(kind == 1, F.concat(user, F.lit(":"), event)).when(kind == 2, F.concat(user, F.lit(",x,3"))).otherwise(F.col("props"))
    d = read(spark, sf_dir, "events").select("event_id", given.alias("given"))
    return d.select("event_id", text.parse_roi(F.col("given")).alias("roi"), text.parse_range(F.col("given")).alias("span")).select("event_id", "roi.*", F.col("span.end").alias("end"))


# The jobs.


#: The clips of the build over all frames.
BUILT = f"""WITH RECURSIVE {FACE_STATS}, sess AS (SELECT session, avg(rail_frac) AS rail, median(std_mm) AS std, avg(coverage) AS cover, count(*) AS n FROM fs GROUP BY 1),
  good AS (SELECT session, n, row_number() OVER (ORDER BY session) AS k FROM sess WHERE rail <= 0.02 AND std >= 0.5 AND cover >= 0.5),
  fr AS (SELECT session, pos, CASE pos // 20 % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'smile' ELSE 'blink' END AS label, pos // 20 AS trial, round(valid_frac, 4) AS valid FROM fs JOIN good USING (session)),
  ids AS (SELECT label, row_number() OVER (ORDER BY label)::INT AS label_id FROM (SELECT DISTINCT label FROM fr)),
  st AS (SELECT session, k, unnest(generate_series(0, n - 16, 4)) AS start FROM good WHERE n >= 16),
  wd AS (SELECT st.session, st.k, st.start, count(DISTINCT trial) AS trials, avg(valid) AS valid, min(trial) AS trial FROM st JOIN fr ON fr.session = st.session AND fr.pos BETWEEN st.start AND st.start + 15 GROUP BY ALL),
  ml AS (SELECT st.session, st.start, label, count(*) AS n_label FROM st JOIN fr ON fr.session = st.session AND fr.pos BETWEEN st.start AND st.start + 15 GROUP BY st.session, st.start, label
    QUALIFY row_number() OVER (PARTITION BY st.session, st.start ORDER BY count(*) DESC, min(pos)) = 1),
  clips AS (SELECT (row_number() OVER (ORDER BY session, start) - 1)::BIGINT AS clip_id, 's' || session AS session, start::INT AS start, 16::BIGINT AS length, label, label_id, trial::INT AS trial_id,
  CASE k WHEN 2 THEN 'test' ELSE 'train' END AS split, round(n_label / 16, 3) AS purity FROM wd JOIN ml USING (session, start) JOIN ids USING (label) WHERE trials = 1 AND valid >= 0.1 AND n_label / 16 >= 0.9)"""


@query(f"{BUILT} SELECT * FROM clips")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over the frames of all three sessions: the clips' manifest."""
    return built_dataset(spark, sf_dir)["clips"]


def built_dataset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = raw_frames(spark, sf_dir)
    name = F.concat(F.lit("s"), F.col("session").cast("string"))
    label = F.element_at(F.array(*map(F.lit, ("neutral", "smile", "blink"))), (F.floor(F.col("pos") / 20) % 3 + 1).cast("int"))
    log = raw.select(
        name.alias("session"),
        "pos",
        F.col("pos").alias("frame_index"),
        text.frame_filename(F.col("pos")).alias("filename"),
        label.alias("label"),
        F.floor(F.col("pos") / 20).cast("int").alias("trial"),
        (F.col("pos") * 33.3).cast("string").alias("device_timestamp_ms"),
        F.lit("").alias("host_time_unix"),
    )
    pictures = raw.select(name.alias("session"), text.frame_filename(F.col("pos")).alias("filename"), "h", "w", "depth")
    meta = log.select("session").distinct().withColumns({"fps": F.lit(30.0), "depth_scale": F.lit(SCALE)})
    return build.build(log, pictures, meta, PARAMS, build.Options(min_clip_valid=0.1))


@query(f"""WITH RECURSIVE {FIT},
  pts AS (SELECT x.session, x.pos, x.r, x.c, (x.c - 7.5) * d / 12 * 1000 AS x, (x.r - 7.5) * d / 12 * 1000 AS y, d * 1000 AS z FROM px x LEFT JOIN mm USING (session) LEFT JOIN roi ON roi.session = x.session
    WHERE x.pos % 7 = 0 AND d BETWEEN coalesce(reference / 1000, {PARAMS.expected_distance_m}) - 0.008 AND coalesce(reference / 1000, {PARAMS.expected_distance_m}) + 0.008
      AND (side IS NULL OR x.r >= roi.y AND x.r < roi.y + side AND x.c >= roi.x AND x.c < roi.x + side)),
  near AS (SELECT a.session, a.pos, a.r, a.c, b.r - a.r AS dr, b.c - a.c AS dc FROM pts a JOIN pts b ON a.session = b.session AND a.pos = b.pos AND b.r - a.r BETWEEN 0 AND 1 AND b.c - a.c BETWEEN -1 AND 1
    WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 20),
  tri AS (SELECT h.session, h.pos, count(*) AS faces FROM near h JOIN near s ON s.session = h.session AND s.pos = h.pos AND h.dr = 0 AND h.dc = 1 AND s.dr = 1 AND s.dc = -1 AND s.r = h.r AND s.c = h.c + 1
      JOIN near v ON v.session = h.session AND v.pos = h.pos AND v.dr = 1 AND v.dc = 0 AND v.r = h.r AND v.c = h.c GROUP BY ALL
    UNION ALL SELECT v.session, v.pos, count(*) FROM near v JOIN near s ON s.session = v.session AND s.pos = v.pos AND v.dr = 1 AND v.dc = 0 AND s.dr = 1 AND s.dc = -1 AND s.r = v.r AND s.c = v.c
      JOIN near h ON h.session = v.session AND h.pos = v.pos AND h.dr = 0 AND h.dc = 1 AND h.r = v.r + 1 AND h.c = v.c - 1 GROUP BY ALL),
  f AS (SELECT session, pos, sum(faces)::BIGINT AS faces FROM tri GROUP BY ALL)
  SELECT 's' || session AS session, printf('s%d_3d/frame_%06d.ply', session, pos) AS name, count(*) AS vertices, coalesce(any_value(faces), 0) AS faces,
    sum(floor(z * 1000 + 0.5))::BIGINT AS z, sum(floor(x * 1000 + 1 / 3.0::DOUBLE))::BIGINT AS x FROM pts LEFT JOIN f USING (session, pos) GROUP BY session, pos""")
def session_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of all sessions as sequences, each around its own face, or at the expected distance without one: names, vertices and faces of each file."""
    raw = raw_frames(spark, sf_dir).withColumn("session", F.concat(F.lit("s"), F.col("session").cast("string")))
    raw = raw.withColumn("filename", text.frame_filename(F.col("pos")))
    label = F.when(F.col("pos") < REFERENCE, "neutral").otherwise("smile")
    log = raw.select("session", "pos", "filename", F.col("pos").alias("frame_index"), label.alias("label"), F.lit(0).alias("trial"))
    meta = raw.select("session").distinct().withColumn("depth_scale", F.lit(SCALE))
    how = export.How(sequence=True, every=7, expected_distance_m=PARAMS.expected_distance_m, face_depth_mm=8.0, keep_all=True, max_edge_mm=20.0, lens=export.Lens(12.0, 12.0, 7.5, 7.5))
    d = export.export_sessions(log, raw.select("session", "filename", "h", "w", "depth"), meta, PARAMS, how).where(F.size("vertices") > 0)
    total = lambda c, up: F.aggregate(f"vertices.{c}", F.lit(0).cast("long"), lambda s, v: s + F.floor(v * 1000 + up))
    return d.select("session", "name", F.size("vertices").cast("long").alias("vertices"), F.size("faces").cast("long").alias("faces"), total("z", 0.5).alias("z"), total("x", THIRD).alias("x"))


@query(f"""{BUILT} SELECT clip_id, step::INT AS step, (v * {SIZE} + u)::INT AS cell, (mm IS NOT NULL)::INT AS mask,
    floor((CASE WHEN mm IS NULL THEN 0 ELSE greatest(-1, least(1, mm::FLOAT::DOUBLE / {PARAMS.clip_mm})) END)::FLOAT::DOUBLE * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS depth
  FROM (SELECT clip_id, session[2:]::INT AS session, start, unnest(range(0, 16)) AS step FROM clips WHERE split = 'train') c JOIN relative r ON r.session = c.session AND r.pos = start + step""")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of every training clip of the build, as a model takes it."""
    samples = build.dataset_clips(built_dataset(spark, sf_dir), PARAMS, "train").select("clip_id", F.posexplode("steps").alias("step", "x"))
    pixels = samples.select("clip_id", "step", F.posexplode(F.arrays_zip("x.depth", "x.mask")).alias("cell", "p"))
    return pixels.select("clip_id", "step", "cell", F.col("p.mask").cast("int").alias("mask"), steps(F.col("p.depth").cast("double")).alias("depth"))


@query(f"""{BUILT}, x AS (SELECT clip_id, step, (v >= 2)::INT * 2 + (u >= 2)::INT AS block, (mm IS NOT NULL)::INT AS mask,
    (CASE WHEN mm IS NULL THEN 0 ELSE greatest(-1, least(1, mm::FLOAT::DOUBLE / {PARAMS.clip_mm})) END)::FLOAT::DOUBLE AS depth
  FROM (SELECT clip_id, session[2:]::INT AS session, start, unnest(range(0, 16)) AS step FROM clips) c JOIN relative r ON r.session = c.session AND r.pos = start + step)
  SELECT clip_id, block::INT AS block, floor(avg(depth) * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS depth, floor((avg(depth) FILTER (step >= 8) - avg(depth) FILTER (step < 8)) * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS change,
    floor(avg(mask) * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS mask FROM x GROUP BY clip_id, block""")
def clip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a linear classifier reads of every clip of the build: depth, its change and validity by blocks."""
    samples = build.dataset_clips(built_dataset(spark, sf_dir), PARAMS, None)
    f = training.clip_features(samples, SIZE, 2).select("clip_id", *[F.slice("features", k * 4 + 1, 4).alias(c) for k, c in enumerate(("depth", "change", "mask"))])
    d = f.select("clip_id", F.posexplode(F.arrays_zip("depth", "change", "mask")).alias("block", "x"))
    return d.select("clip_id", "block", *[steps(f"x.{c}").alias(c) for c in ("depth", "change", "mask")])


#: A number of a small network, by its place.
def parameter(k: str) -> str:
    return f"((({k}) * 37) % 19 - 9) / 30::DOUBLE"


def layer(name: str, before: str, first: int) -> str:
    """A convolution of 2 channels, normalised by a mean of 0 and a variance of 1, and rectified; its numbers start at first."""
    return f"""{name} AS (SELECT clip_id, o AS ch, t, v, u, greatest(0, total / sqrt(1 + 1e-5::DOUBLE) * {parameter(f"{first + 108} + o")} + {parameter(f"{first + 110} + o")}) AS x FROM (
    SELECT clip_id, o, t - a + 1 AS t, v - b + 1 AS v, u - e + 1 AS u, sum(x * {parameter(f"{first} + o * 54 + c * 27 + a * 9 + b * 3 + e")}) AS total FROM {before} JOIN tap ON c = ch
    WHERE t - a + 1 BETWEEN 0 AND 15 AND v - b + 1 BETWEEN 0 AND {SIZE - 1} AND u - e + 1 BETWEEN 0 AND {SIZE - 1} GROUP BY clip_id, o, t - a, v - b, u - e, t - a + 1, v - b + 1, u - e + 1))"""


@query(f"""{BUILT}, made AS (SELECT clip_id, step::INT AS t, v, u, mm FROM (SELECT clip_id, session[2:]::INT AS session, start, unnest(range(0, 16)) AS step FROM clips) c JOIN relative r ON r.session = c.session AND r.pos = start + step),
  x0 AS (SELECT clip_id, 0 AS ch, t, v, u, (CASE WHEN mm IS NULL THEN 0 ELSE greatest(-1, least(1, mm::FLOAT::DOUBLE / {PARAMS.clip_mm})) END)::FLOAT::DOUBLE AS x FROM made
    UNION ALL SELECT clip_id, 1, t, v, u, (mm IS NOT NULL)::INT FROM made),
  tap AS (SELECT o, c, a, b, e FROM range(0, 2) o(o), range(0, 2) c(c), range(0, 3) a(a), range(0, 3) b(b), range(0, 3) e(e)),
  {layer("x1", "x0", 0)}, {layer("x2", "x1", 112)},
  top AS (SELECT clip_id, ch, max(x) AS x FROM x2 WHERE v < {SIZE // 2 * 2} AND u < {SIZE // 2 * 2} GROUP BY clip_id, ch, t // 2, v // 2, u // 2),
  m AS (SELECT clip_id, ch, avg(x) AS x FROM top GROUP BY ALL)
  SELECT clip_id, k::INT AS class, floor((sum(x * {parameter("224 + k * 2 + ch")}) + {parameter("230 + k")}) * 1e4 + 1 / 3.0::DOUBLE)::BIGINT AS logit FROM m, range(0, 3) k(k) GROUP BY clip_id, k""")
def clip_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a small convolutional network with stated numbers says of every clip of the build."""
    samples = build.dataset_clips(built_dataset(spark, sf_dir), PARAMS, None)
    net = network.Network(3, 2, ((2, 2, 2),))
    theta = [((k * 37) % 19 - 9) / 30 for k in range(net.n_parameters)]
    model = (preprocess.VERSION, ["0", "1", "2"], "absolute", 16, SIZE, net.width, [list(p) for p in net.pools], 0, "", theta, net.plain_moments().tolist())
    d = network.predict(samples, spark.createDataFrame([model], network.MODEL).first())
    return d.select("clip_id", F.posexplode("logits").alias("class", "z")).select("clip_id", "class", steps("z").alias("logit"))


@query(f"""WITH m AS ({MESH}), f AS (SELECT vec_id, count(*) AS faces, sum(i0 + 2 * i1 + 3 * i2)::BIGINT AS corners FROM m GROUP BY 1), {PIXELS},
  v AS (SELECT vec_id, count(*) AS vertices, sum(floor(d::FLOAT::DOUBLE * 1e4 + 1 / 3.0::DOUBLE))::BIGINT AS z, sum(floor(((u - 3.5) * d / 6.0)::FLOAT::DOUBLE * 1e4 + 1 / 3.0::DOUBLE))::BIGINT AS x FROM p WHERE d > 0 GROUP BY 1)
  SELECT vec_id, coalesce(vertices, 0) AS vertices, coalesce(z, 0) AS z, coalesce(x, 0) AS x, coalesce(faces, 0) AS faces, coalesce(corners, 0) AS corners FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN v USING (vec_id) LEFT JOIN f USING (vec_id)""")
def ply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meshes of all embeddings, written as PLY files and read back by the data source."""
    ply.register(spark)
    folder = shared_path(spark, "ply")
    named = image_meshes(spark, sf_dir).withColumn("name", F.format_string("%d/%d.ply", F.pmod("vec_id", F.lit(16)), F.col("vec_id")))
    named.select("name", "vertices", "faces").write.format("ply").mode("append").save(folder)
    d = spark.read.format("ply").load(folder).withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.ply$", 1).cast("long"))
    total = lambda c: F.aggregate(f"vertices.{c}", F.lit(0).cast("long"), lambda s, v: s + steps(v))
    corners = F.aggregate("faces", F.lit(0).cast("long"), lambda s, f: s + f["i0"] + 2 * f["i1"] + 3 * f["i2"])
    return d.select("vec_id", F.size("vertices").cast("long").alias("vertices"), total("z").alias("z"), total("x").alias("x"), F.size("faces").cast("long").alias("faces"), corners.alias("corners"))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(vec_id, embedding, split, y) of all labelled embeddings, a tenth of them for each of val and test, and the labels."""
    d = read(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    part = F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(10))
    split = F.when(part == 0, "test").when(part == 1, "val").otherwise("train").alias("split")
    labels = [str(r.label) for r in d.select("label").distinct().orderBy("label").collect()]  # a vocabulary
    y = F.array_position(F.array(*map(F.lit, labels)), F.col("label").cast("string")).cast("int") - 1
    return d.select("vec_id", "embedding", split, y.alias("y")), labels


@query()
def trained_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of a classifier of all labelled embeddings. Tested against a plain fit."""
    d, labels = labelled(spark, sf_dir)
    trained = training.train(d.select("split", "y", F.col("embedding").alias("features")), labels, training.Options(epochs=12))
    return trained["history"].select("epoch", "split", "n", *[steps(c, 1e6).alias(c) for c in ("loss", "acc", "macro_f1")])


@query()
def trained_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of a convolutional network of all labelled embeddings, each a clip of four 4 x 4 steps. Tested against differences of its loss, and by what it learns."""
    d, labels = labelled(spark, sf_dir)
    step = lambda k: F.struct(F.slice("embedding", k * 16 + 1, 16).cast("array<float>").alias("depth"), F.array_repeat(F.lit(1.0).cast("float"), 16).alias("mask"))
    samples = d.select("split", "y", F.col("vec_id").alias("clip_id"), F.array(*map(step, range(4))).alias("steps"))
    trained = network.train(samples, 4, labels, training.Options(epochs=4, rate=0.05), width=4, pools=((2, 2, 2),), clip_len=4)
    return trained["history"].select("epoch", "split", "n", *[steps(c, 1e6).alias(c) for c in ("loss", "acc", "macro_f1")])


@query()
def live_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live predictions over all embeddings as a stream of 8 x 8 frames of one label each; the model is the mean of depth and of validity. Tested against the batch operators."""
    path = f"{sf_dir}/embeddings.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path[:-1] + "[t]")
    raw = F.transform("embedding", lambda e: (1500 + F.floor(e.cast("double") * 1000)).cast("int"))
    stream = stream.select(F.col("label").cast("string").alias("session"), F.timestamp_seconds("vec_id").alias("ts"), F.col("vec_id").alias("nth"), F.lit(8).alias("h"), F.lit(8).alias("w"), raw.alias("depth"), F.lit(None).cast("string").alias("control"))
    params = Params(out_size=4, expected_distance_m=0.15, search_band_m=0.05, clip_mm=30.0, min_relief_mm=0.5)
    d = live.live_readout(stream, mean_model, ["near", "far"], params, SCALE, "deform", length=4, every=2, warm_frames=8)
    return live.run_available(d, shared_path(spark, "readout")).where("problem IS NULL").select("session", "ts", "top_label", steps("confidence", 1e6).alias("confidence"))


def mean_model(x):
    """Two numbers of a clip, for queries and tests."""
    return x[0].mean() * 10, x[1].mean()
