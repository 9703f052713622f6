"""The registered queries over the given tables, each with its SQL where SQL can say it.

Events stand for frames (a user is a session, the event type a label), embeddings
of 64 numbers for 8 x 8 depth images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.text import frame_times_ms
from fathom.operators import build, depth, export, frames, metrics, splits
from fathom.operators.preprocess import Params
from fathom.operators.tables import shared_path
from fathom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

GAP_MS = 72 * 3_600_000.0

FRAMES = """frames AS (
  SELECT user_id AS session, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos,
         coalesce(nullif(event_type, ''), 'unlabeled') AS label, epoch_us(ts) / 1000.0::DOUBLE AS t_ms, value, (value < 60)::INT AS valid FROM events
), f AS (SELECT *, pos // 40 AS trial FROM frames)"""

RUNS = f"""WITH {FRAMES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) - row_number() OVER (PARTITION BY session, label ORDER BY pos) AS island FROM f
), runs AS (SELECT session, label, min(pos) AS start, count(*) AS length FROM r GROUP BY session, label, island
), longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY session, label ORDER BY length DESC, start) = 1)"""

CLIPS = f"""WITH {FRAMES}, s AS (
  SELECT session, unnest(generate_series(0, max(pos) - 15, 4)) AS start FROM f GROUP BY session HAVING max(pos) >= 15
), w AS (
  SELECT s.session, s.start, f.*, t_ms - lag(t_ms) OVER (PARTITION BY s.session, s.start ORDER BY f.pos) AS step
  FROM s JOIN f ON f.session = s.session AND f.pos BETWEEN s.start AND s.start + 15
), m AS (
  SELECT session, start, label, count(*) AS n_label FROM w GROUP BY session, start, label
  QUALIFY row_number() OVER (PARTITION BY session, start ORDER BY count(*) DESC, min(pos)) = 1
), c AS (
  SELECT session, start, count(DISTINCT trial) > 1 AS straddles, max(step) AS gap_ms, avg(valid) AS mean_valid, min(trial) AS trial FROM w GROUP BY session, start
), v AS (
  SELECT c.*, m.label, m.n_label, CASE WHEN straddles THEN 'straddles_trial' WHEN gap_ms > {GAP_MS} THEN 'time_gap' WHEN mean_valid < 0.4 THEN 'low_valid_depth'
    WHEN n_label / 16.0 < 0.25 THEN 'impure_label' WHEN label = 'unlabeled' THEN 'unlabeled' END AS reason
  FROM c JOIN m USING (session, start)
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.positions(read(spark, sf_dir, "events")).withColumn("valid", (F.col("value") < 60).cast("int"))


def event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.clip_verdicts(frames.clip_candidates(event_frames(spark, sf_dir)), GAP_MS, min_purity=0.25)


@query(CLIPS + " SELECT session, start::INT AS start, label, n_label::BIGINT AS n_label, trial::INT AS trial FROM v WHERE reason IS NULL")
def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_clips(spark, sf_dir).where("reason IS NULL").select("session", "start", "label", "n_label", "trial")


@query(CLIPS + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM v GROUP BY 1")
def clip_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_clips(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(CLIPS + " SELECT session, start::INT AS start, floor(gap_ms)::BIGINT AS gap_ms FROM v WHERE gap_ms > 72 * 3600000")
def time_gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_clips(spark, sf_dir).where(F.col("gap_ms") > GAP_MS).select("session", "start", F.floor("gap_ms").alias("gap_ms"))


@query(RUNS + " SELECT session, label, start::INT AS start, length FROM longest")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.longest_run(event_frames(spark, sf_dir))


@query(RUNS + """ SELECT f.session, f.pos, false AS fallback FROM f JOIN longest l ON f.session = l.session AND l.label = 'view'
  WHERE l.length >= 3 AND f.pos >= l.start AND f.pos < l.start + least(l.length, 4)""")
def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.reference_rows(event_frames(spark, sf_dir), "view", seconds=0.125, fps=32, least=3)


@query(RUNS + """, l AS (SELECT * FROM longest WHERE label = 'view' AND length >= 3)
  SELECT f.session, f.pos, l.start IS NULL AS fallback FROM f LEFT JOIN l USING (session)
  WHERE f.pos >= coalesce(l.start, 0) AND f.pos < coalesce(l.start, 0) + least(coalesce(l.length, 4), 4)""")
def reference_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.reference_rows(event_frames(spark, sf_dir), "view", seconds=0.125, fps=32, least=3, fallback=True)


def split_sql(val: float, test: float, pinned: str = "false") -> str:
    """The fold over new names; those that are pinned are in val."""
    return f"""WITH RECURSIVE old AS (SELECT DISTINCT user_id::VARCHAR AS session FROM events WHERE {pinned}),
  names AS (SELECT session, row_number() OVER (ORDER BY session) AS k FROM (SELECT DISTINCT user_id::VARCHAR AS session FROM events WHERE NOT ({pinned}))),
  fold(k, session, split, n_test, n_val, n_train) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::DOUBLE, (SELECT count(*) FROM old)::DOUBLE, 0::DOUBLE
    UNION ALL
    SELECT k, session, split, n_test + (split = 'test')::INT, n_val + (split = 'val')::INT, n_train + (split = 'train')::INT FROM (
      SELECT n.k, n.session, f.n_test, f.n_val, f.n_train, f.n_test + f.n_val + f.n_train + 1 AS total, CASE
        WHEN {test} > 0 AND {test}::DOUBLE - f.n_test / total >= CASE WHEN {val} > 0 THEN {val}::DOUBLE - f.n_val / total ELSE -1e9 END
          AND {test}::DOUBLE - f.n_test / total >= (1 - {test}::DOUBLE - {val}::DOUBLE) - f.n_train / total THEN 'test'
        WHEN {val} > 0 AND {val}::DOUBLE - f.n_val / total >= (1 - {test}::DOUBLE - {val}::DOUBLE) - f.n_train / total THEN 'val' ELSE 'train' END AS split
      FROM fold f JOIN names n ON n.k = f.k + 1)),
  every_one AS (SELECT session, split FROM fold WHERE k > 0 UNION ALL SELECT session, 'val' FROM old)
  SELECT session, split FROM every_one"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"))


@query(split_sql(0.2, 0.2))
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(event_sessions(spark, sf_dir))


@query(split_sql(0.0, 0.2))
def split_zero_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(event_sessions(spark, sf_dir), val=0.0)


@query(split_sql(0.2, 0.2, "user_id % 3 = 0"))
def split_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = event_sessions(spark, sf_dir)
    pins = names.where(F.col("session").cast("long") % 3 == 0).distinct().withColumn("split", F.lit("val"))
    return splits.assign_splits(names, previous=pins)


@query("SELECT 'unlabeled' AS label, 0 AS label_id UNION ALL SELECT label, row_number() OVER (ORDER BY label)::INT FROM (SELECT DISTINCT event_type AS label FROM events)")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.label_ids(read(spark, sf_dir, "events").select(F.col("event_type").alias("label")))


@query("SELECT user_id % 3 AS part, event_type AS label, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id % 3), (event_type), (user_id % 3, event_type), ())")
def counts_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("part"), F.col("event_type").alias("label"))
    return d.cube("part", "label").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT label, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type AS label FROM events UNION ALL SELECT 'absent') LEFT JOIN
  (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1) USING (label))
  SELECT label, n, CASE WHEN n > 0 THEN (sum(n) OVER ())::DOUBLE / ((sum((n > 0)::INT) OVER ()) * n) ELSE 0 END AS weight FROM c""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").select(F.col("event_type").alias("label"))
    return metrics.class_weights(d, d.distinct().union(spark.createDataFrame([("absent",)], "label string")))


JUDGED = "j AS (SELECT quality AS truth, (n_chars > 1500)::INT AS guess FROM labels JOIN documents USING (doc_id))"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("guess"))
    return read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")).join(docs, "doc_id")


@query(f"WITH {JUDGED} SELECT truth, guess, count(*) AS n FROM j GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(judged(spark, sf_dir))


PRF = f"""WITH {JUDGED}, c AS (SELECT truth AS class, count(*) AS actual, sum((truth = guess)::INT) AS hit FROM j GROUP BY 1),
  p AS (SELECT class, actual, hit, coalesce(called, 0) AS called FROM c LEFT JOIN (SELECT guess AS class, count(*) AS called FROM j GROUP BY 1) USING (class)),
  s AS (SELECT class, CASE WHEN called > 0 THEN hit / called ELSE 0 END::DOUBLE AS precision, (hit / actual)::DOUBLE AS recall FROM p),
  t AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)"""


@query(PRF + " SELECT class, precision, recall, f1 FROM t")
def per_class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(metrics.confusion(judged(spark, sf_dir)))


@query(PRF + " SELECT floor(avg(f1) * 1e9)::BIGINT AS macro_f1, (SELECT floor(avg((truth = guess)::INT) * 1e9)::BIGINT FROM j) AS accuracy FROM t")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.confusion(judged(spark, sf_dir))
    hits = counts.agg((F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"))
    f1 = metrics.per_class(counts).agg(F.avg("f1").alias("f"))
    return f1.crossJoin(hits).select(F.floor(F.col("f") * 1e9).alias("macro_f1"), F.floor(F.col("a") * 1e9).alias("accuracy"))


@query("SELECT event_type AS label, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM events WHERE value > 2 AND value < 300 GROUP BY 1")
def observed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").where("value > 2 AND value < 300").groupBy(F.col("event_type").alias("label"))
    return d.agg(F.percentile("value", F.lit(0.05)).alias("p5"), F.percentile("value", F.lit(0.95)).alias("p95"))


@query("""WITH d AS (SELECT value AS d FROM events WHERE value > 5 AND value < 435), b AS (SELECT least(floor((d - 5.0) / 10.0), 42) AS bin, count(*) AS n FROM d GROUP BY 1),
  c AS (SELECT 5 + (bin + 0.5) * 10.0 AS distance FROM b QUALIFY row_number() OVER (ORDER BY n DESC, bin) = 1)
  SELECT distance, floor(avg((abs(d - distance) <= 20)::INT) * 1e9)::BIGINT AS share FROM d, c GROUP BY 1""")
def suggest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").select(F.col("value").alias("d"))
    return depth.distance_histogram(d, 5.0, 435.0, 43, 500, 20.0).select("distance", F.floor(F.col("share") * 1e9).alias("share"))


@query(f"WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS k FROM f WHERE label = 'click') SELECT session, pos FROM n WHERE (k - 1) % 5 = 0")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.every_nth(event_frames(spark, sf_dir).where("label = 'click'"), 5).select("session", "pos")


@query(f"WITH {FRAMES} SELECT session, pos FROM f WHERE label = 'click' AND trial = 1 AND pos >= 42 AND pos < 60")
def select_rows_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_frames(spark, sf_dir).withColumn("frame_index", F.col("pos"))
    return frames.select_rows(d, label="click", trial=1, span=(42, 60)).select("session", "pos")


@query(f"""WITH {FRAMES}, r AS (SELECT session, pos, count(*) OVER w AS n, t_ms - first_value(t_ms) OVER w AS span FROM f WINDOW w AS (PARTITION BY session ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  SELECT session, pos, CASE WHEN span > 0 THEN floor((n - 1) / (span / 1000) * 1e12)::BIGINT ELSE 0 END AS rate FROM r""")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.rolling_rate(event_frames(spark, sf_dir), 30).select("session", "pos", F.floor(F.col("rate") * 1e12).alias("rate"))


@query(f"""WITH {FRAMES}, n AS (SELECT session, pos, sum((label = 'signup')::INT) OVER (PARTITION BY session % 3 ORDER BY session, pos) AS k FROM f)
  SELECT session, pos, CASE WHEN k % 2 = 1 THEN (k + 1) // 2 ELSE 0 END::BIGINT AS trial_id FROM n""")
def trial_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_frames(spark, sf_dir).select("session", "pos", "label", (F.col("session") % 3).alias("device"))
    return frames.trial_numbers(d, F.col("label") == "signup", ("session", "pos"), by="device").select("session", "pos", "trial_id")


@query(f"""WITH {FRAMES}, l AS (SELECT session, list(value ORDER BY pos) AS v FROM f GROUP BY 1)
  SELECT session, floor(list_reduce(v, lambda s, p: 0.6::DOUBLE * s + (1 - 0.6::DOUBLE) * p) * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS ema FROM l""")
def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    # With a third added, no value of finite decimals stands at a step of floor.
    return frames.ema_last(event_frames(spark, sf_dir), "value").select("session", F.floor(F.col("ema") * 1e6 + 1 / 3).alias("ema"))


@query(f"""WITH {FRAMES}, n AS (SELECT session, count(*) AS n, string_agg(label || trial, ',' ORDER BY pos) AS labels FROM f GROUP BY 1),
  o AS (SELECT session, count(*) AS n, string_agg(CASE WHEN session % 4 = 1 AND pos = 3 THEN 'other' ELSE label END || trial, ',' ORDER BY pos) AS labels FROM f
    WHERE session % 4 <> 3 AND (session % 4 <> 2 OR pos < 50) GROUP BY 1)
  SELECT n.session, CASE WHEN o.n = n.n AND o.labels = n.labels THEN 'reuse' WHEN o.n = n.n THEN 'relabel' ELSE 'build' END AS action FROM n LEFT JOIN o USING (session)""")
def cache_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = event_frames(spark, sf_dir)
    part = F.col("session") % 4
    old = new.where((part != 3) & ((part != 2) | (F.col("pos") < 50)))
    old = old.withColumn("label", F.when((part == 1) & (F.col("pos") == 3), "other").otherwise(F.col("label")))
    meta = new.select("session", F.lit(0.0001).alias("depth_scale")).distinct()
    keys, cached = (build.cache_keys(d, meta, Params(), build.Options()) for d in (new, old))
    return build.cache_actions(keys, cached).select("session", "action")


def event_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's value stands for its frame's median."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("label"), F.col("value").alias("median_mm"))


@query("""WITH m AS (SELECT user_id AS session, event_type AS label, round(avg(value), 3) AS dc FROM events GROUP BY ALL)
  SELECT session, CASE WHEN count(*) > 1 THEN round(max(dc) - min(dc), 3) ELSE 0 END AS spread FROM m GROUP BY 1""")
def dc_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.dc_spread(build.label_dc(event_medians(spark, sf_dir)))


# Embeddings as 8 x 8 depth images.

PIXELS = """p AS (SELECT vec_id, label, px - 1 AS px, (px - 1) % 8 AS u, (px - 1) // 8 AS v, embedding[px]::DOUBLE AS d
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS px FROM embeddings))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("image"))


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.pixels(images(spark, sf_dir), "image", 8)


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per image (a label is a session, a tenth of a unit a mm): what lies within 3.5 mm of -0.5 mm, and its share of the label's even pixels."""
    rel = F.transform("image", lambda x: F.when(F.abs(x * 10 + 0.5) <= 3.5, x * 10 + 0.5))
    d = images(spark, sf_dir).select("vec_id", F.col("label").alias("session"), rel.alias("image"))
    foot = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 2 == 0, 1.0))
    d = d.withColumn("face_coverage", depth.footprint_coverage(F.col("image"), foot))
    return depth.frame_stats(d, "image", 3.5).withColumnsRenamed({"std": "std_mm", "median": "median_mm"})


STATS = f"""{PIXELS}, q AS (SELECT vec_id, label, px, CASE WHEN abs(d * 10 + 0.5) <= 3.5 THEN d * 10 + 0.5 END AS d FROM p),
  stats AS (SELECT vec_id, label, count(d) / 64 AS valid_frac, coalesce(avg((abs(d) >= 3.5 - 1e-3)::INT), 1) AS rail_frac, coalesce(stddev_pop(d), 0) AS std_mm, median(d) AS median_mm,
    count(d) FILTER (px % 2 = 0) / 32 AS face_coverage FROM q GROUP BY vec_id, label)"""


@query(f"""WITH {STATS} SELECT label AS session, count(*) AS n_frames, floor(avg(valid_frac) * 1e9)::BIGINT AS valid_frac, floor(avg(rail_frac) * 1e9)::BIGINT AS rail_frac,
  floor(median(std_mm) * 1e6)::BIGINT AS std_mm, floor(avg(face_coverage) * 1e9)::BIGINT AS coverage FROM stats GROUP BY 1""")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build.session_rollup(image_stats(spark, sf_dir))
    scaled = {"valid_frac": 1e9, "rail_frac": 1e9, "std_mm": 1e6, "coverage": 1e9}
    return d.select("session", "n_frames", *[F.floor(F.col(c) * k).alias(c) for c, k in scaled.items()])



@query(f"""WITH {PIXELS} SELECT vec_id, avg((d IS NOT NULL)::INT) AS valid_frac, avg((abs(d) >= 0.2 - 1e-3)::INT) AS rail_frac, floor(stddev_pop(d) * 1e6)::BIGINT AS std,
  floor(median(d) * 1e9)::BIGINT AS median FROM p GROUP BY 1""")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.frame_stats(images(spark, sf_dir), "image", 0.2)
    return d.select("vec_id", "valid_frac", "rail_frac", F.floor(F.col("std") * 1e6).alias("std"), F.floor(F.col("median") * 1e9).alias("median"))


@query(f"WITH {PIXELS} SELECT px::INT AS px, avg((d > -0.02 AND d < 0.3)::INT) AS share FROM p GROUP BY 1 HAVING avg((d > -0.02 AND d < 0.3)::INT) >= 0.5")
def stable_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.inside_shares(images(spark, sf_dir).withColumn("all", F.lit(0)), "all", "image", -0.02, 0.3)
    return d.select(F.posexplode("shares").alias("px", "share")).where("share >= 0.5")


@query(f"WITH {PIXELS} SELECT label, px::INT AS px, median(d) AS d FROM p GROUP BY label, px")
def pixel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.median_images(images(spark, sf_dir), "label", "image").select("label", F.posexplode("image").alias("px", "d"))


@query(f"""WITH {PIXELS}, r AS (SELECT label, px, median(d) AS r FROM p GROUP BY ALL)
  SELECT vec_id, sum(floor(greatest(-1, least(1, (d - r) / 0.2)) * 1e6))::BIGINT AS depth, count(d - r) AS mask FROM p JOIN r USING (label, px) GROUP BY 1""")
def deform_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = depth.median_images(images(spark, sf_dir), "label", "image").withColumnRenamed("image", "reference")
    d = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("image")).join(reference, "label")
    d = d.select("vec_id", depth.deform(F.col("image"), F.col("reference"), 0.2).alias("m"))
    total = F.aggregate("m.depth", F.lit(0).cast("long"), lambda s, x: s + F.floor(x * 1e6))
    return d.select("vec_id", total.alias("depth"), F.aggregate("m.mask", F.lit(0.0), lambda s, x: s + x).cast("long").alias("mask"))


@query(f"""WITH {PIXELS}, q AS (SELECT vec_id, u // 2 AS cu, v // 2 AS cv, CASE WHEN d > -0.05 THEN d END AS d FROM p)
  SELECT vec_id, cv::INT AS cv, cu::INT AS cu, CASE WHEN count(d) / 4 > 0.3 THEN floor(avg(d) * 1e9 + 1 / 3.0::DOUBLE)::BIGINT END AS d FROM q GROUP BY vec_id, cv, cu""")
def masked_resize_8to4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images(spark, sf_dir).withColumn("image", F.transform("image", lambda x: F.when(x > -0.05, x)))
    d = depth.resized(d, "image", 8, 4, 0.3).select("vec_id", F.posexplode("image").alias("i", "d"))
    return d.select("vec_id", F.floor(F.col("i") / 4).cast("int").alias("cv"), (F.col("i") % 4).alias("cu"), F.floor(F.col("d") * 1e9 + 1 / 3).alias("d"))


@query(f"WITH {PIXELS} SELECT vec_id, px::INT AS px, (u - 3.5) * d / 6.0 AS x, (v - 3.5) * d / 6.0 AS y, d AS z FROM p WHERE d > 0")
def deproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images(spark, sf_dir).select("vec_id", F.posexplode(depth.deproject(F.col("image"), 8, 6.0, 6.0, 3.5, 3.5)).alias("px", "p"))
    return d.where("p IS NOT NULL").select("vec_id", "px", "p.*")


MESH = f"""WITH {PIXELS}, q AS (SELECT *, (u - 3.5) * d / 6.0 AS x, (v - 3.5) * d / 6.0 AS y, row_number() OVER (PARTITION BY vec_id ORDER BY v, u) - 1 AS id FROM p WHERE d > 0),
  t AS (
    SELECT a.vec_id, a.id i0, b.id i1, c.id i2, a.x ax, a.y ay, a.d az, b.x bx, b.y by_, b.d bz, c.x cx, c.y cy, c.d cz
    FROM q a JOIN q b ON b.vec_id = a.vec_id AND b.u = a.u + 1 AND b.v = a.v JOIN q c ON c.vec_id = a.vec_id AND c.u = a.u AND c.v = a.v + 1
    UNION ALL
    SELECT a.vec_id, a.id, b.id, c.id, a.x, a.y, a.d, b.x, b.y, b.d, c.x, c.y, c.d
    FROM q a JOIN q b ON b.vec_id = a.vec_id AND b.u = a.u AND b.v = a.v + 1 JOIN q c ON c.vec_id = a.vec_id AND c.u = a.u - 1 AND c.v = a.v + 1
  )
  SELECT vec_id, i0::INT AS i0, i1::INT AS i1, i2::INT AS i2 FROM t WHERE sqrt((ax-bx)**2 + (ay-by_)**2 + (az-bz)**2) < 0.1
    AND sqrt((cx-bx)**2 + (cy-by_)**2 + (cz-bz)**2) < 0.1 AND sqrt((ax-cx)**2 + (ay-cy)**2 + (az-cz)**2) < 0.1"""


def image_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.meshes(images(spark, sf_dir).drop("label"), "image", 8, 6.0, 6.0, 3.5, 3.5, 0.1)


@query(MESH)
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.mesh_faces(image_meshes(spark, sf_dir), "vec_id").drop("nth")


@query("""WITH l AS (SELECT vec_id, k, exp(embedding[k]::DOUBLE) AS e FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)), s AS (SELECT *, sum(e) OVER (PARTITION BY vec_id) AS t FROM l)
  SELECT vec_id, (k - 1)::INT AS top, floor(e / t * 1e9 + 1 / 3.0::DOUBLE)::BIGINT AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, k) = 1""")
def softmax_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform(F.col("embedding").cast("array<double>"), F.exp)
    d = read(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).withColumn("t", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    top = F.array_max("e")
    return d.select("vec_id", (F.array_position("e", top) - 1).cast("int").alias("top"), F.floor(top / F.col("t") * 1e9 + 1 / 3).alias("confidence"))


# More of sessions and clips.


@query(CLIPS + " SELECT session, start::INT AS start, floor(n_label / 16.0 * 1000)::BIGINT AS purity FROM v WHERE reason IS NULL OR reason = 'impure_label'")
def clip_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_clips(spark, sf_dir).where("reason IS NULL OR reason = 'impure_label'")
    return d.select("session", "start", F.floor(F.col("n_label") / 16 * 1000).alias("purity"))


@query(CLIPS + """, ids AS (SELECT label, row_number() OVER (ORDER BY label)::INT AS label_id FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> 'view'))
  SELECT session, start::INT AS start, coalesce(label_id, 0) AS label_id FROM v LEFT JOIN ids USING (label) WHERE reason IS NULL""")
def clip_label_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = frames.label_ids(read(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("event_type").alias("label")))
    d = event_clips(spark, sf_dir).where("reason IS NULL").join(ids, "label", "left")
    return d.select("session", "start", F.coalesce("label_id", F.lit(0)).alias("label_id"))


@query(split_sql(0.2, 0.2).replace("SELECT session, split FROM every_one", "SELECT split, string_agg(session, ',' ORDER BY session) AS sessions FROM every_one GROUP BY split"))
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(event_sessions(spark, sf_dir)).groupBy("split").agg(F.array_join(F.sort_array(F.collect_list("session")), ",").alias("sessions"))


@query("SELECT user_id AS session, event_type AS label, round(avg(value), 3) AS dc FROM events GROUP BY ALL")
def label_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.label_dc(event_medians(spark, sf_dir))


@query(f"""WITH {STATS}, r AS (SELECT label AS session, avg(rail_frac) AS rail, median(std_mm) AS std, avg(face_coverage) AS cover FROM stats GROUP BY 1)
  SELECT session, concat_ws(',', CASE WHEN rail > 0.02 THEN 'saturated' END, CASE WHEN std < 0.5 THEN 'flat' END, CASE WHEN cover < 0.5 THEN 'uncovered' END) AS problems FROM r""")
def gate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build.gated(build.session_rollup(image_stats(spark, sf_dir)))
    return d.select("session", F.array_join("problems", ",").alias("problems"))


EVENT_SPLIT = "CASE session % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


@query(CLIPS + f""", c2 AS (SELECT session, {EVENT_SPLIT} AS split, CASE WHEN session % 5 = 0 AND label = 'click' THEN 'unlabeled' ELSE label END AS label FROM v WHERE reason IS NULL),
  means AS (SELECT session, label, round(avg(value), 3) AS dc FROM f GROUP BY ALL), sp AS (SELECT session, CASE WHEN count(*) > 1 THEN round(max(dc) - min(dc), 3) ELSE 0 END AS spread FROM means GROUP BY 1),
  cv AS (SELECT session, avg(valid) AS coverage, spread FROM f JOIN sp USING (session) GROUP BY session, spread),
  refused AS (SELECT session FROM cv WHERE coverage < 0.65), kept AS (SELECT * FROM cv WHERE coverage >= 0.65),
  k AS (SELECT DISTINCT label FROM c2 WHERE label <> 'unlabeled'), own AS (SELECT split, list(DISTINCT label) FILTER (label <> 'unlabeled') AS own FROM c2 GROUP BY 1)
  SELECT 'refused' AS rule, session::VARCHAR AS detail FROM refused
  UNION ALL SELECT 'few_sessions', count(*)::VARCHAR FROM kept HAVING count(*) < 3
  UNION ALL SELECT 'empty_split', x FROM (SELECT unnest(['val', 'test']) AS x) WHERE x NOT IN (SELECT split FROM c2)
  UNION ALL SELECT 'small_train', count(*) FILTER (split = 'train') || '/' || count(*) FROM c2 HAVING count(*) > 0 AND count(*) FILTER (split = 'train') < 0.4 * count(*)
  UNION ALL SELECT 'few_classes', count(*)::VARCHAR FROM k HAVING count(*) < 2
  UNION ALL SELECT 'missing_class', split || ' ["' || string_agg(label, '","' ORDER BY label) || '"]' FROM own, k WHERE NOT list_contains(coalesce(own, []), label) GROUP BY split
  UNION ALL SELECT 'drift', session::VARCHAR FROM kept WHERE spread > 2
  UNION ALL SELECT 'low_coverage', session::VARCHAR FROM kept WHERE coverage < 0.8""")
def build_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rules over sessions of events; in the test split a label is taken away, so that one is missing there."""
    d = event_frames(spark, sf_dir)
    rows = d.groupBy("session").agg(F.avg("valid").alias("coverage")).join(build.dc_spread(build.label_dc(d.withColumn("median_mm", F.col("value")))), "session")
    part = F.col("session") % 5
    split = F.when(part == 0, "test").when(part == 1, "val").otherwise("train")
    clips = event_clips(spark, sf_dir).where("reason IS NULL")
    clips = clips.select(split.alias("split"), F.when((part == 0) & (F.col("label") == "click"), frames.UNLABELED).otherwise(F.col("label")).alias("label"))
    return build.build_warnings(rows.where("coverage >= 0.65"), rows.where("coverage < 0.65").select("session"), clips)


@query("SELECT DISTINCT user_id AS session FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def relabel_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_type", "value")
    return e.join(e.where("event_type = 'error' AND value > 100"), "session", "left_anti").select("session").distinct()


@query("""SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') ELSE '' END AS DOUBLE),
  try_cast(CASE WHEN event_id % 2 > 0 THEN value::VARCHAR ELSE 'none' END AS DOUBLE) * 1000) AS t_ms FROM events""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k")).otherwise("")
    host = F.when(F.col("event_id") % 2 > 0, F.col("value").cast("string")).otherwise("none")
    return read(spark, sf_dir, "events").select("event_id", frame_times_ms(device, host).alias("t_ms"))


@query(f"""WITH {FRAMES} SELECT session, substr(sha1(sum(('0x' || substr(sha1(pos || ':' || label || ':' || trial), 1, 15))::BIGINT)::VARCHAR), 1, 16) AS digest FROM f GROUP BY 1""")
def label_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.label_digest(event_frames(spark, sf_dir))


@query(f"""WITH {FRAMES}, e AS (SELECT *, sum((label = 'error' AND pos % 7 = 0)::INT) OVER (PARTITION BY session ORDER BY pos) AS epoch FROM f),
  k AS (SELECT *, row_number() OVER (PARTITION BY session, epoch ORDER BY pos) AS filled FROM e) SELECT session, pos, epoch::BIGINT AS epoch FROM k WHERE filled >= 16 AND pos % 4 = 0""")
def prediction_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pause = ((F.col("label") == "error") & (F.col("pos") % 7 == 0)).cast("int")
    return frames.prediction_ticks(event_frames(spark, sf_dir).withColumn("epoch", F.sum(pause).over(w))).select("session", "pos", "epoch")


# More of depth images.


@query(f"WITH {PIXELS} SELECT label, floor((quantile_cont(d, 0.95) - quantile_cont(d, 0.05)) * 1e9)::BIGINT AS relief FROM p GROUP BY 1")
def relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.relief(image_pixels(spark, sf_dir), "label", 1.0).select("label", F.floor(F.col("relief") * 1e9).alias("relief"))


@query(f"""WITH {PIXELS}, g AS (SELECT label, px, CASE WHEN d > 0 THEN d END AS d FROM p),
  s AS (SELECT label, px, quantile_cont(d, 0.5) AS d, count(d) AS n, quantile_cont(d, 0.9) - quantile_cont(d, 0.1) AS spread FROM g GROUP BY label, px)
  SELECT label, px::INT AS px, CASE WHEN n >= 3 AND spread <= 0.2 THEN d END AS d, n > 0 AND NOT (n >= 3 AND coalesce(spread <= 0.2, false)) AS dropped FROM s""")
def temporal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.average_images(images(spark, sf_dir), "label", "image", 0.2)
    return d.select("label", F.posexplode(F.arrays_zip("image", "dropped")).alias("px", "x")).select("label", "px", F.col("x.image").alias("d"), "x.dropped")


@query(f"""WITH {PIXELS}, g AS (SELECT label, px, d FROM p WHERE d > 0), s AS (SELECT label, px, count(d) >= 3 AND quantile_cont(d, 0.9) - quantile_cont(d, 0.1) <= 0.2 AS good FROM g GROUP BY label, px)
  SELECT l.label, CASE WHEN count(good) > 0 THEN sum((NOT good)::INT) / count(good) ELSE 1 END AS share FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN s ON s.label = l.label GROUP BY 1""")
def dropped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.average_images(images(spark, sf_dir), "label", "image", 0.2).select("label", "share")


@query(f"WITH {PIXELS}, b AS (SELECT px FROM p GROUP BY px HAVING avg((d > -0.02 AND d < 0.3)::INT) >= 0.5) SELECT floor(median(d) * 1e9)::BIGINT AS reference FROM p JOIN b USING (px) WHERE d > -0.02 AND d < 0.3")
def pooled_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = image_pixels(spark, sf_dir)
    d = px.join(depth.stable_pixels(px, -0.02, 0.3), "px", "left_semi").where("d > -0.02 AND d < 0.3")
    return d.agg(F.floor(F.median("d") * 1e9).alias("reference"))


@query(f"""WITH {PIXELS}, r AS (SELECT vec_id, px, d > 0 AS there, d - 0.05::DOUBLE AS d FROM p), m AS (SELECT vec_id, median(d) FILTER (there AND abs(d) <= 0.15) AS own FROM r GROUP BY 1)
  SELECT vec_id, px::INT AS px, CASE WHEN there AND abs(d - coalesce(own, 0)) <= 0.15 THEN floor((d - coalesce(own, 0)) * 1e9)::BIGINT END AS d FROM r JOIN m USING (vec_id)""")
def dc_removed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = depth.relative(images(spark, sf_dir), "image", 0.05, 0.15, center=True).select("vec_id", F.posexplode("image").alias("px", "d"))
    return d.select("vec_id", "px", F.floor(F.col("d") * 1e9).alias("d"))


@query(f"""WITH {PIXELS}, h AS (SELECT vec_id, median(d) FILTER (d > -0.05) AS m FROM p GROUP BY 1), q AS (SELECT vec_id, px, u, v, CASE WHEN d > -0.05 THEN d ELSE m END AS d FROM p JOIN h USING (vec_id))
  SELECT vec_id, px::INT AS px,
  (coalesce(lead(d) OVER r, d) - coalesce(lag(d) OVER r, d)) / CASE WHEN u IN (0, 7) THEN 1 ELSE 2 END AS gx,
  (coalesce(lead(d) OVER c, d) - coalesce(lag(d) OVER c, d)) / CASE WHEN v IN (0, 7) THEN 1 ELSE 2 END AS gy
  FROM q WINDOW r AS (PARTITION BY vec_id, v ORDER BY u), c AS (PARTITION BY vec_id, u ORDER BY v)""")
def gradient_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = images(spark, sf_dir).withColumn("image", F.transform("image", lambda x: F.when(x > -0.05, x)))
    d = depth.gradients(d, "image", 8).select("vec_id", F.posexplode(F.arrays_zip("gx", "gy")).alias("px", "g"))
    return d.select("vec_id", "px", "g.*")


@query(MESH.replace("SELECT vec_id, i0::INT AS i0, i1::INT AS i1, i2::INT AS i2 FROM t WHERE", """, f AS (SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS nz FROM t WHERE""").replace("\n  , f AS", ", f AS") + """),
  n AS (SELECT vec_id, unnest([i0, i1, i2]) AS id, nx, ny, nz FROM f), s AS (SELECT vec_id, id, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM n GROUP BY ALL),
  l AS (SELECT *, sqrt(nx**2 + ny**2 + nz**2) * CASE WHEN nz > 0 THEN -1 ELSE 1 END AS size FROM s)
  SELECT vec_id, id::INT AS id, floor(nx / size * 1e6 + 0.5)::BIGINT AS nx, floor(ny / size * 1e6 + 0.5)::BIGINT AS ny, floor(nz / size * 1e6 + 0.5)::BIGINT AS nz FROM l""")
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = export.mesh_normals(image_meshes(spark, sf_dir), "vec_id").where("nx <> 0 OR ny <> 0 OR nz <> 0")  # those of a face
    return d.select("vec_id", "id", *[F.floor(F.col(c) * 1e6 + 0.5).alias(c) for c in ("nx", "ny", "nz")])


@query(f"""WITH RECURSIVE {PIXELS}, q AS (SELECT vec_id, px, u, v FROM p WHERE d > 0.05),
  w(vec_id, px, u, v, root) AS (
    SELECT vec_id, px, u, v, px FROM q
    UNION
    SELECT q.vec_id, q.px, q.u, q.v, w.root FROM w JOIN q ON q.vec_id = w.vec_id AND abs(q.u - w.u) <= 1 AND abs(q.v - w.v) <= 1
  ), c AS (SELECT vec_id, px, min(root) AS root FROM w GROUP BY vec_id, px),
  b AS (SELECT vec_id, root FROM c GROUP BY vec_id, root QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, root) = 1)
  SELECT vec_id, px::INT AS px FROM c JOIN b USING (vec_id, root)""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0.05, x))
    return depth.largest_surface(read(spark, sf_dir, "embeddings").select("vec_id", image.alias("image")), "vec_id", "image", 8)


# Streams.


@query(f"""WITH {FRAMES}, m AS (SELECT session, pos, avg(value) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS mean FROM f),
  t AS (SELECT session, pos, list(mean) OVER (PARTITION BY session ORDER BY pos) AS means FROM m WHERE pos >= 15 AND pos % 4 = 0)
  SELECT session, pos::BIGINT AS pos, floor(list_reduce(means, lambda s, x: 0.6::DOUBLE * s + (1 - 0.6::DOUBLE) * x) * 1e6 + 1 / 3.0::DOUBLE)::BIGINT AS smoothed FROM t""")
def live_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # A file stream takes folders and patterns; this pattern matches the table's path alone, file or folder.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path[:-1] + "[t]")
    stream = stream.select(F.col("user_id").alias("session"), "ts", "event_id", "value", F.lit(False).alias("paused"))
    d = live.run_available(live.live_predictions(stream), shared_path(spark, "live"))
    # Values are finite decimals, so with a third added none stands at a step of floor, where the order of sums would tell.
    return d.select("session", "pos", F.floor(F.col("smoothed") * 1e6 + 1 / 3).alias("smoothed"))
