"""Segmented scans against plain loops: many short segments, gaps in pos, null sessions, one session with nearly all rows."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import frames, scans


def plain(rows):
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        by[r[0]].append(r)
    return by


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = []
    for session, n in (("hot", 700), ("b", 40), (None, 30), ("one", 1)):
        pos = np.sort(r.choice(3 * n, n, replace=False)) if session != "b" else np.arange(n)
        label = np.repeat(r.choice(list("xyz"), n), r.choice([1, 1, 2, 30], n))[:n]
        clock = np.cumsum(r.choice([0.0, 33.0, 34.0, 500.0], n))
        out += [(session, int(p), [None, str(x)][x != "z"], float(t)) for p, x, t in zip(pos, label, clock)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "session string, pos int, label string, t_ms double").repartition(4)


@pytest.fixture(params=[1, 7, 2048], autouse=True)
def segment(request, monkeypatch):
    monkeypatch.setattr(scans, "SEGMENT", request.param)


def test_runs(rows, table):
    want = set()
    for session, own in plain(rows).items():
        for label, group in itertools.groupby(own, key=lambda r: r[2]):
            group = list(group)
            want.add((session, label, group[0][1], len(group)))
    got = [tuple(r) for r in frames.runs(table).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("n", [1, 2, 30, 400])
def test_rates(rows, table, n):
    want = {}
    for session, own in plain(rows).items():
        for k, r in enumerate(own):
            first = max(0, k - n + 1)
            span = r[3] - own[first][3]
            want[session, r[1]] = (k - first) / (span / 1000) if span > 0 else 0.0
    got = {(r.session, r.pos): r.rate for r in frames.rolling_rate(table, n).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_nth_and_ticks(rows, table):
    want = {(s, r[1]) for s, own in plain(rows).items() for r in own[::5]}
    assert {(r.session, r.pos) for r in frames.every_nth(table, 5).collect()} == want
    epochs = table.withColumn("epoch", F.floor(F.col("pos") / 90))
    want = set()
    for s, own in plain(rows).items():
        seen = collections.Counter()
        for r in own:
            seen[r[1] // 90] += 1
            if seen[r[1] // 90] >= 16 and r[1] % 4 == 0:
                want.add((s, r[1]))
    assert {(r.session, r.pos) for r in frames.prediction_ticks(epochs).collect()} == want


@pytest.mark.parametrize("seconds", [0.5, 60.0])
def test_labels_carry_over_segments(spark, rows, monkeypatch, seconds):
    monkeypatch.setattr(scans.carried, "__kwdefaults__", {"seconds": seconds})
    r = np.random.default_rng(6)
    events = [(s, float(t), ["label", "other"][k % 7 == 0], f"v{k}") for k, (s, t) in enumerate((s, t) for s, own in plain(rows).items() for t in r.choice([x[3] / 1000 for x in own], 9))]
    events = list({(s, t): (s, t, kind, v) for s, t, kind, v in events}.values())
    f = spark.createDataFrame([(s, t / 1000, p) for s, p, _, t in rows], "session string, elapsed_s double, pos int")
    e = spark.createDataFrame(events, "session string, elapsed_s double, kind string, value string")
    marks = [(s, t, v) for s, t, kind, v in events if kind == "label"]
    want = {(s, p): max(((m[1], m[2]) for m in marks if m[0] == s and m[1] <= t / 1000), default=(0, "unlabeled"))[1] for s, p, _, t in rows}
    assert {(x.session, x.pos): x.label for x in frames.carried_labels(f, e).collect()} == want


def test_places_in_ranges_are_those_in_one_task(spark):
    rows = [(None if k % 11 == 0 else k % 3 and 1, k, "click", float(k * 37 % 101)) for k in range(300)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("value")))
    one, many = ({(r.session, r.pos, r.value, r.trial) for r in frames.positions(d, most=most).collect()} for most in (1000, 10))
    assert one == many and len(one) == 300 and frames.positions(d, most=10).dtypes == frames.positions(d).dtypes


def test_one_session_is_many_tasks(spark):
    """With one session only, no partition of the segments has more than twice the mean of the rows."""
    d = spark.range(200_000).select(F.lit("s").alias("session"), F.col("id").cast("int").alias("pos"), F.lit("x").alias("label"), F.col("id").cast("double").alias("t_ms"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if scans.SEGMENT < 2048:
            return
        for out in (frames.rolling_rate(d), frames.every_nth(d, 1), scans.ranked(d, "n")):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 200_000 and max(sizes) <= 2 * 200_000 / 8
        assert [tuple(r) for r in frames.runs(d).collect()] == [("s", "x", 0, 200_000)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
