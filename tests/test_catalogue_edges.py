"""Catalogue queries against their SQL on tables of odd sizes and values."""

import duckdb
import numpy as np
import pytest

from fathom.operators import training
from fathom.plans import catalogue, depth_catalogue  # noqa: F401


def same_rows(spark, name, folder):
    con = duckdb.connect()
    con.execute("SET threads = 1")  # sums of floats have one order then
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    want = con.execute(catalogue.ORACLE[name]).fetch_df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [d[columns].sort_values(columns, ignore_index=True).astype(object).where(d[columns].sort_values(columns, ignore_index=True).notna(), None).values.tolist() for d in (got, want)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="module")
def three_and_a_half(spark, sf_dir, tmp_path_factory):
    """Embeddings of three whole frames and of half a frame."""
    folder = str(tmp_path_factory.mktemp("half"))
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 14").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["measured_distance", "spread_tolerance", "temporal_std"])
def test_a_frame_with_too_few_quadrants_is_left_out(spark, three_and_a_half, name):
    same_rows(spark, name, three_and_a_half)


def window(spark, sf_dir, folder, first, last):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(f"vec_id BETWEEN {first} AND {last}")
    d.withColumn("vec_id", d.vec_id - first).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("first", [22, 92])
def test_halves_in_the_notes_of_a_fit_are_rounded_up(spark, sf_dir, tmp_path, first):
    same_rows(spark, "fit_state", window(spark, sf_dir, str(tmp_path), first, first + 239))


@pytest.fixture(scope="module")
def borders(spark, sf_dir, tmp_path_factory):
    """Frames with cells at borders of rounding, where the order of sums tells."""
    return window(spark, sf_dir, str(tmp_path_factory.mktemp("borders")), 44, 499)


@pytest.mark.parametrize("name", ["relative_frame", "absolute_input", "face_coverage", "model_input"])
def test_floats_at_borders_of_rounding_fall_as_in_the_sql(spark, borders, name):
    same_rows(spark, name, borders)


def test_shares_of_a_clip_are_divided_once():
    rng = np.random.default_rng(1)
    for lost in range(1, 200):
        mask = np.ones((16, 5, 5), np.float32)
        mask.ravel()[rng.choice(mask.size, lost, replace=False)] = 0
        blocks = [mask[:, r, c] for r in (slice(2), slice(2, 5)) for c in (slice(2), slice(2, 5))]
        assert training.pooled(np.stack([mask, mask]), 2)[8:].tolist() == [int(b.sum()) / b.size for b in blocks]
