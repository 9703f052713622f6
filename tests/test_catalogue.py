"""Each catalogue query against its SQL, in DuckDB, over the same tables."""

import duckdb
import numpy as np
import pytest

from fathom.plans import catalogue, depth_catalogue  # noqa: F401

TABLES = "documents embeddings events labels conversations orders lineitem".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got = got[columns].sort_values(columns, ignore_index=True)
    want = want[columns].sort_values(columns, ignore_index=True)
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_every_query_is_registered():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
