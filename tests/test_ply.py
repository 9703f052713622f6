"""PLY files through the data source: round trips, whole writes or none, odd files."""

import os

import pytest
from pyspark.sql import functions as F

from fathom.sources import ply

SCHEMA = f"name string, extra int, {ply.VERTICES}, {ply.FACES}, normals array<struct<nx:double,ny:double,nz:double>>"


@pytest.fixture(scope="module")
def made(spark):
    ply.register(spark)
    rows = []
    for k in range(12):
        v = [(float(i), i * 0.5, -float(k)) for i in range(k)]
        rows.append((f"s{k % 2}/frame_{k:06d}.ply", k, v, [(0, 1, 2)] * (k // 3), [(0.0, 0.0, 1.0)] * k))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def files(folder):
    return sorted(os.path.relpath(os.path.join(at, f), folder) for at, _, names in os.walk(folder) for f in names if not f.startswith("."))


@pytest.mark.parametrize("binary", [True, False])
def test_round_trip(spark, made, tmp_path, binary):
    folder = str(tmp_path / "out")
    made.write.format("ply").mode("append").option("binary", binary).save(folder)
    assert files(folder) == sorted(r.name for r in made.collect()) and not os.path.exists(f"{folder}/_staging")
    d = spark.read.format("ply").option("sequence", True).option("partitionBytes", 300).load(folder)
    assert d.rdd.getNumPartitions() > 3
    got = {r.path: r for r in d.collect()}
    for r in made.collect():
        assert (got[r.name].vertices, got[r.name].faces, got[r.name].nth) == (r.vertices, r.faces, r.extra // 2)
    assert spark.read.format("ply").load(folder).columns == ["path", "vertices", "faces"]


def test_a_write_is_whole_or_nothing(spark, made, tmp_path):
    folder = str(tmp_path / "out")
    part = made.where("extra < 4")
    part.write.format("ply").mode("append").save(folder)
    before = files(folder)
    slow = F.when(F.col("extra") == 11, F.raise_error(F.lit("lost"))).otherwise(F.col("name"))
    twice = made.where("extra >= 4")
    for bad in (made.where("extra >= 4").withColumn("name", slow.cast("string")), made, twice.union(twice), twice.withColumn("name", F.lit("../x.ply")), twice.withColumn("name", F.lit(None).cast("string"))):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format("ply").mode("append").save(folder)
        assert files(folder) == before
    made.where("extra >= 2").write.format("ply").mode("overwrite").save(folder)
    assert files(folder) == sorted(r.name for r in made.collect() if r.extra >= 2)


def test_odd_rows_and_files(spark, tmp_path):
    ply.register(spark)
    folder = str(tmp_path / "out")
    rows = [("a.ply", None, None, None, None), ("b.ply", 1, [], [], [])]
    spark.createDataFrame(rows, SCHEMA).write.format("ply").mode("append").save(folder)
    for name, data in (("c.ply", b"ply\nno header"), ("d.ply", b""), ("e.txt", b"x")):
        (tmp_path / "out" / name).write_bytes(data)
    got = {r.path: (r.vertices, r.faces) for r in spark.read.format("ply").load(folder).collect()}
    assert got == {"a.ply": ([], []), "b.ply": ([], []), "c.ply": (None, None), "d.ply": (None, None)}
    with pytest.raises(Exception, match="no PLY file"):
        spark.read.format("ply").option("failFast", True).load(folder).collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("ply").load(str(empty)).count() == 0
    spark.createDataFrame([], SCHEMA).write.format("ply").mode("append").save(str(tmp_path / "never"))
    with pytest.raises(Exception, match="name"):
        spark.range(3).write.format("ply").mode("append").save(folder)
