"""Spark data sources of bundles, clouds and meshes."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators import mesh
from plumbline.sources import formats, meshes


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def test_a_large_cloud_is_written_and_read_by_executors(spark, tmp_path):
    cloud = spark.range(0, 1_000_000, 1, 4).select((F.col("id") * 0.5).alias("x"), (-F.col("id")).cast("double").alias("y"), F.sin("id").alias("z"), (F.col("id") % 256).cast("int").alias("r"))
    cloud.write.format("ply").mode("append").save(f"{tmp_path}/cloud")
    assert len(list((tmp_path / "cloud").iterdir())) == 4
    back = spark.read.format("ply").load(f"{tmp_path}/cloud")
    sums = lambda df: tuple(df.agg(F.count("x"), F.sum("x"), F.sum("y"), F.sum(F.xxhash64("x", "y", "z", F.col("r").cast("double")).cast("decimal(38,0)"))).first())
    assert sums(back) == sums(cloud)
    assert back.filter("nx IS NOT NULL").count() == 0


def test_columns_rows_and_files_that_are_not_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "ROWS", 100)
    spark.range(0, 250, 1, 1).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z")).write.format("ply").mode("append").save(f"{tmp_path}/c")
    assert [r[0] for r in spark.read.format("ply").schema("z double").load(f"{tmp_path}/c").distinct().collect()] == [2.0]
    file = sorted(str(p) for p in (tmp_path / "c").iterdir())[0]
    reader = formats.PlyReader({"path": f"{tmp_path}/c", "files": file.rpartition("/")[2]}, StructType().add("x", "double"))
    assert {p.file for p in reader.partitions()} == {file}
    for ascii in (True, False):
        meshes.write_ply(spark, f"file://{tmp_path}/m{ascii}/a.ply", *mesh.cube(spark), ascii=ascii)
        assert spark.read.format("ply").load(f"{tmp_path}/m{ascii}").agg(F.max("x"), F.max("vid")).first()[:] == (0.5, 7)


def test_bundles(spark, tmp_path):
    rows = [(f"b{i}", k, "float32", [2, 3], [float(i + j) for j in range(6)]) for i in range(5) for k in ("depth", "mask")]
    kind = "bundle string, key string, dtype string, shape array<long>, data array<double>"
    df = spark.createDataFrame(rows, kind).repartition(3, "bundle").sortWithinPartitions("bundle", "key")
    df.write.format("npz").mode("append").save(f"{tmp_path}/n")
    with np.load(tmp_path / "n/b3.npz") as found:
        assert found["depth"].dtype == np.float32 and found["depth"].shape == (2, 3) and found["mask"][1, 2] == 8
    back = spark.read.format("npz").load(f"{tmp_path}/n")
    assert back.count() == 10
    assert spark.read.format("npz").option("keys", "mask").option("files", "b1.npz, b2.npz").load(f"{tmp_path}/n").count() == 2
    assert sorted(r["data"][0] for r in back.filter("key = 'mask'").collect()) == [0, 1, 2, 3, 4]
    assert spark.read.format("npz").schema("key string, shape array<long>").load(f"{tmp_path}/n").first()["shape"] == [2, 3]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    twice = spark.createDataFrame([("same", "k", "float64", [1], [1.0])] * 4, "bundle string, key string, dtype string, shape array<long>, data array<double>").repartition(4)
    twice = twice.withColumn("key", F.concat("key", F.spark_partition_id().cast("string")))
    with pytest.raises(Exception, match="one name"):
        twice.write.format("npz").mode("append").save(f"{tmp_path}/n")
    assert not (tmp_path / "n").exists() or not list((tmp_path / "n").iterdir())


def test_statements(spark, tmp_path):
    rows = [("part_000", "v", ["0", "0", "0"]), ("part_000", "v", ["1", "0", "0"]), ("part_000", "v", ["1", "1", "0"]), ("part_000", "f", ["1", "2", "3"]), ("part_001", "v", ["5", "5", "5"])]
    spark.createDataFrame(rows, "part string, keyword string, words array<string>").coalesce(1).write.format("obj").mode("append").save(f"{tmp_path}/o")
    statements = spark.read.format("obj").load(f"{tmp_path}/o")
    vertices, faces = meshes.obj_mesh(statements)
    assert vertices.count() == 4 and faces.count() == 1
    assert statements.filter("keyword = 'f'").first()["words"] == ["1", "2", "3"]
    (tmp_path / "o/bad.obj").write_text("what 1\n")
    with pytest.raises(Exception, match="unknown keyword"):
        spark.read.format("obj").load(f"{tmp_path}/o").count()
    assert spark.read.format("obj").option("unknown", "ignore").load(f"{tmp_path}/o").count() == 5


def test_colmap_model(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 1, 640, 480, 500, 501, 320, 240))
    (tmp_path / "images.bin").write_bytes(struct.pack("<Qi7di", 1, 5, 1, 0, 0, 0, 1, 2, 3, 1) + b"x.png\0" + struct.pack("<Qddqddq", 2, 1.5, 2.5, 7, 3.5, 4.5, -1))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<QQ3d3BdQiiii", 1, 7, 1, 2, 3, 9, 8, 7, 0.5, 2, 5, 0, 6, 1))
    read = lambda t: spark.read.format("colmap").option("table", t).load(str(tmp_path)).first()
    assert read("cameras")["params"] == [500, 501, 320, 240]
    assert read("images")["name"] == "x.png" and read("images")["xys"][1]["x"] == 3.5
    assert read("points3D")["point2d_idxs"] == [0, 1]
    assert spark.read.format("colmap").schema("error double").load(str(tmp_path)).first()["error"] == 0.5
