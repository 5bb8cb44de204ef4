"""Readers and writers on tiny files that the tests write themselves."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import mesh
from plumbline.sources import arrays, colmap, meshes, tables


def test_npz(spark, tmp_path):
    poses = np.tile(np.eye(4), (2, 1, 1)) * np.arange(1, 3)[:, None, None]
    arrays.write_npz(spark, f"file://{tmp_path}/a.npz", {"cam_c2w": poses, "intrinsic": np.eye(3), "depth": np.arange(6.0).reshape(2, 3)})
    got = arrays.read_npz(spark, str(tmp_path), aliases={"depth": "depths"})
    depth = arrays.exploded(got.filter("key = 'depths'"), ["y", "x"]).filter("y = 1 AND x = 2").first()
    assert depth["value"] == 5.0
    frames = arrays.camera_bundle(got).orderBy("t").collect()
    assert len(frames) == 2 and frames[1]["c2w"][0] == 2.0 and frames[0]["scale"] == 1.0
    assert arrays.list_files(spark, str(tmp_path), [".npz", ".txt"]).count() == 1


def test_colmap_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# cameras\n1 PINHOLE 640 480 500 501 320 240\n2 SIMPLE_RADIAL 640 480 400 320 240 0.1\n")
    (tmp_path / "images.txt").write_text("# images\n1 1 0 0 0 0.1 0.2 0.3 1 a b.png\n10 20 7 30 40 -1\n2 0 1 0 0 1 2 3 2 c.png\n\n")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 10 20 30 0.5 1 0 2 1\n8 0 0 0 1 1 1 0.1\n9 1 1 1 2 2 2 0.2 1 1\n")
    cameras = colmap.read_cameras_text(spark, f"{tmp_path}/cameras.txt").orderBy("id")
    assert cameras.collect()[0]["params"] == [500, 501, 320, 240]
    assert colmap.intrinsics(cameras).orderBy("id").collect()[1]["k"][4] == 400
    images = colmap.read_images_text(spark, f"{tmp_path}/images.txt").orderBy("id")
    one, two = images.collect()
    assert one["name"] == "a b.png" and one["point3d_ids"] == [7, -1] and one["xys"][1]["y"] == 40 and two["xys"] == []
    assert np.allclose(colmap.extrinsics(images).orderBy("id").first()["extrinsics"][3::4], [0.1, 0.2, 0.3, 1])
    points = colmap.read_points_text(spark, f"{tmp_path}/points3D.txt").orderBy("id")
    assert points.first()["image_ids"] == [1, 2] and points.collect()[1]["image_ids"] == []
    colmap.write_cameras_text(cameras, f"{tmp_path}/c")
    colmap.write_images_text(images, f"{tmp_path}/i")
    colmap.write_points_text(points, f"{tmp_path}/p")
    again = colmap.read_images_text(spark, f"{tmp_path}/i").orderBy("id").collect()
    assert again == [one, two]
    assert colmap.read_cameras_text(spark, f"{tmp_path}/c").orderBy("id").collect() == cameras.collect()
    assert colmap.read_points_text(spark, f"{tmp_path}/p").orderBy("id").collect() == points.collect()


def test_colmap_binary(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 1, 640, 480, 500, 501, 320, 240))
    (tmp_path / "images.bin").write_bytes(struct.pack("<Qi7di", 1, 5, 1, 0, 0, 0, 1, 2, 3, 1) + b"x.png\0" + struct.pack("<Qddqddq", 2, 1.5, 2.5, 7, 3.5, 4.5, -1))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<QQ3d3BdQiiii", 1, 7, 1, 2, 3, 9, 8, 7, 0.5, 2, 5, 0, 6, 1))
    assert colmap.read_cameras_binary(spark, str(tmp_path)).first()["params"] == [500, 501, 320, 240]
    image = colmap.read_images_binary(spark, str(tmp_path)).first()
    assert image["name"] == "x.png" and image["point3d_ids"] == [7, -1] and image["xys"][1]["x"] == 3.5
    point = colmap.read_points_binary(spark, str(tmp_path)).first()
    assert point["rgb"] == [9, 8, 7] and point["point2d_idxs"] == [0, 1]


def test_meshes(spark, tmp_path):
    (tmp_path / "part_000.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    (tmp_path / "part_001.obj").write_text("o thing\nv 5 0 0\nv 6 0 0\nv 6 1 0\nf -3 -2 -1\n")
    v, f = meshes.read_scene(spark, str(tmp_path))
    assert v.count() == 7 and sorted(tuple(r)[1:] for r in f.select("fid", "v0", "v1", "v2").collect()) == [(0, 1, 2), (0, 2, 3), (4, 5, 6)]
    meshes.write_obj(v, f, f"{tmp_path}/out")
    again, faces = meshes.obj_mesh(meshes.read_obj(spark, f"{tmp_path}/out"))
    assert again.count() == 7 and faces.count() == 3
    (tmp_path / "bad.obj").write_text("v 0 0 0\nwhat 1\n")
    with pytest.raises(Exception, match="unknown keyword"):
        meshes.read_obj(spark, f"{tmp_path}/bad.obj").collect()
    for ascii in (True, False):
        meshes.write_ply(spark, f"file://{tmp_path}/ply{ascii}/a.ply", *mesh.cube(spark), ascii=ascii)
        points, polygons = meshes.read_ply(spark, f"{tmp_path}/ply{ascii}")
        assert points.count() == 8 and polygons.count() == 12 and points.agg(F.max("x")).first()[0] == 0.5
    meshes.write_scene_urdf(spark, f"file://{tmp_path}/urdf", {"a": mesh.square(spark)}, {"a": ((1, 2, 3), (0, 0, 0))})
    assert 'xyz="1 2 3"' in (tmp_path / "urdf/scene.urdf").read_text()
    (tmp_path / "robot").mkdir()
    (tmp_path / "robot/r.xml").write_text('<mujoco><worldbody><body name="a"><geom type="box" size="1 2 3"/><body name="b"><geom pos="0 0 1"/></body></body><body name="c"><geom/></body></worldbody></mujoco>')
    geoms = meshes.read_mjcf(spark, f"{tmp_path}/robot").orderBy("geom").collect()
    assert [(g["body"], g["body_name"], g["kind"]) for g in geoms] == [(0, "a", "box"), (1, "b", "sphere"), (2, "c", "sphere")]


def test_small_tables(spark, tmp_path):
    log = spark.createDataFrame([(1, 0, 0, 0.5)], "iteration long, epoch long, batch long, loss double")
    tables.append_metrics(log, f"{tmp_path}/log")
    tables.append_metrics(log, f"{tmp_path}/log")
    assert tables.read_metrics(spark, f"{tmp_path}/log", ["loss"]).agg(F.sum("loss")).first()[0] == 1.0
    for name in ("L_Hand", "R_Hand"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"verts_ind": [1, 2, 7000], "faces_ind": []}))
    assert tables.read_body_parts(spark, f"{tmp_path}/*.json").count() == 4
    assert tables.read_body_parts(spark, f"{tmp_path}/*.json", "grouped").count() == 3
    assert tables.read_body_parts(spark, f"{tmp_path}/*.json", "all").count() == 2
    files = spark.createDataFrame([("x/flow_00012_00019.npz",), ("x/other.npz",)], "path string")
    assert [(r["fi"], r["fj"]) for r in tables.frame_pairs(files).collect()] == [(12, 19)]
    names = spark.createDataFrame([("0101_scene_one_ours",), ("0101_scene_ours_trimesh",)], "n string")
    assert [tuple(r) for r in names.select(*tables.split_name(F.col("n"))).collect()] == [("0101", "scene_one", "ours"), ("0101", "scene", "ours_trimesh")]
    assert tables.merged_config({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    joints = spark.createDataFrame([(0, "a", "hinge", -1.0, 1.0), (1, "b", "fixed", None, None), (2, "c", "hinge", None, None)], "n int, name string, kind string, lower double, upper double")
    set_ = spark.createDataFrame([("a", 5.0)], "name string, value double")
    assert [(r["name"], r["value"]) for r in tables.joint_configuration(joints, set_).orderBy("n").collect()] == [("a", 1.0), ("c", 0.0)]
