"""Compositions on a small synthetic capture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import spatial
from plumbline.plans import reports, segmentation
from plumbline.storage import shared_folder


def test_segments_become_one_primitive(spark):
    pixels = spark.range(2 * 12 * 12).select("id", F.floor(F.col("id") / 144).alias("t"), F.floor((F.col("id") % 144) / 12).cast("int").alias("y"), (F.col("id") % 12).cast("int").alias("x"))
    points = pixels.select("*", F.lit(0).alias("cluster"), (F.col("x") * 0.1).alias("wx"), (F.col("y") * 0.1).alias("wy"), F.lit(2.0).alias("wz"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(2.0).alias("depth"))
    flow = pixels.filter("t = 0").select(F.lit(0).cast("long").alias("fi"), F.lit(1).cast("long").alias("fj"), "y", "x", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    found = segmentation.segment_primitives(points, flow, 12, 12, shared_folder(spark), eps=1.5, min_samples=3, least=50, least_frames=2).collect()
    assert len(found) == 1 and abs(found[0]["t"][2] - 2) < 1e-6 and np.allclose(sorted(np.exp(found[0]["s_log"])), [0.02, 0.55, 0.55], atol=0.03)


def test_reports(spark):
    body = spark.range(60).select(F.col("id").alias("t"), F.lit(1).alias("v"), F.when(F.col("id") < 30, 0.0).otherwise((F.col("id") - 30) * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    parts = spark.createDataFrame([("hand", 1)], "part string, v int")
    run = reports.part_motion(body, parts).collect()
    assert [(r["part"], r["start"]) for r in run] == [("hand", 0)] and 28 <= run[0]["end"] <= 32
    cloud = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, x array<double>")
    scores = {r["metric"]: r["value"] for r in reports.reconstruction_scores(cloud, cloud).collect()}
    assert scores["chamfer_l2"] == 0 and scores["fscore"] == 100
    labels = spark.createDataFrame([(i // 4, i // 4) for i in range(12)], "gt int, pred int")
    one = reports.segmentation_scores(labels, "gt", "pred").first()
    assert one["rand_index"] == 1 and one["voi"] == 0 and one["covering"] == 1


def test_poses_between_knots(spark):
    pose = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    knots = spark.createDataFrame([(0, 0.0, pose(0.0)), (0, 2.0, pose(4.0))], "k int, s double, m array<double>")
    asked = spark.createDataFrame([(0, s) for s in (-1.0, 0.5, 2.0, 9.0)], "k int, s double")
    got = spatial.interpolate_poses(asked, knots, ["k"], "s", "m").orderBy("s").collect()
    assert np.allclose([r["m"][3] for r in got], [0, 1, 4, 4])
