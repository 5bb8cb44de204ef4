"""Relational operators on worked cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, blocks, cluster, graph, mesh, numbering, pixels, primitives, sampling, sequence, spatial
from plumbline.storage import shared_folder, stored


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs_and_stability(spark):
    flags = spark.createDataFrame([(0, t, c == "1") for t, c in enumerate("111011111000")], "v int, t int, f boolean")
    assert table(sequence.runs(flags, "f", ["v"], ["t"], 5), "start", "end") == [(4, 9)]
    flags = spark.createDataFrame([(0, t, c == "1") for t, c in enumerate("0110111100")], "v int, t int, f boolean")
    assert [r[0] for r in table(sequence.keep_stable(flags, "f", ["v"], ["t"], 3).filter("stable"), "t")] == [4, 5, 6, 7]


@pytest.mark.parametrize(("counts", "fallback", "frame"), [((0, 2, 5, 5, 1), "start", 2), ((0, 0, 0), "start", 0), ((0, 0, 0), "middle", 1), ((0, 0, 0), "end", 2), ((0, 0, 0), "none", None)])
def test_best_frame(spark, counts, fallback, frame):
    segments = spark.createDataFrame([(0, len(counts))], "start long, end long")
    n = spark.createDataFrame(list(enumerate(counts)), "t long, n long")
    assert sequence.best_frames(segments, n, fallback=fallback).first()["frame"] == frame


def test_smoothing(spark):
    df = spark.createDataFrame([(0, t, float(t * t)) for t in range(9)], "k int, t int, v double")
    assert all(abs(r["smooth"] - r["v"]) < 1e-9 for r in sequence.savitzky_golay(df, "v", ["k"], ["t"]).collect())
    flat = df.withColumn("v", F.lit(3.0))
    assert all(abs(r["smooth"] - 3) < 1e-9 for r in sequence.gaussian_smooth(flat, "v", ["k"], ["t"]).collect())
    moved = sequence.centroid_motion(spark.createDataFrame([(t, float(t), 0.0, 0.0) for t in range(4)], "t int, x double, y double, z double"), [], "t")
    assert [r["speed"] for r in moved.orderBy("t").collect()] == [0, 1, 1, 1]
    still = sequence.static_flags(moved, [], "t", speed=2.0, change=2.0)
    assert still.filter("static").count() == 4


def test_contacts(spark):
    scores = spark.createDataFrame([(t, v, 0.9 if 2 <= t <= 6 and v < 3 else 0.1) for t in range(10) for v in range(5)], "t long, v long, score double")
    parts = spark.createDataFrame([(("hand", "leg")[v % 2], v) for v in range(5)], "part string, v long")
    segments = spark.createDataFrame([(0, 10), (8, 10)], "start long, end long")
    got = {r["start"]: (r["frame"], r["n"]) for r in sequence.contact_frames(scores, parts, segments, weights={"hand": 2.0}, least=3).collect()}
    assert got == {0: (2, 5.0), 8: (9, 0.0)}


def test_components_and_numbers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(200)], "a long, b long")
    nodes = spark.range(400).select(F.col("id").alias("node"))
    found = dict(graph.component_labels(nodes, edges, shared_folder(spark)).collect())
    assert found[3] == 1 and found[11] == 10 and found[300] == 100 and found[7] == 7 and found[350] == 350
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r["k"] == r["number"] for r in numbering.numbered(df, ["k"]).collect())


def test_global_segments(spark):
    segments = spark.createDataFrame([(0, 1), (0, 4), (1, 2), (2, 3)], "frame long, seg long")
    edges = spark.createDataFrame([(0, 1, 1, 2), (1, 2, 2, 3)], "fi long, si long, fj long, sj long")
    assert cluster.global_segments(segments, edges, shared_folder(spark)).select("gid").distinct().count() == 2


def test_matching_folds(spark):
    scores = spark.createDataFrame([(0, "A", "X", 0.9), (0, "A", "Y", 0.8), (0, "B", "X", 0.7), (0, "B", "Y", 0.1)], "g int, l string, r string, score double")
    assert table(sampling.greedy_matching(scores, ["g"], "l", "r"), "l", "r") == [("A", "X"), ("B", "Y")]
    best = spatial.hungarian(scores.select(F.col("g").alias("group"), F.col("l").alias("row"), F.col("r").alias("col"), (1 - F.col("score")).alias("cost")))
    assert table(best, "row", "col") == [("A", "Y"), ("B", "X")]
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0, 2.0, 0.9), (0, 1, 0.1, 0.0, 2.0, 2.0, 0.8), (0, 2, 5.0, 5.0, 6.0, 6.0, 0.1)], "g int, id int, x0 double, y0 double, x1 double, y1 double, score double")
    assert table(sampling.suppress_overlaps(boxes, ["g"]), "id") == [(0,), (2,)]
    line = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(10)], "g int, id int, x double, y double, z double")
    assert table(sampling.farthest_points(line, ["g"], 3), "id") == [(0,), (4,), (9,)]
    assert table(sampling.thinned(line, ["g"], 2.5), "id") == [(0,), (3,), (6,), (9,)]


def test_assignment_is_least():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.random((4, 5))
        pick = spatial.shortest_augmenting(c)
        assert abs(sum(c[i, j] for i, j in enumerate(pick)) - min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))) < 1e-12


def test_planes(spark):
    flat = spark.createDataFrame([(0, i, float(i % 5), float(i // 5), 2.0) for i in range(25)], "g int, id int, x double, y double, z double")
    r = aggregates.plane_by_moments(flat, ["g"]).first()
    assert abs(abs(r["c"]) - 1) < 1e-9 and abs(r["d"] + 2 * r["c"]) < 1e-9
    p = aggregates.plane_by_least_squares(flat, ["g"]).first()["p"]
    assert np.allclose(p, [0, 0, 0.5])
    noisy = flat.unionByName(spark.createDataFrame([(0, 100 + i, float(i), 1.0, 9.0 + i) for i in range(6)], flat.schema))
    best = cluster.ransac_plane(noisy, ["g"], iterations=60, threshold=0.01).first()
    assert best["inliers"] == 25 and abs(abs(best["plane"][2]) - 1) < 1e-9
    few = flat.filter("id < 2").selectExpr("1 AS g", "id", "x", "y", "z").unionByName(flat.selectExpr("2 AS g", "id", "x", "y", "z").filter("id IN (0, 1, 7)"))
    assert [(r["g"], r["inliers"]) for r in cluster.ransac_plane(few, ["g"], iterations=3).collect()] == [(2, 3)]
    found = cluster.sequential_planes(noisy.select("id", "x", "y", "z"), shared_folder(spark), most=2, least=20, voxel=1.5, iterations=40)
    assert found.filter("plane_id = 0").count() == 25


def test_dbscan(spark):
    points = [(i, float(i), 0.0) for i in range(6)] + [(10, 20.0, 0.0), (11, 6.1, 0.9)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["id"]: (r["core"], r["cluster"]) for r in cluster.dbscan(df, ["x", "y"], 1.5, 3, shared_folder(spark)).collect()}
    assert got[10] == (False, None) and got[11] == (False, 1) and got[0] == (False, 1) and got[3] == (True, 1)
    merged = cluster.merged_directions({0: [1, 0, 0], 1: [0.99, 0.05, 0], 2: [0, 1, 0]}, {0: 5, 1: 4, 2: 7}, 0.95)
    assert merged == {0: 0, 1: 0, 2: 1}


def test_spatial(spark):
    r = random.Random(0)
    a = [(i, r.random() * 10, r.random() * 10, r.random() * 10) for i in range(200)]
    b = [(i, r.random() * 10, r.random() * 10, r.random() * 10) for i in range(80)]
    left = spark.createDataFrame(a, "query_id long, x double, y double, z double")
    right = spark.createDataFrame(b, "point_id long, x double, y double, z double")
    d = np.sqrt(((np.array(a)[:, None, 1:] - np.array(b)[None, :, 1:]) ** 2).sum(-1))
    pairs = spatial.radius_join(left, right, ["x", "y", "z"], 1.5, salts=3)
    assert set(table(pairs, "query_id", "point_id")) == {(i, j) for i, j in zip(*np.nonzero(d <= 1.5), strict=True)}
    got = {r["query_id"]: r["point_id"] for r in spatial.nearest_by_grid(left, right, ["x", "y", "z"], 0.5).collect()}
    assert [got[i] for i in range(200)] == d.argmin(axis=1).tolist()
    capped = spatial.nearest_by_grid(left, right, ["x", "y", "z"], 0.5, most=1.0).collect()
    assert {r["query_id"] for r in capped if r["point_id"] is None} == set(np.flatnonzero(d.min(axis=1) > 1.0).tolist())
    vec = lambda df, key: df.select(F.col(key).alias("id"), F.array("x", "y", "z").alias("x"))
    near = {r["query_id"]: r["point_id"] for r in blocks.nearest(vec(left, "query_id"), vec(right, "point_id")).collect()}
    assert near == got
    same = spatial.geometry_metrics(vec(left, "query_id"), vec(left, "query_id"), 0.1).first()
    assert same["chamfer"] == 0 and same["fscore"] == 100
    far = spatial.geometry_metrics(vec(left, "query_id"), vec(left, "query_id").select("id", F.transform("x", lambda v: v + 100).alias("x")), 0.1).first()
    assert far["precision"] == 0 and far["fscore"] is None


def test_pixels(spark):
    block = spark.createDataFrame([(0, y, x, 2.0 if y == x == 2 else 1.0, False, 1.0) for y in range(3) for x in range(3)], "t int, y int, x int, depth double, mask boolean, conf double")
    edges = {(r["y"], r["x"]): r["edge"] for r in pixels.depth_edge(block).collect()}
    assert edges[(1, 1)] and not edges[(0, 0)]
    kinds = pixels.classified(block, radius=1, quantile=0.99).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"dropped": 4, "background": 5}
    slope = spark.createDataFrame([(0, y, x, float(x), float(y), 5.0) for y in range(3) for x in range(3)], "t int, y int, x int, px double, py double, pz double")
    n = pixels.normals_from_points(slope).filter("y = 1 AND x = 1").first()
    assert np.allclose(np.abs([n["nx"], n["ny"], n["nz"]]), [0, 0, 1])
    assert pixels.normals_edge(pixels.normals_from_points(slope), 0.1).filter("edge").count() == 0
    k, eye = F.array(*map(F.lit, (1.0, 0.0, 1.5, 0.0, 1.0, 1.5, 0.0, 0.0, 1.0))), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    world = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (9.0, 0.0, 1.0)], "x double, y double, z double")
    assert table(pixels.projected(world, k, eye, 3, 3), "px", "py") == [(1, 1)]
    assert pixels.unmasked_by_projection(block, world, k, eye, 3, 3, 1).count() == 4
    mask = spark.createDataFrame([(0, y, x, (y, x) in {(0, 0), (1, 1), (4, 4)}) for y in range(5) for x in range(5)], "t int, y int, x int, mask boolean")
    assert pixels.components_of_mask(mask, shared_folder(spark)).select("component").distinct().count() == 2
    cams = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [float(i % 5 == 0) for i in range(16)])], "t int, k array<double>, c2w array<double>")
    p = pixels.back_projected(block, cams).filter("y = 1 AND x = 2").first()
    assert (p["wx"], p["wy"], p["wz"]) == (2.5, 1.5, 1.0)
    images = spark.createDataFrame([(1, [(0.5, 0.5), (2.0, 2.0)], [7, -1])], "id int, xys array<struct<x: double, y: double>>, point3d_ids array<long>")
    labels = spark.createDataFrame([(1, 0, 0, 3)], "image_id int, y int, x int, seg int")
    assert table(pixels.keypoint_segments(images, spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "id long, xyz array<double>"), labels), "seg", "point_id") == [(3, 7)]


def test_mesh(spark):
    v, f = mesh.cube(spark)
    normals = mesh.face_normals(f, v)
    assert normals.count() == 12
    outward = mesh.corners(f, v).join(normals.select("fid", "normal"), "fid").collect()
    assert all(np.dot(np.mean([r["p0"], r["p1"], r["p2"]], axis=0), r["normal"]) > 0 for r in outward)
    edges, neighbours = mesh.mesh_relations(f)
    assert edges.count() == 18 and neighbours.filter("neighbour >= 0").count() == 36
    angles = mesh.face_angles(f, v).select(F.aggregate("angles", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r["s"] - math.pi) < 1e-9 for r in angles)
    for weighted in (False, True):
        assert all(abs(np.linalg.norm(r["normal"]) - 1) < 1e-9 for r in mesh.vertex_normals(f, v, weighted).collect())
    s, t = mesh.icosphere(spark, 1)
    assert s.count() == 42 and t.count() == 80
    assert all(abs(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2 - 1) < 1e-9 for r in s.collect())
    assert mesh.normal_consistency(t, s).first()[0] < 0.2
    doubled, faces = mesh.concatenated(v.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b")))), f.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b")))))
    assert doubled.count() == 16 and faces.agg(F.max("v0")).first()[0] >= 8
    merged, kept = mesh.merge_duplicates(doubled, faces)
    assert merged.count() == 8 and kept.count() == 24 and mesh.drop_degenerate(kept).count() == 24
    less, renumbered = mesh.drop_unreferenced(v, f.filter("fid < 2"))
    assert less.count() == 4 and renumbered.agg(F.max(F.greatest("v0", "v1", "v2"))).first()[0] == 3
    broken = v.withColumn("x", F.when(F.col("vid") == 0, float("nan")).otherwise(F.col("x")))
    assert mesh.drop_nonfinite(broken, f)[0].count() == 7
    fans = mesh.triangulate(spark.createDataFrame([(0, [0, 1, 2, 3, 4]), (1, [5, 6])], "fid long, vs array<long>"))
    assert table(fans, "v0", "v1", "v2") == [(0, 1, 2), (0, 2, 3), (0, 3, 4)]
    assert mesh.grid_faces(spark, 3, 4).count() == 6 and mesh.grid_faces(spark, 3, 4, tri=True).count() == 12
    quads = mesh.quad_candidates(f)
    assert quads.count() == 18
    flat = mesh.quad_distortion(quads, v).orderBy("distortion").limit(6).collect()
    assert all(r["distortion"] < 1e-9 for r in flat)
    assert mesh.smooth_taubin(f, v, shared_folder(spark)).count() == 8 and mesh.smooth_hc(f, v, shared_folder(spark), times=1).count() == 8
    cot = mesh.laplacian(t, s, "cotangent").join(s, "vid").select(F.max(F.abs(F.col("mx") - F.col("x")))).first()[0]
    assert cot < 0.3
    planes = spark.createDataFrame([(1, [0.0, 0.0, 1.0, -2.0])], "plane_id int, plane array<double>")
    moved = mesh.planarize(spark.createDataFrame([(1, 1.0, 1.0, 5.0)], "plane_id int, x double, y double, z double"), planes).first()
    assert moved["z"] == 2.0 and mesh.normalized(v).agg(F.max("x")).first()[0] == 1.0


def test_primitives(spark):
    square = np.array([[0, 0], [2, 0], [2, 1], [0, 1], [1, 0.5]], float)
    assert len(primitives.convex_hull(square)) == 4 and primitives.polygon_area(primitives.convex_hull(square)) == 2
    turn = np.array([[math.cos(0.3), -math.sin(0.3)], [math.sin(0.3), math.cos(0.3)]])
    angle, center, sides, area = primitives.min_area_rectangle(square @ turn.T)
    assert abs(area - 2) < 1e-9 and np.allclose(center, turn @ [1, 0.5]) and np.allclose(sorted(sides), [1, 2])
    rng = np.random.default_rng(0)
    r, t, half = primitives.minimal_box(rng.uniform(-1, 1, (400, 3)) * [1, 2, 3])
    assert np.allclose(sorted(half), [1, 2, 3], atol=0.1) and abs(np.linalg.det(r) - 1) < 1e-9
    rows = [(7, i % 2, i, float(x), float(y), 0.001 * float(z), 10.0, 20.0, 30.0) for i, (x, y, z) in enumerate(rng.uniform(0, 1, (300, 3)) * [2, 1, 1])]
    df = spark.createDataFrame(rows, "gid long, frame int, id long, x double, y double, z double, r double, g double, b double")
    fit = primitives.fit_primitives(df, iterations=50).collect()
    assert fit and np.allclose(sorted(np.exp(fit[0]["s_log"]))[1:], [0.5, 1.0], atol=0.06) and fit[0]["color"] == [10, 20, 30]
    assert primitives.fit_primitives(df, least_frames=3).count() == 0
    one = primitives.united(primitives.fit_primitives(df, iterations=20), primitives.fit_primitives(df, iterations=20))
    assert one.count() == 2
    folded = primitives.merge_first_match(spark.createDataFrame([(0, 1, [0.0, 0.0, 1.0], [0.0, 0.0, 0.0], 1.0), (0, 2, [0.0, 0.0, -1.0], [5.0, 0.0, 0.01], 1.0), (0, 3, [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1.0)], "k int, id long, n array<double>, c array<double>, area double"), "k")
    assert table(folded, "id", "into") == [(1, 1), (2, 1), (3, 3)]
    mask = np.zeros((6, 7), bool)
    mask[1:5, 1:6] = True
    mask[2:4, 2:4] = False
    rings = primitives.trace_outline(mask)
    assert len(rings) == 2 and {primitives.is_clockwise(r) for r in rings} == {True, False}
    filled = primitives.fill_polygon(rings[0], 6, 7) ^ primitives.fill_polygon(rings[1], 6, 7)
    assert (filled == mask).all()
    shape = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "mask_id long, y int, x int")
    polygons = primitives.mask_polygons(shape)
    assert polygons.filter("hole").count() == 1
    assert primitives.polygon_pixels(polygons.filter("NOT hole"), 6, 7).count() == 20
    cloud = rng.uniform(0, 5, (40, 3))
    pairs = [(1, "a", *map(float, p)) for p in cloud] + [(1, "b", *map(float, p + 0.05)) for p in cloud]
    found = primitives.gradient_icp(spark.createDataFrame(pairs, "gid long, side string, x double, y double, z double")).first()
    assert found["error"] < 1e-6 and np.allclose(found["t"], 0.05, atol=1e-6)
    sq = spark.createDataFrame([(7, [0.0, 0.0, 0.0], [float(i % 4 == 0) for i in range(9)], [0.0, 0.0, 0.0], [1.0, 1.0])], "gid long, s_log array<double>, r array<double>, t array<double>, eps array<double>")
    shell = spark.createDataFrame([(7, *map(float, 1.3 * p / np.linalg.norm(p))) for p in rng.normal(size=(200, 3))], "gid long, x double, y double, z double")
    still, better = primitives.refine_superquadrics(shell, sq).first(), primitives.refine_superquadrics(shell, sq, steps=60, rate=0.05).first()
    assert still["s_log"] == [0, 0, 0] and better["loss"] < 0.01 * still["loss"]
    near = spark.createDataFrame([(0, *map(float, p)) for p in rng.uniform(0, 1, (30, 3)) * [1, 1, 0]], "id long, x double, y double, z double")
    assert np.allclose(np.abs(primitives.normals_by_neighbours(near).first()["normal"]), [0, 0, 1])
    reduced = primitives.reduce_components(spark.createDataFrame([(0, 1, 1.0, [0.0, 0.0, 0.0], [[0.0, 0.0, 0.0]]), (0, 2, 3.0, [4.0, 4.0, 4.0], [[1.0, 2.0, 3.0]])], "component long, id long, area double, color array<double>, corners array<array<double>>")).first()
    assert reduced["color"] == [3, 3, 3] and reduced["high"] == [1, 2, 3]
    assert primitives.plane_surfaces(near.select(F.lit(1).cast("long").alias("plane_id"), "x", "y", "z", F.array(*map(F.lit, (0.0, 0.0, 1.0, 0.0))).alias("plane")), 0.5).count() == 8


def test_sampling(spark):
    weights = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "g int, item long, w double")
    draws = sampling.inverse_cdf_samples(weights, ["g"], "item", "w", 2000).groupBy("item").count().collect()
    share = {r["item"]: r["count"] / 2000 for r in draws}
    assert sum(share.values()) == 1 and all(abs(share[i] - i / 10) < 0.05 for i in range(1, 5)) and 0 not in share
    df = spark.range(100)
    assert table(sampling.subsample(df, "id", 10), "id") == table(sampling.subsample(df.repartition(7), "id", 10), "id")
    rays = spark.createDataFrame([(1,)], "ray long")
    z = [r["z"] for r in sampling.bin_samples(rays, F.lit(1.0), F.lit(3.0), 4).orderBy("bin").collect()]
    assert z == [1.25, 1.75, 2.25, 2.75]
    planes = spark.createDataFrame([(1, 5.0, 0.1, 10), (2, 1.0, 0.1, 90), (3, 4.0, 0.5, 5)], "id long, area double, error double, n long")
    assert table(sampling.select_planes(planes, 2), "id") == [(1,), (3,)] and table(sampling.select_planes(planes, 1, strategy="count"), "id") == [(2,)]
    masks = spark.createDataFrame([(1, 1, 50, 0.9, 0.95), (1, 2, 20, 0.9, 0.95), (1, 3, 5, 0.1, 0.95)], "prompt int, mask_id int, area int, iou double, stability double")
    assert table(sampling.smallest_good(masks, ["prompt"]), "mask_id") == [(2,)]


def test_components_send_no_table_through_the_driver(spark, tmp_path):
    """A small file of many edges isn't broadcast: what a node's least neighbour is grows with the graph."""
    path = str(tmp_path / "edges")
    spark.range(2000).select(F.col("id").alias("u"), (F.col("id") % 3 + 5000).alias("v")).write.parquet(path)
    plan = graph._with_least(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    found = cluster.connected_components(spark.read.parquet(path).toDF("a", "b"), f"file://{tmp_path}/work")
    assert {(r["node"], r["root"]) for r in found.collect()} == {(n, n % 3) for n in range(2000)} | {(5000 + k, k) for k in range(3)}


def test_nearest_in_a_crowded_cell_makes_no_pairs(spark, monkeypatch):
    """Places of one cell and their copies are searched by blocks, not joined with all queries of the cell."""
    monkeypatch.setattr(spatial, "radius_join", None)
    rng = random.Random(4)
    p = [(i, rng.random(), rng.random()) for i in range(1500)]
    q = [(i, rng.random(), rng.random()) for i in range(700)]
    points = spark.createDataFrame(p + [(i + 5000, x, y) for i, x, y in p] + [(9999, None, 0.5)], "point_id long, x double, y double")
    queries = spark.createDataFrame(q + [(i + 1000, x, y) for i, x, y in q] + [(3000, None, 0.5)], "query_id long, x double, y double")
    got = {r["query_id"]: r["point_id"] for r in spatial.nearest_by_grid(queries, points, ["x", "y"], 2.0).collect()}
    want = {i: min(p, key=lambda r: (math.hypot(r[1] - x, r[2] - y), r[0]))[0] for i, x, y in q}
    assert got == want | {i + 1000: v for i, v in want.items()} | {3000: None}


def test_copies_of_a_place_make_no_pairs(spark, tmp_path):
    """Clusters of many copies: pairs are of places, and labels those of all points."""
    spots = [(0.0, 0.0), (1.0, 0.0), (2.5, 0.0), (9.0, 9.0)]
    rows = [(4 * i + k, x, y) for i in range(100) for k, (x, y) in enumerate(spots)] + [(1000, None, 1.0), (1001, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    folder = f"file://{tmp_path}/dbscan"
    got = {r["id"]: (r["core"], r["cluster"]) for r in cluster.dbscan(points, ["x", "y"], 1.5, 150, folder).collect()}
    assert spark.read.parquet(f"{folder}/pairs").count() == 8
    assert got == {4 * i + k: (k < 3, 0 if k < 3 else None) for i in range(100) for k in range(4)} | {1000: (False, None), 1001: (False, None)}
    whole = {r["node"]: r["component"] for r in cluster.eps_components(points, ["x", "y"], 1.5, f"file://{tmp_path}/eps").collect()}
    assert whole == {4 * i + k: 0 if k < 3 else 3 for i in range(100) for k in range(4)} | {1000: 1000, 1001: 1001}


def test_chamfer_both_ways_searches_once_each_way(spark, monkeypatch):
    points = lambda xs: spark.createDataFrame([(i, [x]) for i, x in enumerate(xs)], "id long, x array<double>")
    seen, search = [], blocks.nearest
    monkeypatch.setattr(blocks, "nearest", lambda *a, **o: seen.append(a) or search(*a, **o))
    got = spatial.chamfer_l1_l2(points([0.0, 4.0]), points([1.0])).first()
    assert (got["forward"], got["backward"], got["chamfer"], got["l2"]) == (2.0, 1.0, 3.0, 6.0) and len(seen) == 2


def test_edges_that_form_stars_take_no_round(spark, tmp_path, monkeypatch):
    """Rounds end with stars, not with a round that changes nothing; a round has few joins."""
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, folder, name: written.append((name, df)) or stored(df, folder, name))
    stars = spark.createDataFrame([(1, k) for k in range(2, 40)] + [(50, 41), (None, 3), (60, 60)], "a long, b long")
    found = graph.connected_components(stars, f"file://{tmp_path}/stars").collect()
    assert sorted(tuple(r) for r in found) == sorted([(k, 1) for k in range(1, 40)] + [(41, 41), (50, 41)])
    assert [n for n, _ in written] == ["edges-0"]
    written.clear()
    path = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    assert sorted(tuple(r) for r in graph.connected_components(path, f"file://{tmp_path}/path").collect()) == [(k, 0) for k in range(31)]
    assert written[1][1]._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3


def test_instances_are_counted_without_sorting_them(spark):
    """One instance may hold most pixels, so none is a window's partition; null clusters are one too."""
    one = spark.createDataFrame([(0, y, 0, None if y < 3 else "c") for y in range(10)], "t int, y int, x int, cluster string")
    other = spark.createDataFrame([(0, y, 0, "m" if y < 7 else "n") for y in range(10)], "t int, y int, x int, mask string")
    found = cluster.mask_instances(one, other, 3)
    assert found.columns == ["t", "y", "x", "cluster", "mask"] and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["y"] for r in found.collect()) == list(range(10))
    assert sorted(r["y"] for r in cluster.mask_instances(one, other, 4).collect()) == [3, 4, 5, 6]


def test_face_angles_are_generated_code(spark):
    """No lambda over each face; a face of a side without length keeps angles of 0."""
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 2.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    angles = mesh.face_angles(spark.createDataFrame([(1, 0, 1, 2), (2, 0, 3, 1), (3, 0, 1, 4)], "fid long, v0 long, v1 long, v2 long"), v)
    assert "lambda" not in angles._jdf.queryExecution().optimizedPlan().toString()
    got = {r["fid"]: r["angles"] for r in angles.collect()}
    assert np.allclose([got[k] for k in (1, 2, 3)], [[math.pi / 2, math.pi / 4, math.pi / 4], [0, 0, 0], [0, math.pi, 0]])


def test_a_hull_makes_no_array_for_each_point(monkeypatch):
    class Whole(np.ndarray):
        def __iter__(self):
            raise AssertionError("iterated point by point")

    unique = np.unique
    monkeypatch.setattr(primitives.np, "unique", lambda *a, **k: unique(*a, **k).view(Whole))
    p = np.random.default_rng(9).random((500, 2))
    hull = primitives.convex_hull(np.concatenate([p, [[-1.0, -1.0], [2.0, -1.0], [2.0, 2.0], [-1.0, 2.0], [0.5, -1.0]]]))
    assert hull.tolist() == [[-1.0, -1.0], [2.0, -1.0], [2.0, 2.0], [-1.0, 2.0]]


def test_variance_equal_to_the_bound_is_not_below_it(spark):
    """Discounts of variance 0.001, which doubles put on either side of it by the order of additions."""
    equal = [2, 9, 1, 8, 10, 8, 7, 2, 3, 3, 8, 1, 4, 0, 9, 9, 5, 5, 8, 3, 7, 8, 4, 8, 2, 9, 4, 8, 2, 7, 1, 1, 7, 1, 1]
    rows = [("odd", v) for v in (1e9, 1e9 + 0.01, None)] + [("one", 0.5), ("none", None), ("nan", float("nan")), ("nan", 0.1)]
    rows += [("tiny", v) for v in (1e-7, 3e-7)] + [("wide", v) for v in (0.0, 0.1)] + [("near", v) for v in (0.0, 0.0447)]
    for seed in range(8):
        rows += [(f"equal-{seed}", v / 100) for v in random.Random(seed).sample(equal, len(equal))]
    df = spark.createDataFrame([(g, 1, v) for g, v in rows], "seg string, proto int, x double").coalesce(1)
    found = {r["seg"]: r["variance"] for r in aggregates.segment_modes(df, ["seg"], "proto", "x").collect()}
    assert found.keys() == {"odd", "one", "none", "tiny", "near"}
    assert found["one"] == found["none"] == 0.0 and found["near"] == pytest.approx(0.0447**2 / 2) and found["tiny"] == pytest.approx(2e-14)


def test_crowded_cells_make_no_pairs(spark, tmp_path):
    """Distinct places, crowded within the radius: stored pairs grow with the places, and labels are those of all pairs."""
    rng = random.Random(3)
    blob = [(0, rng.gauss(0, 0.002), rng.gauss(0, 0.002)) for _ in range(300)]
    ring = lambda g, r, n: [(g, r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    spots = blob + ring(0, 10.01, 300) + [(0, 19.0, 3.0), (0, 28.5, 3.0)] + ring(None, 4.0, 80) + ring(None, 13.9, 80) + [(None, 50.0, 50.0)]
    ids = rng.sample(range(5000), len(spots))
    folder = f"file://{tmp_path}/dbscan"
    rows = [(i, *s) for i, s in zip(ids, spots, strict=True)]
    df = spark.createDataFrame([*rows, (9000, 0, None, 1.0), (9001, 0, float("nan"), 1.0)], "id long, g int, x double, y double")
    got = {r["id"]: (r["core"], r["cluster"]) for r in cluster.dbscan(df, ["x", "y"], 10.0, 20, folder, by=["g"]).collect()}
    near = {a: [b for b, h, u, v in rows if h == g and (u - x) * (u - x) + (v - y) * (v - y) <= 100.0] for a, g, x, y in rows}
    core, name = {a for a, n in near.items() if len(n) >= 20}, {}
    for a in sorted(core):
        todo = [] if a in name else [a]
        while todo:
            b = todo.pop()
            if b not in name:
                name[b] = a
                todo += [c for c in near[b] if c in core]
    want = {a: (a in core, name[a] if a in core else min((name[b] for b in n if b in core), default=None)) for a, n in near.items()}
    assert got == want | {9000: (False, None), 9001: (False, None)} and len(set(name.values())) == 3
    assert spark.read.parquet(f"{folder}/pairs").count() < 4 * len(rows) < sum(map(len, near.values())) / 20
