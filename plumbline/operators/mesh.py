"""Meshes as tables ``vertices(vid, x, y, z)`` and ``faces(fid, v0, v1, v2)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import linalg as L
from plumbline.operators.numbering import numbered
from plumbline.storage import stored

_POINT = ["x", "y", "z"]


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their corners' positions p0, p1, p2."""
    out = faces
    for i in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{i}"), L.pack([F.col(c) for c in _POINT]).alias(f"p{i}")), f"v{i}")
    return out


def face_normals(faces: DataFrame, vertices: DataFrame, unit: bool = True) -> DataFrame:
    n = L.cross(L.sub("p1", "p0"), L.sub("p2", "p0"))
    return corners(faces, vertices).select("fid", "v0", "v1", "v2", (L.normalize(n) if unit else n).alias("normal"))


def face_angles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Inner angles at v0, v1, v2; 0 where a side has no length.

    Sides are columns of plain numbers, made once for all three angles, so that generated code does it all.
    """
    corner = lambda i, k: F.get(f"p{i % 3}", F.lit(k))
    sides = corners(faces, vertices).select("fid", "v0", "v1", "v2", *((corner(i + 1, k) - corner(i, k)).alias(f"s{i}{k}") for i in range(3) for k in range(3)))
    side = lambda i: [F.col(f"s{i % 3}{k}") for k in range(3)]
    sized = sides.select("*", *(F.nullif(L.norm(side(i)), F.lit(0.0)).alias(f"l{i}") for i in range(3)))

    def angle(i: int):
        cosine = -L.dot(side(i), side(i + 2)) / F.col(f"l{i}") / F.col(f"l{(i + 2) % 3}")
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

    return sized.select("fid", "v0", "v1", "v2", F.array(*(angle(i) for i in range(3))).alias("angles"))


def vertex_normals(faces: DataFrame, vertices: DataFrame, weighted: bool = False) -> DataFrame:
    """Unit normals of vertices: the sum of unit normals of their faces, weighted by the face's angle if asked for."""
    each = face_normals(faces, vertices)
    each = each.join(face_angles(faces, vertices).select("fid", "angles"), "fid") if weighted else each.withColumn("angles", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    spread = each.select("normal", F.explode(F.arrays_zip(F.array("v0", "v1", "v2").alias("v"), F.col("angles").alias("a"))).alias("c"))
    spread = spread.select(F.col("c.v").alias("vid"), *((F.get("normal", F.lit(i)) * F.col("c.a")).alias(c) for i, c in enumerate(_POINT)))
    sums = spread.groupBy("vid").agg(*(F.sum(c).alias(c) for c in _POINT))
    return sums.select("vid", L.normalize([F.col(c) for c in _POINT]).alias("normal"))


def half_edges(faces: DataFrame) -> DataFrame:
    """Each face's three directed edges, with the corner across."""
    steps = F.array(*(F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b"), F.col(f"v{(i + 2) % 3}").alias("across"), F.lit(i).alias("side")) for i in range(3)))
    return faces.select("fid", F.explode(steps).alias("e")).select("fid", "e.*")


def mesh_relations(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (eid, a < b, faces: at most two) and face neighbours (fid, side, neighbour or -1); ids in order of (a, b)."""
    sides = half_edges(faces).select("fid", "side", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = sides.groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_set("fid")), 1, 2).alias("faces"))
    edges = numbered(edges, ["a", "b"], "eid")
    joined = sides.join(edges, ["a", "b"])
    other = F.filter("faces", lambda f: f != F.col("fid"))
    return edges, joined.select("fid", "side", "eid", F.coalesce(F.get(other, F.lit(0)), F.lit(-1).cast("long")).alias("neighbour"))


def laplacian(faces: DataFrame, vertices: DataFrame, weight: str = "uniform") -> DataFrame:
    """Mean of a vertex's neighbours, uniform or cotangent weights: (vid, mx, my, mz)."""
    edges = half_edges(faces)
    if weight == "uniform":
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("w", F.lit(1.0))
    else:
        angles = face_angles(faces, vertices).select("fid", "angles")
        cot = edges.join(angles, "fid").select("a", "b", (1 / F.tan(F.get("angles", F.pmod(F.col("side") + 2, F.lit(3))))).alias("w"))
        pairs = cot.unionByName(cot.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    joined = pairs.join(vertices.withColumnRenamed("vid", "b"), "b")
    sums = joined.groupBy("a").agg(F.sum("w").alias("w"), *(F.sum(F.col(c) * F.col("w")).alias(f"m{c}") for c in _POINT))
    return sums.select(F.col("a").alias("vid"), *(F.try_divide(f"m{c}", "w").alias(f"m{c}") for c in _POINT))


def smooth_laplacian(faces: DataFrame, vertices: DataFrame, folder: str, *, times: int = 5, weight: str = "uniform", factor: float = 1.0) -> DataFrame:
    """Moves vertices by ``factor`` towards their neighbours' mean, ``times`` times; each round is stored."""
    for k in range(times):
        mean = laplacian(faces, vertices, weight)
        moved = vertices.join(mean, "vid", "left")
        vertices = stored(moved.select("vid", *(F.coalesce(F.col(c) + factor * (F.col(f"m{c}") - F.col(c)), F.col(c)).alias(c) for c in _POINT)), folder, f"smooth-{factor}-{k}")
    return vertices


def smooth_taubin(faces: DataFrame, vertices: DataFrame, folder: str, lam: float = 0.5, mu: float = -0.51) -> DataFrame:
    return smooth_laplacian(faces, smooth_laplacian(faces, vertices, f"{folder}/a", times=1, factor=lam), f"{folder}/b", times=1, factor=mu)


def smooth_hc(faces: DataFrame, vertices: DataFrame, folder: str, *, times: int = 5, alpha: float = 0.5, beta: float = 0.5, weight: str = "uniform") -> DataFrame:
    """Laplacian smoothing that pushes back by the mean difference to original and former positions."""
    original = vertices.select("vid", *(F.col(c).alias(f"o{c}") for c in _POINT))
    for k in range(times):
        mean = laplacian(faces, vertices, weight)
        step = vertices.join(mean, "vid").join(original, "vid")
        b = step.select("vid", *(F.col(f"m{c}").alias(f"n{c}") for c in _POINT), *((F.col(f"m{c}") - (alpha * F.col(f"o{c}") + (1 - alpha) * F.col(c))).alias(c) for c in _POINT))
        b = stored(b, folder, f"b-{k}")
        pushed = laplacian(faces, b.select("vid", *_POINT), weight)
        joined = b.join(pushed, "vid")
        vertices = stored(joined.select("vid", *((F.col(f"n{c}") - (beta * F.col(c) + (1 - beta) * F.col(f"m{c}"))).alias(c) for c in _POINT)), folder, f"v-{k}")
    return vertices


def merge_duplicates(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Vertices that round (half to even) to one cell become the one of least id; faces follow."""
    cells = [F.bround(F.col(c) / tolerance) for c in _POINT]
    keyed = vertices.withColumn("_to", F.min("vid").over(W.partitionBy(*cells)))
    return keyed.filter("vid = _to").drop("_to"), _renamed(faces, keyed.select("vid", "_to"))


def _renamed(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    for i in range(3):
        faces = faces.join(mapping.select(F.col("vid").alias(f"v{i}"), F.col("_to").alias(f"_n{i}")), f"v{i}")
    return faces.select("fid", *(F.col(f"_n{i}").alias(f"v{i}") for i in range(3)))


def drop_degenerate(faces: DataFrame) -> DataFrame:
    return faces.filter("v0 != v1 AND v1 != v2 AND v2 != v0")


def drop_unreferenced(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only vertices of faces, numbered anew from 0 in order."""
    used = half_edges(faces).select(F.col("a").alias("vid")).distinct()
    kept = numbered(vertices.join(used, "vid", "left_semi"), ["vid"], "_to")
    return kept.select(F.col("_to").alias("vid"), *_POINT), _renamed(faces, kept.select("vid", "_to"))


def drop_nonfinite(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without vertices that have a null, NaN or infinite coordinate and the faces on them; numbered anew."""
    good = F.lit(True)
    for c in _POINT:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = numbered(vertices.filter(good), ["vid"], "_to")
    return kept.select(F.col("_to").alias("vid"), *_POINT), _renamed(faces, kept.select("vid", "_to"))


def concatenated(parts: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meshes by ``part`` in one: (part, vid, x, y, z) and (part, fid, v0, v1, v2), part ids from 0, offset by the parts before."""
    sizes = parts.groupBy("part").agg((F.max("vid") + 1).alias("n")).join(faces.groupBy("part").agg((F.max("fid") + 1).alias("m")), "part", "left")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    shift = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_v"), F.coalesce(F.sum(F.coalesce("m", F.lit(0))).over(before), F.lit(0)).alias("_f"))
    v = parts.join(shift, "part").select((F.col("vid") + F.col("_v")).alias("vid"), *_POINT)
    f = faces.join(shift, "part").select((F.col("fid") + F.col("_f")).alias("fid"), *((F.col(f"v{i}") + F.col("_v")).alias(f"v{i}") for i in range(3)))
    return v, f


def triangulate(polygons: DataFrame) -> DataFrame:
    """Fans of ``(fid, vs array)``; triangles in order get (fid, part)."""
    n = F.size("vs")
    steps = F.when(n >= 3, F.sequence(F.lit(1), n - 2))
    return polygons.select("fid", "vs", F.explode(steps).alias("i")).select("fid", (F.col("i") - 1).alias("part"), F.get("vs", F.lit(0)).alias("v0"), F.get("vs", F.col("i")).alias("v1"), F.get("vs", F.col("i") + 1).alias("v2"))


def subdivide(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each face into four through its edges' middles; new vertices follow in order of the edge."""
    top = vertices.agg((F.max("vid") + 1).alias("_top"))
    edges, _ = mesh_relations(faces)
    ends = edges.join(vertices.withColumnRenamed("vid", "a"), "a").select("a", "b", "eid", *(F.col(c).alias(f"a{c}") for c in _POINT)).join(vertices.withColumnRenamed("vid", "b"), "b")
    middle = ends.join(top).select("a", "b", (F.col("_top") + F.col("eid")).alias("vid"), *(((F.col(f"a{c}") + F.col(c)) / 2).alias(c) for c in _POINT))
    out = faces
    for i in range(3):
        key = middle.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("vid").alias(f"m{i}"))
        p, q = F.col(f"v{i}"), F.col(f"v{(i + 1) % 3}")
        out = out.join(key, (F.least(p, q) == F.col("_a")) & (F.greatest(p, q) == F.col("_b"))).drop("_a", "_b")
    four = [("v0", "m0", "m2"), ("m0", "v1", "m1"), ("m2", "m1", "v2"), ("m0", "m1", "m2")]
    parts = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate(f))) for k, f in enumerate(four)))
    split = out.select("fid", F.explode(parts).alias("p")).select((F.col("fid") * 4 + F.col("p.k")).alias("fid"), "p.v0", "p.v1", "p.v2")
    return vertices.select("vid", *_POINT).unionByName(middle.select("vid", *_POINT)), split


def planarize(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Points moved onto their plane; ``planes``: (plane_id, plane [n, d]) with unit normals."""
    n = L.entries("plane", 4)
    p = [F.col(c) for c in _POINT]
    away = L.dot(n[:3], p) + n[3]
    return points.join(planes, "plane_id").select("plane_id", *((v - away * k).alias(c) for v, k, c in zip(p, n[:3], _POINT, strict=True)))


def barycentric(samples: DataFrame, faces: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Interpolates a vertex value at ``samples(sample, fid, b0, b1, b2)``."""
    out = samples.join(faces, "fid")
    for i in range(3):
        out = out.join(values.select(F.col("vid").alias(f"v{i}"), F.col(value).alias(f"_x{i}")), f"v{i}")
    return out.select("sample", sum((F.col(f"_x{i}") * F.col(f"b{i}") for i in (1, 2)), F.col("_x0") * F.col("b0")).alias(value))


def face_tangents(faces: DataFrame, vertices: DataFrame, uvs: DataFrame) -> DataFrame:
    """Unit tangent, bitangent and normal of faces; ``uvs``: (fid, uv0, uv1, uv2 arrays)."""
    t = corners(faces, vertices).join(uvs, "fid")
    e1, e2 = L.sub("p1", "p0"), L.sub("p2", "p0")
    (a, b), (c, d) = L.entries(L.sub("uv1", "uv0", 2), 2), L.entries(L.sub("uv2", "uv0", 2), 2)
    area = a * d - b * c
    area = F.when(area != 0, area)
    tangent = L.scale(L.sub(L.scale(e1, d), L.scale(e2, b)), 1 / area)
    bitangent = L.scale(L.sub(L.scale(e2, a), L.scale(e1, c)), 1 / area)
    return t.select("fid", "v0", "v1", "v2", L.normalize(tangent).alias("tangent"), L.normalize(bitangent).alias("bitangent"), L.normalize(L.cross(e1, e2)).alias("normal"))


def normal_consistency(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean of 1 - cosine over faces that share an edge."""
    edges, _ = mesh_relations(faces)
    n = face_normals(faces, vertices).select("fid", "normal")
    pairs = edges.filter(F.size("faces") == 2).select(F.get("faces", F.lit(0)).alias("f0"), F.get("faces", F.lit(1)).alias("f1"))
    joined = pairs.join(n.toDF("f0", "n0"), "f0").join(n.toDF("f1", "n1"), "f1")
    return joined.agg(F.avg(1 - L.dot("n0", "n1")).alias("inconsistency"))


def quad_candidates(faces: DataFrame) -> DataFrame:
    """Quads of two triangles at each inner edge: (eid, q0, q1, q2, q3) around."""
    edges, _ = mesh_relations(faces)
    sides = half_edges(faces).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    inner = edges.filter(F.size("faces") == 2)
    one, two = (sides.select("fid", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("across").alias(c)) for c in ("q1", "q3"))
    f = lambda i: F.get("faces", F.lit(i))
    joined = inner.withColumn("fid", f(0)).join(one, ["fid", "a", "b"]).drop("fid").withColumn("fid", f(1)).join(two, ["fid", "a", "b"])
    return joined.select("eid", F.col("a").alias("q0"), "q1", F.col("b").alias("q2"), "q3")


def _quad_points(quads: DataFrame, vertices: DataFrame) -> DataFrame:
    for i in range(4):
        quads = quads.join(vertices.select(F.col("vid").alias(f"q{i}"), L.pack([F.col(c) for c in _POINT]).alias(f"p{i}")), f"q{i}")
    return quads


def quad_distortion(quads: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean deviation of a quad's angles from a right angle."""

    def off(i: int):
        u = L.normalize(L.sub(f"p{(i + 1) % 4}", f"p{i}"))
        v = L.normalize(L.sub(f"p{(i + 3) % 4}", f"p{i}"))
        return F.abs(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), L.dot(u, v)))) - math.pi / 2)

    return _quad_points(quads, vertices).select("eid", "q0", "q1", "q2", "q3", (sum((off(i) for i in (1, 2, 3)), off(0)) / 4).alias("distortion"))


def quad_direction(quads: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit directions along and across a quad."""
    along = L.normalize(L.sub(L.add("p1", "p2"), L.add("p0", "p3")))
    across = L.normalize(L.sub(L.add("p2", "p3"), L.add("p0", "p1")))
    return _quad_points(quads, vertices).select("eid", along.alias("along"), across.alias("across"))


def tri_to_quad(quads: DataFrame, limit: float = 0.8) -> DataFrame:
    """Pairs triangles greedily: of the quads below ``limit``, one that is the best of both its triangles, round after round.

    ``quads``: (eid, f0, f1, distortion). Replaces the reference's linear program by local optima; a
    face stays in one quad at most.
    """
    import numpy as np
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        keep = []
        for row in pdf.sort_values(["distortion", "eid"]).itertuples():
            free = row.f0 not in taken and row.f1 not in taken
            keep.append((row.eid, free))
            if free:
                taken |= {row.f0, row.f1}
        out = dict(keep)
        return pdf[np.array([out[e] for e in pdf["eid"]], dtype=bool)]

    return quads.filter(F.col("distortion") < limit).groupBy("mesh").applyInPandas(pick, quads.schema)


def grid_faces(spark: SparkSession, height: int, width: int, tri: bool = False) -> DataFrame:
    """Faces of an image grid of vertices y * width + x."""
    cells = spark.range((height - 1) * (width - 1)).select(F.floor(F.col("id") / (width - 1)).cast("long").alias("y"), (F.col("id") % (width - 1)).alias("x"), F.col("id").alias("cell"))
    v = F.col("y") * width + F.col("x")
    quad = F.array(v, v + width, v + width + 1, v + 1)
    out = cells.select(F.col("cell").alias("fid"), quad.alias("vs"))
    if not tri:
        return out
    return triangulate(out).select((F.col("fid") * 2 + F.col("part")).alias("fid"), "v0", "v1", "v2")


def mesh_from_depth(pixels: DataFrame, height: int, width: int, keep: str = "keep") -> tuple[DataFrame, DataFrame]:
    """Vertices (wx, wy, wz of a pixel) and triangles of an image grid on which all corners are kept."""
    vid = F.col("y").cast("long") * width + F.col("x")
    kept = pixels.filter(keep).select(vid.alias("vid"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    faces = grid_faces(pixels.sparkSession, height, width, tri=True)
    for i in range(3):
        faces = faces.join(kept.select(F.col("vid").alias(f"v{i}")), f"v{i}", "left_semi")
    return kept, faces.select("fid", "v0", "v1", "v2")


def _tables(spark: SparkSession, vertices: Sequence, faces: Sequence) -> tuple[DataFrame, DataFrame]:
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(vertices)], "vid long, x double, y double, z double")
    return v, spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(faces)], "fid long, v0 long, v1 long, v2 long")


def cube(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Unit cube about the origin, twelve triangles."""
    points = [(x, y, z) for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return _tables(spark, points, [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))])


def square(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return _tables(spark, [(-0.5, 0.5, 0), (0.5, 0.5, 0), (0.5, -0.5, 0), (-0.5, -0.5, 0)], [(0, 3, 2), (0, 2, 1)])


def icosahedron(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Unit icosahedron: three golden rectangles; faces are the triples at edge distance, turned outwards."""
    g = (1 + 5**0.5) / 2
    base = [(0, a, b * g) for a in (-1, 1) for b in (-1, 1)]
    points = [p for x, y, z in base for p in ((x, y, z), (y, z, x), (z, x, y))]
    near = lambda i, j: abs(sum((a - b) ** 2 for a, b in zip(points[i], points[j], strict=True)) - 4) < 1e-9
    faces = []
    for i in range(12):
        for j in range(i + 1, 12):
            for k in range(j + 1, 12):
                if near(i, j) and near(j, k) and near(i, k):
                    (a, b, c), (d, e, f), (p, q, r) = points[i], points[j], points[k]
                    faces.append((i, j, k) if a * (e * r - f * q) - b * (d * r - f * p) + c * (d * q - e * p) > 0 else (i, k, j))
    size = math.sqrt(1 + g * g)
    return _tables(spark, [tuple(c / size for c in p) for p in points], faces)


def icosphere(spark: SparkSession, level: int) -> tuple[DataFrame, DataFrame]:
    v, f = icosahedron(spark)
    for _ in range(level):
        v, f = subdivide(v, f)
        v = v.withColumn("_n", L.normalize([F.col(c) for c in _POINT])).select("vid", *(F.get("_n", F.lit(i)).alias(c) for i, c in enumerate(_POINT)))
    return v, f


def normalized(vertices: DataFrame, by: Sequence[str] = (), mode: str = "max") -> DataFrame:
    """Centred and scaled into the unit cube (``max``) or sphere (``sphere``)."""
    mean = vertices.groupBy(*by).agg(*(((F.min(c) + F.max(c)) / 2).alias(f"_m{c}") for c in _POINT))
    moved = vertices.join(mean, list(by)) if by else vertices.join(mean)
    moved = moved.select(*by, "vid", *((F.col(c) - F.col(f"_m{c}")).alias(c) for c in _POINT))
    size = F.max(F.greatest(*(F.abs(c) for c in _POINT))) if mode == "max" else F.max(F.sqrt(sum((F.col(c) * F.col(c) for c in _POINT[1:]), F.col("x") * F.col("x"))))
    scale = moved.groupBy(*by).agg(size.alias("_s"))
    moved = moved.join(scale, list(by)) if by else moved.join(scale)
    return moved.select(*by, "vid", *((F.col(c) / F.when(F.col("_s") > 0, F.col("_s"))).alias(c) for c in _POINT))


def camera_frustum(extrinsics, k, depth: float = 1.0):
    """Column with the five corners of a camera's frustum: eye, then the image's corners at a depth."""
    from plumbline.functions import camera

    inverse = L.inverse(extrinsics, 4)
    corners_ = [L.scale(L.matvec(camera.inverse_intrinsics(k), [F.lit(u), F.lit(v), F.lit(1.0)], 3), depth) for u, v in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0))]
    return F.array(L.translation_of(inverse), *(L.apply_transform(inverse, c) for c in corners_))


def chessboard(spark: SparkSession, width: int, height: int, grid: int, a: Sequence[float], b: Sequence[float]) -> DataFrame:
    x, y = F.col("id") % width, F.floor(F.col("id") / width)
    first = (F.floor(x / grid) + F.floor(y / grid)) % 2 == 0
    return spark.range(width * height).select(y.cast("int").alias("y"), x.cast("int").alias("x"), F.when(first, F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b))).alias("color"))


def mapped_vertices(vertices: DataFrame, weights: DataFrame) -> DataFrame:
    """Sparse linear map of vertices: ``weights(to, vid, w)``."""
    return vertices.join(weights, "vid").groupBy("to").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in _POINT)).withColumnRenamed("to", "vid")


def voxelize(vertices: DataFrame, size: float) -> DataFrame:
    return vertices.select(*(F.floor(F.col(c) / size).cast("long").alias(n) for c, n in zip(_POINT, "ijk", strict=True))).distinct()
