"""Scalar functions: group laws, cameras, superquadrics."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import camera as C
from plumbline.functions import linalg as L
from plumbline.functions import rotation as R
from plumbline.functions import superquadric as S


def unit(r: random.Random, n: int) -> list[float]:
    v = [r.gauss(0, 1) for _ in range(n)]
    s = math.sqrt(sum(x * x for x in v))
    return [x / s for x in v]


@pytest.fixture(scope="module")
def groups(spark):
    """Elements and tangents at ordinary, tiny and nearly half-turn scales."""
    r, rows = random.Random(0), []
    for i in range(24):
        scale = (1.0, 1e-7, math.pi - 1e-3)[i % 3]
        axis = unit(r, 3)
        rows.append((i, unit(r, 4), unit(r, 4), unit(r, 4), [a * scale for a in axis], [r.gauss(0, 1) for _ in range(3)], [r.gauss(0, 1) for _ in range(3)], r.uniform(-3, 3) * (1e-7 if i % 3 == 1 else 1)))
    return spark.createDataFrame(rows, "i int, a array<double>, b array<double>, c array<double>, w array<double>, v array<double>, u array<double>, theta double").cache()


def close(df, one, other, tolerance: float = 1e-9) -> None:
    for r in df.select(one.alias("x"), other.alias("y")).collect():
        assert np.allclose(r["x"], r["y"], atol=tolerance), r


def up_to_sign(q):
    first = F.get(F.filter(q, lambda x: F.abs(x) > 1e-6), F.lit(0))
    return F.transform(q, lambda x: x * F.signum(first))


def test_so3_laws(groups):
    a, b, c, w, v = (F.col(k) for k in "abcwv")
    close(groups, R.quat_multiply(a, R.so3_identity()), a)
    close(groups, R.quat_multiply(a, R.quat_conjugate(a)), R.so3_identity())
    close(groups, R.quat_multiply(R.quat_multiply(a, b), c), R.quat_multiply(a, R.quat_multiply(b, c)))
    close(groups, R.quat_rotate(R.quat_multiply(a, b), v), R.quat_rotate(a, R.quat_rotate(b, v)))
    close(groups, R.quat_rotate(a, v), L.matvec(R.quaternion_to_matrix(a), v, 3))
    close(groups, R.so3_log(R.so3_exp(w)), w, 1e-7)
    close(groups, up_to_sign(R.so3_exp(R.so3_log(a))), up_to_sign(a), 1e-7)
    close(groups, up_to_sign(R.matrix_to_quaternion(R.quaternion_to_matrix(a))), up_to_sign(a), 1e-7)
    close(groups, R.axis_angle_to_matrix(w), R.quaternion_to_matrix(R.so3_exp(w)))
    close(groups, R.matrix_to_axis_angle(R.axis_angle_to_matrix(w)), w, 1e-6)
    close(groups, R.xyzw_to_wxyz(R.wxyz_to_xyzw(a)), a)
    close(groups, up_to_sign(R.rpy_to_quaternion(*(F.get(R.quaternion_to_rpy(a), F.lit(i)) for i in range(3)))), up_to_sign(a), 1e-7)
    close(groups, R.euler_angles_to_matrix(R.matrix_to_euler_angles(R.quaternion_to_matrix(a))), R.quaternion_to_matrix(a), 1e-7)
    close(groups, L.norm(R.so3_sample(F.col("i")), 4), F.lit(1.0))


def test_se3_laws(groups):
    elements = [R.se3_from(F.col(q), F.col(t)).alias(n) for n, q, t in (("a", "a", "v"), ("b", "b", "u"), ("c", "c", "v"))]
    g = groups.select("i", "u", *elements, L.pack([*L.entries("v", 3), *L.entries("w", 3)]).alias("x")).cache()
    a, b, c, v, x = (F.col(k) for k in "abcux")
    close(g, R.se3_multiply(a, R.se3_inverse(a)), R.se3_identity())
    close(g, R.se3_multiply(R.se3_multiply(a, b), c), R.se3_multiply(a, R.se3_multiply(b, c)))
    close(g, R.se3_log(R.se3_exp(x)), x, 1e-6)
    m = g.select("*", R.se3_as_matrix(a).alias("m"), R.se3_as_matrix(R.se3_inverse(a)).alias("n"), L.matvec(R.se3_adjoint(a), x, 6).alias("moved"), R.se3_exp(x).alias("e")).cache()
    close(m, R.se3_apply(a, v), L.apply_transform("m", v))
    close(m, R.se3_as_matrix(R.se3_from_matrix("m")), F.col("m"), 1e-7)
    close(m, L.inverse_rigid("m"), F.col("n"))
    close(m, L.inverse("m", 4), F.col("n"), 1e-7)
    h = m.select("i", R.se3_exp("moved").alias("p"), R.se3_multiply(R.se3_multiply(a, F.col("e")), R.se3_inverse(a)).alias("q")).cache()
    close(h.filter("i % 3 = 0"), R.se3_as_matrix("p"), R.se3_as_matrix("q"), 1e-6)


def test_plane_groups(groups):
    a, b = R.so2_exp(F.col("theta")), R.so2_exp(F.get("v", F.lit(0)))
    close(groups, R.so2_log(a), F.col("theta"))
    close(groups, R.so2_multiply(a, R.so2_inverse(a)), R.so2_identity())
    close(groups, R.so2_multiply(a, b), R.so2_multiply(b, a))
    g, h = R.se2_from(a, L.entries("u", 3)[:2]), R.se2_from(b, L.entries("v", 3)[:2])
    tangent = L.pack([*L.entries("u", 3)[:2], F.col("theta")])
    close(groups, R.se2_multiply(g, R.se2_inverse(g)), R.se2_identity())
    close(groups, R.se2_multiply(R.se2_multiply(g, h), g), R.se2_multiply(g, R.se2_multiply(h, g)))
    close(groups, R.se2_log(R.se2_exp(tangent)), tangent, 1e-7)
    close(groups, R.se2_from_matrix(R.se2_matrix(g)), g)
    close(groups, R.se2_exp(L.matvec(R.se2_adjoint(g), tangent, 3)), R.se2_multiply(R.se2_multiply(g, R.se2_exp(tangent)), R.se2_inverse(g)), 1e-6)


def test_interpolation(groups):
    a, b = F.col("a"), F.col("b")
    close(groups, up_to_sign(R.slerp_quaternion(a, b, 0.0)), up_to_sign(a))
    close(groups, up_to_sign(R.slerp_quaternion(a, b, 1.0)), up_to_sign(b))
    close(groups, R.slerp_rotation_matrix(R.quaternion_to_matrix(a), R.quaternion_to_matrix(b), 0.3), R.quaternion_to_matrix(R.slerp_quaternion(a, b, 0.3)), 1e-7)
    half = R.slerp_quaternion(a, b, 0.5)
    close(groups, R.quat_rotate(R.quat_multiply(R.quat_multiply(half, R.quat_conjugate(a)), half), F.col("v")), R.quat_rotate(b, F.col("v")), 1e-6)
    x, y = L.normalize("v"), L.normalize("u")
    close(groups, L.matvec(R.rotation_from_vectors("v", "u"), x, 3), y, 1e-7)
    close(groups, R.points_to_body(R.points_to_world("u", R.quaternion_to_matrix(a), "v"), R.quaternion_to_matrix(a), "v"), F.col("u"))
    m, n = R.se3_as_matrix(R.se3_from(a, F.col("v"))), R.se3_as_matrix(R.se3_from(b, F.col("u")))
    close(groups, R.interpolate_extrinsics(m, n, 1.0), n, 1e-6)


def test_cameras(spark):
    df = spark.createDataFrame([([0.3, -0.2, 2.5], [1.0, 2.0, 3.0], [0.0, 0.5, -4.0])], "p array<double>, eye array<double>, at array<double>")
    k = C.intrinsics_from_fov(fov_x=1.0, width=640, height=480)
    m = C.extrinsics_look_at("eye", "at", L.pack([0, 1, 0]))
    uv, depth = C.project_cv("p", k, m)
    close(df, C.unproject_cv(uv, k, depth, m), F.col("p"))
    ahead, _ = C.project_cv("at", k, m)
    close(df, ahead, L.pack([0.5, 0.5]))
    view, p = C.view_look_at("eye", "at", L.pack([0, 1, 0])), C.perspective_from_fov_xy(1.0, 0.8, 0.1, 100)
    close(df, C.extrinsics_to_view(m), view)
    screen, linear = C.project_gl("p", p, view)
    close(df, C.unproject_gl(screen, p, view), F.col("p"), 1e-7)
    close(df, linear, depth)
    near, far = C.perspective_to_near_far(p)
    close(df, F.array(near, far), L.pack([0.1, 100.0]), 1e-6)
    close(df, C.intrinsics_to_perspective(C.perspective_to_intrinsics(p), 0.1, 100), p, 1e-9)
    fx, fy = C.intrinsics_to_fov(C.intrinsics_from_fov_xy(1.0, 0.8))
    close(df, F.array(fx, fy), L.pack([1.0, 0.8]))
    close(df, C.depth_buffer_to_linear(C.project_depth(F.lit(7.0), 0.1, 100), 0.1, 100), F.lit(7.0))
    close(df, C.uv_to_pixel(*L.entries(C.pixel_to_uv(3, 5, 64, 48), 2), 64, 48), L.pack([3, 5]))
    origin, direction = C.rays(uv, k, m)
    close(df, L.add(origin, L.scale(direction, depth)), F.col("p"))
    point, s, t = C.ray_intersection(L.pack([0, 0, 0]), L.pack([1, 0, 0]), L.pack([2, -1, 1]), L.pack([0, 1, 0]))
    close(df, point, L.pack([2, 0, 0.5]))
    close(df, F.array(s, t), L.pack([2, 1]))
    close(df, C.plane_depth(L.pack([0, 0, 1, -2]), L.pack([0.1, 0.2, 1])), F.lit(2.0))
    close(df, C.apply_2d(C.rotate_2d(math.pi / 2, (1.0, 0.0)), [F.lit(2.0), F.lit(0.0)]), L.pack([1, 1]))
    assert C.pixel_grid(spark, 3, 2).count() == 6


def test_superquadrics(spark):
    df = spark.createDataFrame([(0.4, 1.1, 0.5, 0.9), (-1.2, 2.0, 1.0, 1.0)], "eta double, omega double, e1 double, e2 double")
    p = S.parametric("eta" and F.col("eta"), F.col("omega"), F.col("e1"), F.col("e2"), (1.0, 2.0, 3.0))
    close(df, S.implicit(p, F.col("e1"), F.col("e2"), (1.0, 2.0, 3.0)), F.lit(0.0), 1e-6)
    sphere = spark.createDataFrame([([0.0, 0.0, 2.0],), ([3.0, 4.0, 0.0],)], "p array<double>")
    close(sphere, S.implicit("p", 1.0, 1.0, as_sdf=True), L.norm("p") - 1, 1e-5)
    close(sphere, S.uv_sphere(S.sphere_uv("p")), L.normalize("p"))
    primitives = spark.createDataFrame([(1, 0.5, 0.5, [1.0, 1.0, 1.0])], "prim_id long, eps1 double, eps2 double, s array<double>")
    assert S.surface_samples(primitives, 4, 8).count() == 32 and S.random_samples(primitives, 10).count() == 10
    arc = S.equal_arc_angles(spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "prim_id long, eps double, a double, b double"), 0.1).orderBy("k").collect()
    assert arc[0]["theta"] == 0 and abs(arc[3]["theta"] - 0.3) < 0.01


def test_composed_functions_stay_small(spark):
    """Intermediate values are bound, so that a composition doesn't repeat them in every entry."""
    m = R.axis_angle_to_matrix(L.pack([F.col("a"), F.col("b"), F.col("c") + 0.1]))
    t = L.to_4x4(m, L.pack([F.col("a"), F.col("b"), F.col("c")]))
    half = R.lerp_se3_matrix(L.identity(4), t, F.lit(0.5))
    seen = C.extrinsics_look_at(L.pack([F.col("a"), F.col("b"), F.col("c")]), L.pack([60.0, 30.0, 50.0]), L.pack([0.0, 0.0, 1.0]))
    assert len(half._jc.toString()) < 100_000
    assert len(seen._jc.toString()) < 20_000
