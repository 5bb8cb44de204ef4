"""Superquadrics: parametric and implicit forms, distances, spherical maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import linalg as L
from plumbline.functions.binding import bind_all
from plumbline.functions import rotation as R
from plumbline.functions.linalg import entries, num, pack


def signed_pow(x, e) -> Column:
    return F.signum(num(x)) * F.pow(F.abs(num(x)), num(e))


def safe_pow(x, e, eps: float = 1e-6) -> Column:
    return F.pow(F.greatest(F.abs(num(x)), F.lit(eps)), num(e))


def parametric(eta, omega, eps1, eps2, scale=(1.0, 1.0, 1.0)) -> Column:
    """Surface point at latitude eta and longitude omega."""
    a, b, c = entries(scale, 3)
    ce, se = signed_pow(F.cos(num(eta)), eps1), signed_pow(F.sin(num(eta)), eps1)
    return pack([a * ce * signed_pow(F.cos(num(omega)), eps2), b * ce * signed_pow(F.sin(num(omega)), eps2), c * se])


def implicit(point, eps1, eps2, scale=(1.0, 1.0, 1.0), as_sdf: bool = False) -> Column:
    """Inside-outside function: below 0 inside, 0 on the surface; with ``as_sdf`` the radial distance."""
    x, y, z = (v / s for v, s in zip(entries(point, 3), entries(scale, 3), strict=True))
    e1, e2 = num(eps1), num(eps2)
    f = F.pow(safe_pow(x, 2 / e2) + safe_pow(y, 2 / e2), e2 / e1) + safe_pow(z, 2 / e1)
    if as_sdf:
        return L.norm(point) * (1 - F.pow(f, -e1 / 2))
    return F.pow(f, e1) - 1


def inside_loss(points: DataFrame, value: Column) -> DataFrame:
    """Mean of the implicit function over points where it is positive, 0 elsewhere."""
    return points.agg(F.avg(F.greatest(value, F.lit(0.0))).alias("loss"))


def packed_parameters(s_log, rotation, translation, eps) -> Column:
    """Eleven numbers: eps1, eps2, half-axes, Euler angles z, y, x and translation."""
    s, e, t = entries(s_log, 3), entries(eps, 2), entries(translation, 3)
    x, y, z = entries(R.matrix_to_euler_angles(rotation), 3)
    return pack([*e, *(F.exp(v) for v in s), z, y, x, *t])


def surface_samples(primitives: DataFrame, n_eta: int, n_omega: int) -> DataFrame:
    """A grid of surface points of ``(prim_id, eps1, eps2, s array)``: (prim_id, i, j, point)."""
    grid = primitives.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_eta - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_omega - 1))).alias("j"))
    eta = (F.col("i") + 0.5) / n_eta * math.pi - math.pi / 2
    omega = F.col("j") / n_omega * (2 * math.pi) - math.pi
    return grid.select("prim_id", "i", "j", parametric(eta, omega, F.col("eps1"), F.col("eps2"), F.col("s")).alias("point"))


def random_samples(primitives: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n surface points of each primitive at hashed angles."""
    rows = primitives.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    key = F.struct("prim_id", "draw")
    eta, omega = (R.uniform(key, seed) - 0.5) * math.pi, (R.uniform(key, seed + 1) - 0.5) * (2 * math.pi)
    return rows.select("prim_id", "draw", parametric(eta, omega, F.col("eps1"), F.col("eps2"), F.col("s")).alias("point"))


def equal_arc_angles(primitives: DataFrame, spacing: float = 0.05) -> DataFrame:
    """Angles of points about equally far apart on the superellipse of ``(prim_id, eps, a, b)``: (prim_id, k, theta), first quadrant.

    The angle's step follows from the curve's slope at the angle before, so each primitive is a fold of its own.
    """
    import pandas as pd

    def walk(batches):
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                e, k, theta = p.eps, 0, 0.0
                while theta < math.pi / 2 and k < 100_000:
                    out.append((p.prim_id, k, theta))
                    c, s = max(math.cos(theta), 1e-9), max(math.sin(theta), 1e-9)
                    dx, dy = -p.a * e * c ** (e - 1) * s, p.b * e * s ** (e - 1) * c
                    theta += min(0.1, max(1e-4, spacing / max(math.hypot(dx, dy), 1e-9)))
                    k += 1
            yield pd.DataFrame(out, columns=["prim_id", "k", "theta"])

    return primitives.mapInPandas(walk, "prim_id long, k int, theta double")


def superquadric_mesh(primitives: DataFrame, sphere: DataFrame) -> DataFrame:
    """Vertices of ``(prim_id, eps1, eps2, s)`` from those of a unit sphere (vid, x, y, z), a small constant table."""
    at = primitives.join(F.broadcast(sphere))
    eta, omega = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z")))), F.atan2("y", "x")
    return at.select("prim_id", "vid", parametric(eta, omega, F.col("eps1"), F.col("eps2"), F.col("s")).alias("point"))


def sphere_uv(point, eps: float = 1e-9) -> Column:
    """Longitude and latitude of a direction, both in [0, 1]."""
    x, y, z = entries(point, 3)
    size = F.greatest(L.norm(point), F.lit(eps))
    return pack([F.atan2(y, x) / (2 * math.pi) + 0.5, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / size))) / math.pi])


def uv_sphere(uv, radius: float = 1.0) -> Column:
    """Inverse of sphere_uv."""
    u, v = entries(uv, 2)
    phi, theta = (u - 0.5) * (2 * math.pi), v * math.pi
    return pack([radius * F.sin(theta) * F.cos(phi), radius * F.sin(theta) * F.sin(phi), radius * F.cos(theta)])


bind_all(globals(), __name__, ("inside_loss", "surface_samples", "random_samples", "equal_arc_angles", "superquadric_mesh"))
