"""Cameras: projections, intrinsics, rays and pixel grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import linalg as L
from plumbline.functions.binding import bind_all, binds
from plumbline.functions.linalg import entries, num, pack


def perspective(fov_y, aspect, near, far) -> Column:
    """OpenGL projection of a vertical field of view."""
    f, near, far = 1 / F.tan(num(fov_y) / 2), num(near), num(far)
    return pack([f / num(aspect), 0, 0, 0, 0, f, 0, 0, 0, 0, (near + far) / (near - far), 2 * near * far / (near - far), 0, 0, -1, 0])


def perspective_from_fov(fov, width, height, near, far) -> Column:
    """The larger side spans ``fov``."""
    w, h = num(width), num(height)
    return perspective(2 * F.atan(F.tan(num(fov) / 2) * h / F.greatest(w, h)), w / h, near, far)


def perspective_from_fov_xy(fov_x, fov_y, near, far) -> Column:
    return perspective(fov_y, F.tan(num(fov_x) / 2) / F.tan(num(fov_y) / 2), near, far)


def intrinsics_from_focal_center(fx, fy, cx, cy) -> Column:
    return pack([fx, 0, cx, 0, fy, cy, 0, 0, 1])


def intrinsics_from_fov(*, fov_max=None, fov_min=None, fov_x=None, fov_y=None, width=None, height=None) -> Column:
    """Normalised intrinsics, centre 0.5."""
    focal = lambda a: 0.5 / F.tan(num(a) / 2)
    if fov_max is not None or fov_min is not None:
        w, h = num(width), num(height)
        side = F.greatest(w, h) if fov_max is not None else F.least(w, h)
        f = focal(fov_max if fov_max is not None else fov_min) * side
        fx, fy = f / w, f / h
    elif fov_x is not None:
        fx = focal(fov_x)
        fy = focal(fov_y) if fov_y is not None else fx * num(width) / num(height)
    else:
        fy = focal(fov_y)
        fx = fy * num(height) / num(width)
    return intrinsics_from_focal_center(fx, fy, 0.5, 0.5)


def intrinsics_from_fov_xy(fov_x, fov_y) -> Column:
    return intrinsics_from_fov(fov_x=fov_x, fov_y=fov_y)


def focal_to_fov(focal) -> Column:
    return 2 * F.atan(0.5 / num(focal))


def fov_to_focal(fov) -> Column:
    return 0.5 / F.tan(num(fov) / 2)


def intrinsics_to_fov(k) -> tuple[Column, Column]:
    k = entries(k, 9)
    return focal_to_fov(k[0]), focal_to_fov(k[4])


def vertical_fov(k, height) -> Column:
    """Of pixel intrinsics."""
    return 2 * F.atan(num(height) / (2 * entries(k, 9)[4]))


def pose_of(transform) -> tuple[Column, Column]:
    """Quaternion and position of a camera-to-world matrix."""
    from plumbline.functions.rotation import matrix_to_quaternion

    return matrix_to_quaternion(L.rotation_of(transform)), L.translation_of(transform)


@binds
def _frame(x, z, eye) -> Column:
    axes = (L.normalize(v) for v in (x, L.cross(z, x), z))
    return _framed([v for a in axes for v in entries(a, 3)], entries(eye, 3))


@binds
def _framed(r, e) -> Column:
    return L.se3_matrix(r, [-L.add_all([r[3 * i + j] * e[j] for j in range(3)]) for i in range(3)])


def view_look_at(eye, look_at, up) -> Column:
    """OpenGL view matrix: the camera looks along -z."""
    z = L.sub(eye, look_at)
    x = L.cross(up, z)
    return _frame(x, z, eye)


def extrinsics_look_at(eye, look_at, up) -> Column:
    """OpenCV extrinsics: the camera looks along z, y points down."""
    z = L.sub(look_at, eye)
    x = L.cross(L.scale(up, -1), z)
    return _frame(x, z, eye)


def perspective_to_intrinsics(p) -> Column:
    p = entries(p, 16)
    x, y, w = p[0:3], p[4:7], p[12:15]
    sign = (1, -1, -1)
    rows = ([0.5 * (a + c) for a, c in zip(x, w, strict=True)], [0.5 * (c - b) for b, c in zip(y, w, strict=True)], w)
    return pack([v * s for row in rows for v, s in zip(row, sign, strict=True)])


def perspective_to_near_far(p) -> tuple[Column, Column]:
    p = entries(p, 16)
    return p[11] / (p[10] - 1), p[11] / (p[10] + 1)


def intrinsics_to_perspective(k, near, far) -> Column:
    k, near, far = entries(k, 9), num(near), num(far)
    return pack([2 * k[0], 0, 1 - 2 * k[2], 0, 0, 2 * k[4], 2 * k[5] - 1, 0, 0, 0, (near + far) / (near - far), 2 * near * far / (near - far), 0, 0, -1, 0])


def extrinsics_to_view(m) -> Column:
    """Flips the camera's y and z rows; its own inverse."""
    m = entries(m, 16)
    return pack([v if i // 4 in (0, 3) else -v for i, v in enumerate(m)])


view_to_extrinsics = extrinsics_to_view


def normalize_intrinsics(k, width, height, integer_pixel_centers: bool = True) -> Column:
    w, h = num(width), num(height)
    half = 0.5 if integer_pixel_centers else 0.0
    return L.matmul([1 / w, 0, half / w, 0, 1 / h, half / h, 0, 0, 1], k, 3, 3, 3)


def crop_intrinsics(k, width, height, left, top, crop_width, crop_height) -> Column:
    w, h, cw, ch = map(num, (width, height, crop_width, crop_height))
    return L.matmul([w / cw, 0, -num(left) / cw, 0, h / ch, -num(top) / ch, 0, 0, 1], k, 3, 3, 3)


def pixel_to_uv(x, y, width, height) -> Column:
    return pack([(num(x) + 0.5) / num(width), (num(y) + 0.5) / num(height)])


def uv_to_pixel(u, v, width, height) -> Column:
    return pack([num(u) * num(width) - 0.5, num(v) * num(height) - 0.5])


def pixel_to_ndc(x, y, width, height) -> Column:
    """(p + 0.5) / (size * (2, -2)) + (-1, 1)."""
    return pack([(num(x) + 0.5) / (num(width) * 2) - 1, (num(y) + 0.5) / (num(height) * -2) + 1])


def project_depth(depth, near, far) -> Column:
    near, far = num(near), num(far)
    return (far - near * far / num(depth)) / (far - near)


def depth_buffer_to_linear(value, near, far) -> Column:
    near, far = num(near), num(far)
    return near * far / (far - (far - near) * num(value))


def project_gl(point, projection, view=None, model=None) -> tuple[Column, Column]:
    """Screen coordinates in [0, 1] and linear depth."""
    m = projection
    for t in (view, model):
        m = m if t is None else L.matmul(m, t, 4, 4, 4)
    clip = entries(L.matvec(m, L.homogeneous(point), 4), 4)
    return pack([0.5 * c / clip[3] + 0.5 for c in clip[:3]]), clip[3]


def project_cv(point, k, extrinsics=None) -> tuple[Column, Column]:
    """Image coordinates and depth."""
    p = point if extrinsics is None else L.apply_transform(extrinsics, point)
    u, v, w = entries(L.matvec(k, p, 3), 3)
    return pack([u / w, v / w]), w


def unproject_gl(screen, projection, view=None, model=None) -> Column:
    m = projection
    for t in (view, model):
        m = m if t is None else L.matmul(m, t, 4, 4, 4)
    ndc = [2 * s - 1 for s in entries(screen, 3)]
    x, y, z, w = entries(L.matvec(L.inverse(m, 4), [*ndc, F.lit(1.0)], 4), 4)
    return pack([x / w, y / w, z / w])


def inverse_intrinsics(k) -> Column:
    """Closed form of an upper triangular K with last row 0, 0, 1."""
    k = entries(k, 9)
    fx, s, cx, fy, cy = k[0], k[1], k[2], k[4], k[5]
    return pack([1 / fx, -s / (fx * fy), (s * cy - cx * fy) / (fx * fy), 0, 1 / fy, -cy / fy, 0, 0, 1])


def unproject_cv(uv, k, depth=None, extrinsics=None) -> Column:
    """Camera-space point, world-space if extrinsics are given."""
    p = L.matvec(inverse_intrinsics(k), [*entries(uv, 2), F.lit(1.0)], 3)
    if depth is not None:
        p = L.scale(p, depth)
    return p if extrinsics is None else L.apply_transform(L.inverse(extrinsics, 4), p)


def extrinsics_to_essential(m) -> Column:
    return L.matmul(L.skew(L.translation_of(m)), L.rotation_of(m), 3, 3, 3)


def ray_intersection(p1, d1, p2, d2) -> tuple[Column, Column, Column]:
    """The point closest to both lines, and its place along each; null for parallel lines."""
    a, b, c = L.dot(d1, d1), L.dot(d1, d2), L.dot(d2, d2)
    w = L.sub(p1, p2)
    d, e = L.dot(d1, w), L.dot(d2, w)
    denominator = a * c - b * b
    denominator = F.when(denominator > 1e-12, denominator)
    s, t = (b * e - c * d) / denominator, (a * e - b * d) / denominator
    return L.scale(L.add(L.add(p1, L.scale(d1, s)), L.add(p2, L.scale(d2, t))), 0.5), s, t


def pixel_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A row for each pixel: x, y, uv (u right, v down, in [0, 1]) and pixel centre."""
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    return grid.select("x", "y", pixel_to_uv(F.col("x"), F.col("y"), width, height).alias("uv"), pack([F.col("x") + 0.5, F.col("y") + 0.5]).alias("center"), scr_coord(F.col("x"), F.col("y"), width, height).alias("scr"))


def scr_coord(x, y, width, height) -> Column:
    """OpenGL screen coordinates of a pixel centre, y up."""
    return pack([(num(x) + 0.5) / num(width), 1 - (num(y) + 0.5) / num(height)])


def rays(uv, k, extrinsics) -> tuple[Column, Column]:
    """Origin and (unnormalised) direction of the ray through uv."""
    inverse = L.inverse(extrinsics, 4)
    direction = L.matvec(L.rotation_of(inverse), L.matvec(inverse_intrinsics(k), [*entries(uv, 2), F.lit(1.0)], 3), 3)
    return L.translation_of(inverse), direction


def pixel_width(k, width, height) -> Column:
    """Mean size of a pixel on the plane at distance 1."""
    k = entries(k, 9)
    return 0.5 * (1 / (k[0] * num(width)) + 1 / (k[4] * num(height)))


def cone_gaussian(z0, z1, width) -> tuple[Column, Column, Column]:
    """Mean along the ray, and variance along and across it, of a cone's part between two depths."""
    mid, half, radius = (num(z0) + num(z1)) / 2, (num(z1) - num(z0)) / 2, num(width) * 2 / 12**0.5
    m2, h2 = mid * mid, half * half
    common = 3 * m2 + h2
    mean = mid + 2 * mid * h2 / common
    along = h2 / 3 - 4.0 / 15 * (h2 * h2 * (12 * m2 - h2)) / (common * common)
    across = radius * radius * (m2 / 4 + 5.0 / 12 * h2 - 4.0 / 15 * h2 * h2 / common)
    return mean, along, across


def intrinsics_of(params) -> Column:
    """From a struct or map column with fx, fy, cx, cy."""
    p = L.col(params)
    return intrinsics_from_focal_center(p["fx"], p["fy"], p["cx"], p["cy"])


def plane_depth(plane, ray, most: float | None = None) -> Column:
    """Depth at which a ray (K^-1 [x, y, 1]) meets n.p + d = 0, clamped to [0, most]; null if parallel."""
    n = entries(plane, 4)
    slope = L.dot(n[:3], ray)
    depth = F.greatest(-n[3] / F.when(slope != 0, slope), F.lit(0.0))
    return depth if most is None else F.least(depth, F.lit(float(most)))


def back_project(x, y, depth, k, c2w) -> Column:
    """World point of a pixel centre: t + R K^-1 [x + .5, y + .5, 1] depth."""
    ray = L.matvec(inverse_intrinsics(k), [num(x) + 0.5, num(y) + 0.5, F.lit(1.0)], 3)
    return L.apply_transform(c2w, L.scale(ray, depth))


def fov_x_of(focal, width) -> Column:
    return 2 * F.atan(num(width) / (2 * num(focal)))


def normalise_coordinates(x, size) -> Column:
    """Pixel to [-1, 1]."""
    return 2 * num(x) / (num(size) - 1) - 1


def denormalise_coordinates(x, size) -> Column:
    return 0.5 * ((num(x) + 1) * (num(size) - 1))


def rotation_2d(theta) -> Column:
    c, s = F.cos(num(theta)), F.sin(num(theta))
    return pack([c, -s, s, c])


def rotate_2d(theta, center=(0.0, 0.0)) -> Column:
    r, (x, y) = entries(rotation_2d(theta), 4), entries(center, 2)
    return pack([r[0], r[1], x - r[0] * x - r[1] * y, r[2], r[3], y - r[2] * x - r[3] * y, 0, 0, 1])


def translate_2d(t) -> Column:
    x, y = entries(t, 2)
    return pack([1, 0, x, 0, 1, y, 0, 0, 1])


def scale_2d(s, center=(0.0, 0.0)) -> Column:
    s, (x, y) = num(s), entries(center, 2)
    return pack([s, 0, x - s * x, 0, s, y - s * y, 0, 0, 1])


def apply_2d(m, p) -> Column:
    m, (x, y) = entries(m, 9), entries(p, 2)
    return pack([m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]])


bind_all(globals(), __name__, ("pixel_grid",))
