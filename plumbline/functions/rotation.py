"""Rotations and rigid motions: quaternions (wxyz), matrices, axis-angle, Euler angles, SO(2), SE(2), SO(3), SE(3)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import linalg as L
from plumbline.functions.binding import bind_all, binds
from plumbline.functions.linalg import entries, num, pack

#: Below this squared angle series replace quotients.
TINY = 1e-8


def _select(small, series, exact) -> Column:
    return F.when(small, series).otherwise(exact)


# quaternions


def quat_normalize(q) -> Column:
    return L.normalize(q, 4, 1e-12)


def quat_conjugate(q) -> Column:
    w, x, y, z = entries(q, 4)
    return pack([w, -x, -y, -z])


def quat_multiply(a, b) -> Column:
    (aw, ax, ay, az), (bw, bx, by, bz) = entries(a, 4), entries(b, 4)
    return pack([aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw])


def quat_rotate(q, v) -> Column:
    """Rotates a vector by a unit quaternion."""
    w, *u = entries(q, 4)
    v = entries(v, 3)
    t = [2 * (u[1] * v[2] - u[2] * v[1]), 2 * (u[2] * v[0] - u[0] * v[2]), 2 * (u[0] * v[1] - u[1] * v[0])]
    return pack([v[0] + w * t[0] + u[1] * t[2] - u[2] * t[1], v[1] + w * t[1] + u[2] * t[0] - u[0] * t[2], v[2] + w * t[2] + u[0] * t[1] - u[1] * t[0]])


def quaternion_to_matrix(q) -> Column:
    return _unit_to_matrix(quat_normalize(q))


@binds
def _unit_to_matrix(q) -> Column:
    w, x, y, z = entries(q, 4)
    return pack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)])


qvec_to_matrix = quaternion_to_matrix


def matrix_to_quaternion(m) -> Column:
    """From the largest component, so no branch divides by a small number."""
    m = entries(m, 9)
    root = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    return quat_normalize(_by_largest(m, root, F.greatest(*root)))


@binds
def _by_largest(m, root, big) -> Column:
    s = F.sqrt(big)
    a = 0.5 / s
    branch = [
        [0.5 * s, (m[7] - m[5]) * a, (m[2] - m[6]) * a, (m[3] - m[1]) * a],
        [(m[7] - m[5]) * a, 0.5 * s, (m[1] + m[3]) * a, (m[2] + m[6]) * a],
        [(m[2] - m[6]) * a, (m[1] + m[3]) * a, 0.5 * s, (m[5] + m[7]) * a],
        [(m[3] - m[1]) * a, (m[2] + m[6]) * a, (m[5] + m[7]) * a, 0.5 * s],
    ]
    found = F.when(root[0] >= big, pack(branch[0])).when(root[1] >= big, pack(branch[1])).when(root[2] >= big, pack(branch[2]))
    return found.otherwise(pack(branch[3]))


def xyzw_to_wxyz(q) -> Column:
    x, y, z, w = entries(q, 4)
    return pack([w, x, y, z])


def wxyz_to_xyzw(q) -> Column:
    w, x, y, z = entries(q, 4)
    return pack([x, y, z, w])


def quat_multiply_xyzw(a, b) -> Column:
    return wxyz_to_xyzw(quat_multiply(xyzw_to_wxyz(a), xyzw_to_wxyz(b)))


def quat_rotate_xyzw(q, v) -> Column:
    return quat_rotate(xyzw_to_wxyz(q), v)


def axis_angle_to_quaternion(v) -> Column:
    v = entries(v, 3)
    return _half_turn(v, L.dot(v, v))


@binds
def _half_turn(v, square) -> Column:
    angle = F.sqrt(square)
    small = square < TINY
    k = _select(small, 0.5 - square / 48, F.sin(angle / 2) / F.when(~small, angle))
    return pack([_select(small, 1 - square / 8, F.cos(angle / 2)), *entries(L.scale(v, k), 3)])


def quaternion_to_axis_angle(q) -> Column:
    """The angle lies in [-pi, pi]."""
    w, *v = entries(q, 4)
    return _axis_angle(w, v, L.norm(v))


@binds
def _axis_angle(w, v, size) -> Column:
    small = size < 1e-7
    angle = 2 * F.atan2(F.when(w < 0, -size).otherwise(size), F.abs(w))
    k = _select(small, F.when(w != 0, 2 / w), angle / F.when(~small, size))
    return L.scale(v, k)


def axis_angle_to_matrix(v) -> Column:
    return quaternion_to_matrix(axis_angle_to_quaternion(v))


def matrix_to_axis_angle(m) -> Column:
    return quaternion_to_axis_angle(matrix_to_quaternion(m))


def rotation_from_vectors(a, b) -> Column:
    """The least rotation that turns a's direction into b's; null for opposite ones."""
    return _least_turn(L.normalize(a), L.normalize(b))


@binds
def _least_turn(a, b) -> Column:
    c = L.dot(a, b)
    return _turn_across(L.cross(a, b), 1 / F.when(c > -1, 1 + c))


@binds
def _turn_across(v, k) -> Column:
    x, y, z = entries(v, 3)
    return pack([1 - k * (y * y + z * z), k * x * y - z, k * x * z + y, k * x * y + z, 1 - k * (x * x + z * z), k * y * z - x, k * x * z - y, k * y * z + x, 1 - k * (x * x + y * y)])


# Euler angles


def euler_axis_rotation(axis: str, angle) -> Column:
    c, s = F.cos(num(angle)), F.sin(num(angle))
    return pack({"X": [1, 0, 0, 0, c, -s, 0, s, c], "Y": [c, 0, s, 0, 1, 0, -s, 0, c], "Z": [c, -s, 0, s, c, 0, 0, 0, 1]}[axis])


def euler_angles_to_matrix(angles, convention: str = "XYZ") -> Column:
    """Angles are of X, Y and Z; the convention's first axis turns first."""
    if len(convention) != 3 or set(convention) - set("XYZ") or convention[1] in (convention[0], convention[2]):
        raise ValueError(f"not a convention: {convention}")
    angle = entries(angles, 3)
    first, second, third = (euler_axis_rotation(c, angle["XYZ".index(c)]) for c in convention)
    return L.matmul(third, L.matmul(second, first, 3, 3, 3), 3, 3, 3)


def matrix_to_euler_angles(m) -> Column:
    """Angles of X, Y and Z for the convention XYZ; at the poles Z is 0."""
    m = entries(m, 9)
    pole = F.abs(m[6]) > 1 - 1e-12
    x = F.when(pole, F.atan2(-m[5], m[4])).otherwise(F.atan2(m[7], m[8]))
    z = F.when(pole, F.lit(0.0)).otherwise(F.atan2(m[3], m[0]))
    return pack([x, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[6]))), z])


def quaternion_to_rpy(q) -> Column:
    """Roll, pitch, yaw; pitch is held at +-pi/2 where the sine leaves [-1, 1]."""
    w, x, y, z = entries(q, 4)
    s = 2 * (w * y - z * x)
    pitch = F.when(F.abs(s) >= 1, F.signum(s) * math.pi / 2).otherwise(F.asin(s))
    return pack([F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))])


def rpy_to_quaternion(roll, pitch, yaw) -> Column:
    return quat_multiply(so3_about("z", yaw), quat_multiply(so3_about("y", pitch), so3_about("x", roll)))


# interpolation


def lerp(a, b, t, n: int = 3) -> Column:
    return pack([x + num(t) * (y - x) for x, y in zip(entries(a, n), entries(b, n), strict=True)])


@binds
def _slerp(a, b, t, n: int) -> Column:
    return _along(entries(a, n), entries(b, n), t, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), L.dot(a, b, n))))


@binds
def _along(a, b, t, d) -> Column:
    theta = F.acos(d) * num(t)
    rest = [y - x * d for x, y in zip(a, b, strict=True)]
    return _mixed(a, rest, F.cos(theta), F.sin(theta), F.greatest(L.norm(rest, len(rest)), F.lit(1e-12)))


@binds
def _mixed(a, rest, c, s, size) -> Column:
    return pack([x * c + y / size * s for x, y in zip(a, rest, strict=True)])


def slerp_quaternion(a, b, t) -> Column:
    """Along the shorter arc: the second quaternion is flipped if the dot product is negative."""
    return _shorter(quat_normalize(a), quat_normalize(b), t)


@binds
def _shorter(a, b, t) -> Column:
    sign = F.when(L.dot(a, b, 4) < 0, -1.0).otherwise(1.0)
    return _slerp(a, L.scale(b, sign, 4), t, 4)


def slerp_vector(a, b, t) -> Column:
    return _slerp(a, b, t, 3)


def slerp_rotation_matrix(a, b, t) -> Column:
    return quaternion_to_matrix(slerp_quaternion(matrix_to_quaternion(a), matrix_to_quaternion(b), t))


def lerp_se3_matrix(a, b, t) -> Column:
    return L.se3_matrix(slerp_rotation_matrix(L.rotation_of(a), L.rotation_of(b), t), lerp(L.translation_of(a), L.translation_of(b), t))


interpolate_transform = lerp_se3_matrix


def interpolate_extrinsics(a, b, t) -> Column:
    """Interpolates the cameras' poses, not the matrices."""
    return L.inverse_rigid(lerp_se3_matrix(L.inverse_rigid(a), L.inverse_rigid(b), t))


def interpolate_view(a, b, t) -> Column:
    return interpolate_extrinsics(a, b, t)


# SO(2): [cos, sin]


def so2_identity() -> Column:
    return pack([1, 0])


def so2_exp(theta) -> Column:
    return pack([F.cos(num(theta)), F.sin(num(theta))])


so2_from_radians = so2_exp


def so2_log(r) -> Column:
    c, s = entries(r, 2)
    return F.atan2(s, c)


so2_as_radians = so2_log


def so2_matrix(r) -> Column:
    c, s = entries(r, 2)
    return pack([c, -s, s, c])


def so2_from_matrix(m) -> Column:
    m = entries(m, 4)
    return pack([m[0], m[2]])


def so2_apply(r, v) -> Column:
    (c, s), (x, y) = entries(r, 2), entries(v, 2)
    return pack([c * x - s * y, s * x + c * y])


so2_multiply = so2_apply


def so2_inverse(r) -> Column:
    c, s = entries(r, 2)
    return pack([c, -s])


def so2_adjoint(r) -> Column:
    return pack([1])


def so2_normalize(r) -> Column:
    return L.normalize(r, 2)


def uniform(key, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the key: the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**53)) / float(2**53)


def so2_sample(key, seed: int = 0) -> Column:
    return so2_exp(uniform(key, seed) * (2 * math.pi))


# SE(2): [cos, sin, x, y]


def se2_identity() -> Column:
    return pack([1, 0, 0, 0])


def se2_from(rotation, translation) -> Column:
    return pack([*entries(rotation, 2), *entries(translation, 2)])


def se2_matrix(g) -> Column:
    c, s, x, y = entries(g, 4)
    return pack([c, -s, x, s, c, y, 0, 0, 1])


def se2_from_matrix(m) -> Column:
    m = entries(m, 9)
    return pack([m[0], m[3], m[2], m[5]])


def se2_apply(g, v) -> Column:
    c, s, x, y = entries(g, 4)
    p = entries(so2_apply([c, s], v), 2)
    return pack([p[0] + x, p[1] + y])


def se2_multiply(a, b) -> Column:
    b = entries(b, 4)
    return pack([*entries(so2_multiply(entries(a, 4)[:2], b[:2]), 2), *entries(se2_apply(a, b[2:]), 2)])


def se2_inverse(g) -> Column:
    c, s, x, y = entries(g, 4)
    return pack([c, -s, -(c * x + s * y), s * x - c * y])


def _se2_v(theta) -> tuple[Column, Column]:
    """sin(t)/t and (1 - cos(t))/t."""
    small = F.abs(theta) < 1e-4
    t = F.when(~small, theta)
    return _select(small, 1 - theta * theta / 6, F.sin(theta) / t), _select(small, theta / 2 - theta * theta * theta / 24, (1 - F.cos(theta)) / t)


def se2_exp(tangent) -> Column:
    """From [x, y, theta]."""
    x, y, theta = entries(tangent, 3)
    a, b = _se2_v(theta)
    return pack([F.cos(theta), F.sin(theta), a * x - b * y, b * x + a * y])


def se2_log(g) -> Column:
    c, s, x, y = entries(g, 4)
    theta = F.atan2(s, c)
    a, b = _se2_v(theta)
    d = a * a + b * b
    return pack([(a * x + b * y) / d, (a * y - b * x) / d, theta])


def se2_adjoint(g) -> Column:
    c, s, x, y = entries(g, 4)
    return pack([c, -s, y, s, c, -x, 0, 0, 1])


def se2_normalize(g) -> Column:
    g = entries(g, 4)
    return pack([*entries(so2_normalize(g[:2]), 2), *g[2:]])


def se2_sample(key, seed: int = 0) -> Column:
    return pack([*entries(so2_sample(key, seed), 2), uniform(key, seed + 1) * 2 - 1, uniform(key, seed + 2) * 2 - 1])


# SO(3): unit quaternion


def so3_identity() -> Column:
    return pack([1, 0, 0, 0])


def so3_about(axis: str, angle) -> Column:
    half = num(angle) / 2
    c, s = F.cos(half), F.sin(half)
    return pack([c, *(s if a == axis else 0 for a in "xyz")])


so3_exp = axis_angle_to_quaternion
so3_multiply, so3_apply, so3_inverse, so3_normalize = quat_multiply, quat_rotate, quat_conjugate, quat_normalize
so3_matrix, so3_from_matrix, so3_adjoint = quaternion_to_matrix, matrix_to_quaternion, quaternion_to_matrix
so3_log = quaternion_to_axis_angle
so3_from_rpy, so3_rpy = rpy_to_quaternion, quaternion_to_rpy


def roll(q) -> Column:
    return F.get(quaternion_to_rpy(q), F.lit(0))


def pitch(q) -> Column:
    return F.get(quaternion_to_rpy(q), F.lit(1))


def yaw(q) -> Column:
    return F.get(quaternion_to_rpy(q), F.lit(2))


def so3_sample(key, seed: int = 0) -> Column:
    """Uniform over rotations (three uniform numbers)."""
    a, b, c = uniform(key, seed), uniform(key, seed + 1) * (2 * math.pi), uniform(key, seed + 2) * (2 * math.pi)
    p, q = F.sqrt(1 - a), F.sqrt(a)
    return pack([p * F.sin(b), p * F.cos(b), q * F.sin(c), q * F.cos(c)])


# SE(3): [w, x, y, z, tx, ty, tz]


def se3_identity() -> Column:
    return pack([1, 0, 0, 0, 0, 0, 0])


def se3_from(rotation, translation) -> Column:
    return pack([*entries(rotation, 4), *entries(translation, 3)])


def se3_as_matrix(g) -> Column:
    g = entries(g, 7)
    return L.se3_matrix(quaternion_to_matrix(g[:4]), g[4:])


def se3_from_matrix(m) -> Column:
    return se3_from(matrix_to_quaternion(L.rotation_of(m)), L.translation_of(m))


def se3_apply(g, v) -> Column:
    g = entries(g, 7)
    return L.add(quat_rotate(g[:4], v), g[4:])


def se3_multiply(a, b) -> Column:
    b = entries(b, 7)
    return pack([*entries(quat_multiply(entries(a, 7)[:4], b[:4]), 4), *entries(se3_apply(a, b[4:]), 3)])


def se3_inverse(g) -> Column:
    g = entries(g, 7)
    q = quat_conjugate(g[:4])
    return pack([*entries(q, 4), *(-x for x in entries(quat_rotate(q, g[4:]), 3))])


def _se3_v(v, inverse: bool) -> Column:
    """The matrix between a tangent's translation and the motion's, or its inverse."""
    v = entries(v, 3)
    return _se3_terms(v, L.dot(v, v), inverse)


@binds
def _se3_terms(v, square, inverse: bool) -> Column:
    angle, small = F.sqrt(square), square < 1e-6
    t2 = F.when(~small, square)
    t = F.when(~small, angle)
    if inverse:
        first = F.lit(-0.5)
        second = _select(small, 1.0 / 12 + square / 720, (1 - t * F.cos(t / 2) / (2 * F.sin(t / 2))) / t2)
    else:
        first = _select(small, 0.5 - square / 24, (1 - F.cos(t)) / t2)
        second = _select(small, 1.0 / 6 - square / 120, (t - F.sin(t)) / (t2 * t))
    return _se3_mixed(v, first, second)


@binds
def _se3_mixed(v, first, second) -> Column:
    k = entries(L.skew(v), 9)
    k2 = entries(L.matmul(k, k, 3, 3, 3), 9)
    return pack([float(i in (0, 4, 8)) + first * a + second * b for i, (a, b) in enumerate(zip(k, k2, strict=True))])


def se3_exp(tangent) -> Column:
    """From [translation, rotation]."""
    x = entries(tangent, 6)
    return se3_from(so3_exp(x[3:]), L.matvec(_se3_v(x[3:], False), x[:3], 3))


def se3_log(g) -> Column:
    g = entries(g, 7)
    omega = so3_log(g[:4])
    return pack([*entries(L.matvec(_se3_v(omega, True), g[4:], 3), 3), *entries(omega, 3)])


def se3_adjoint(g) -> Column:
    g = entries(g, 7)
    r = entries(quaternion_to_matrix(g[:4]), 9)
    tr = entries(L.matmul(L.skew(g[4:]), r, 3, 3, 3), 9)
    top = [x for i in range(3) for x in (*r[3 * i : 3 * i + 3], *tr[3 * i : 3 * i + 3])]
    return pack([*top, *(x for i in range(3) for x in (0, 0, 0, *r[3 * i : 3 * i + 3]))])


def se3_normalize(g) -> Column:
    g = entries(g, 7)
    return pack([*entries(quat_normalize(g[:4]), 4), *g[4:]])


def se3_sample(key, seed: int = 0) -> Column:
    return pack([*entries(so3_sample(key, seed), 4), *(uniform(key, seed + 3 + i) * 2 - 1 for i in range(3))])


# poses of bodies, normals and planes


def transform_plane(plane, transform) -> Column:
    """A plane n.p + d = 0 in the frame that ``transform`` maps to."""
    n = entries(plane, 4)
    return _plane_through(L.matvec(L.rotation_of(transform), n[:3], 3), n[3], L.translation_of(transform))


@binds
def _plane_through(turned, d, shift) -> Column:
    return pack([*entries(turned, 3), d - L.dot(turned, shift)])


def points_to_body(point, rotation, translation) -> Column:
    """Inverse of points_to_world; columns of the rotation are the body's axes."""
    return L.matvec(L.transpose(rotation, 3), L.sub(point, translation), 3)


def points_to_world(point, rotation, translation) -> Column:
    return L.add(L.matvec(rotation, point, 3), translation)


def pose_inverse(transform) -> Column:
    return L.inverse_rigid(transform)


bind_all(globals(), __name__)
