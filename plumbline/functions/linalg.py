"""Small vectors and matrices as ``array<double>`` columns (row-major)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.binding import bind_all, binds

Entries = list[Column]


def num(x) -> Column:
    """A column as it is, anything else as a double."""
    return x if isinstance(x, Column) else F.lit(float(x))


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack(entries: Sequence) -> Column:
    """An array column that remembers its entries, so that taking one builds no array."""
    values = [num(x).cast("double") for x in entries]
    out = F.array(*values)
    out.__dict__["entries_"] = values
    return out


def entries(a, n: int) -> Entries:
    """The first n entries of an array column, or of a list of entries as it is."""
    if isinstance(a, (list, tuple)):
        return list(map(num, a))
    a = col(a)
    return a.__dict__.get("entries_") or [F.get(a, F.lit(i)) for i in range(n)]


def add_all(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def dot(a, b, n: int = 3) -> Column:
    return add_all([x * y for x, y in zip(entries(a, n), entries(b, n), strict=True)])


def norm(a, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def cross(a, b) -> Column:
    (ax, ay, az), (bx, by, bz) = entries(a, 3), entries(b, 3)
    return pack([ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx])


def add(a, b, n: int = 3) -> Column:
    return pack([x + y for x, y in zip(entries(a, n), entries(b, n), strict=True)])


def sub(a, b, n: int = 3) -> Column:
    return pack([x - y for x, y in zip(entries(a, n), entries(b, n), strict=True)])


def scale(a, s, n: int = 3) -> Column:
    return pack([x * num(s) for x in entries(a, n)])


def normalize(a, n: int = 3, eps: float = 0.0) -> Column:
    """Unit vector; null for a zero vector, or divided by eps at least if eps is given."""
    size = norm(a, n)
    return _divided(entries(a, n), F.greatest(size, F.lit(eps)) if eps else F.when(size > 0, size))


@binds
def _divided(a, size) -> Column:
    return pack([x / size for x in a])


def distance(a, b, n: int = 3) -> Column:
    return F.sqrt(add_all([(x - y) * (x - y) for x, y in zip(entries(a, n), entries(b, n), strict=True)]))


def array_dot(a, b) -> Column:
    """Inner product of arrays of any length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_distance(a, b) -> Column:
    """Euclidean distance of arrays of any length."""
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def matmul(a, b, n: int, k: int, m: int) -> Column:
    """(n, k) times (k, m)."""
    x, y = entries(a, n * k), entries(b, k * m)
    return pack([add_all([x[i * k + r] * y[r * m + j] for r in range(k)]) for i in range(n) for j in range(m)])


def matvec(a, v, n: int, k: int | None = None) -> Column:
    k = k or n
    x, y = entries(a, n * k), entries(v, k)
    return pack([add_all([x[i * k + r] * y[r] for r in range(k)]) for i in range(n)])


def transpose(a, n: int, m: int | None = None) -> Column:
    m = m or n
    x = entries(a, n * m)
    return pack([x[i * m + j] for j in range(m) for i in range(n)])


def identity(n: int) -> Column:
    return pack([float(i == j) for i in range(n) for j in range(n)])


def _minor(x: Entries, n: int, row: int, column: int) -> Entries:
    return [x[i * n + j] for i in range(n) for j in range(n) if i != row and j != column]


def _det(x: Entries, n: int) -> Column:
    if n == 1:
        return x[0]
    return add_all([(x[j] if j % 2 == 0 else -x[j]) * _det(_minor(x, n, 0, j), n - 1) for j in range(n)])


def det(a, n: int = 3) -> Column:
    return _det(entries(a, n * n), n)


def inverse(a, n: int = 3) -> Column:
    """Inverse by cofactors; null entries if the determinant is 0."""
    x = entries(a, n * n)
    d = _det(x, n)
    d = F.when(d != 0, d)
    return pack([(1 if (i + j) % 2 == 0 else -1) * _det(_minor(x, n, j, i), n - 1) / d for i in range(n) for j in range(n)])


def rows(a, n: int, m: int, keep: Sequence[int], width: int | None = None) -> Column:
    """Some rows of an (n, m) matrix, their first ``width`` entries."""
    x = entries(a, n * m)
    return pack([x[i * m + j] for i in keep for j in range(width or m)])


def skew(v) -> Column:
    x, y, z = entries(v, 3)
    return pack([0, -z, y, z, 0, -x, -y, x, 0])


def se3_matrix(rotation, translation) -> Column:
    """4x4 matrix of a 3x3 rotation and a translation."""
    r, t = entries(rotation, 9), entries(translation, 3)
    return pack([*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], 0, 0, 0, 1])


def rotation_of(transform) -> Column:
    x = entries(transform, 16)
    return pack([x[4 * i + j] for i in range(3) for j in range(3)])


def translation_of(transform) -> Column:
    x = entries(transform, 16)
    return pack([x[3], x[7], x[11]])


def apply_transform(transform, point) -> Column:
    x, p = entries(transform, 16), entries(point, 3)
    return pack([x[4 * i] * p[0] + x[4 * i + 1] * p[1] + x[4 * i + 2] * p[2] + x[4 * i + 3] for i in range(3)])


def inverse_rigid(transform) -> Column:
    """Inverse of a rotation and translation."""
    r = entries(transpose(rotation_of(transform), 3), 9)
    t = entries(translation_of(transform), 3)
    return se3_matrix(r, [-(r[3 * i] * t[0] + r[3 * i + 1] * t[1] + r[3 * i + 2] * t[2]) for i in range(3)])


def to_4x4(rotation, translation) -> Column:
    return se3_matrix(rotation, translation)


def homogeneous(v, n: int = 3) -> Column:
    return pack([*entries(v, n), 1])


bind_all(globals(), __name__, ("num", "col", "pack", "entries", "add_all", "identity"))
