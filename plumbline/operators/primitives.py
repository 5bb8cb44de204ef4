"""Planar and superquadric primitives: hulls, boxes, fits, merging, refinement; polygons and voxel grids.

Rotations hold the body's axes as columns, body to world. Fits are folds over one segment's points
each and run for all segments in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of a primitive: log half-axes, rotation (row-major), centre, mean colour, number of points.
PRIMITIVE = "gid long, part int, s_log array<double>, r array<double>, t array<double>, color array<double>, n long"


def local_frame(normal: np.ndarray) -> np.ndarray:
    """Right-handed axes as columns, the normal last."""
    n = normal / np.linalg.norm(normal)
    other = np.eye(3)[int(np.argmin(np.abs(n)))]
    u = np.cross(other, n)
    u /= np.linalg.norm(u)
    return np.stack([u, np.cross(n, u), n], axis=1)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise; collinear points are left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for x, y in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if not (bx - ax) * (y - ay) - (by - ay) * (x - ax) <= 0:
                    break
                out.pop()
            out.append((x, y))
        return out[:-1]

    rows = list(zip(*p.T.tolist(), strict=True))  # plain numbers: the same values, without an array for each
    return np.array(half(rows) + half(rows[::-1]))


def polygon_area(corners: np.ndarray, legacy: bool = False) -> float:
    """Shoelace area; ``legacy`` adds the terms' absolute values, which is never smaller."""
    x, y = corners[:, 0], corners[:, 1]
    terms = x * np.roll(y, -1) - y * np.roll(x, -1)
    return 0.5 * float(np.abs(terms).sum() if legacy else abs(terms.sum()))


def is_clockwise(corners: np.ndarray) -> bool:
    x, y = corners[:, 0], corners[:, 1]
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) < 0


def min_area_rectangle(points: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Angle, centre, side lengths and area of the smallest rectangle: it has a side along the hull."""
    hull = convex_hull(points)
    if len(hull) < 2:
        return 0.0, points.mean(axis=0), np.zeros(2), 0.0
    sides = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.unique(np.round(np.arctan2(sides[:, 1], sides[:, 0]) % (math.pi / 2), 12)):
        c, s = math.cos(angle), math.sin(angle)
        turned = hull @ np.array([[c, -s], [s, c]])
        low, high = turned.min(axis=0), turned.max(axis=0)
        area = float(np.prod(high - low))
        if best is None or area < best[3] - 1e-15:
            best = (float(angle), (low + high) / 2 @ np.array([[c, s], [-s, c]]), high - low, area)
    return best


def minimal_box(points: np.ndarray, angles: int = 24, turn: float = math.pi / 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, centre and half sizes of the smallest of the boxes about principal axes turned about each axis.

    ``turn`` is made in so many steps: a quarter turn holds all boxes there are, a full one in as many steps is coarser.
    """
    center = points.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((points - center).T) if len(points) > 1 else np.eye(3))
    axes = axes[:, ::-1]
    if np.linalg.det(axes) < 0:
        axes[:, 2] = -axes[:, 2]
    best = None
    for axis in range(3):
        for k in range(angles):
            a = k * turn / angles
            turned = np.eye(3)
            i, j = [d for d in range(3) if d != axis]
            turned[i, i] = turned[j, j] = math.cos(a)
            turned[i, j], turned[j, i] = -math.sin(a), math.sin(a)
            r = axes @ turned
            local = points @ r
            low, high = local.min(axis=0), local.max(axis=0)
            volume = float(np.prod(np.maximum(high - low, 1e-9)))
            if best is None or volume < best[0] - 1e-15:
                best = (volume, r, r @ ((low + high) / 2), (high - low) / 2)
    return best[1:]


def plane_box(points: np.ndarray, normal: np.ndarray, low: float = 0.0, high: float = 0.99, thick: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, centre, half sizes and rectangularity of a box about a planar patch.

    In the plane it is the smallest rectangle, cut to quantiles; its thickness is the 0.95 quantile
    of distances, ``thick`` at least.
    """
    frame = local_frame(normal)
    center = points.mean(axis=0)
    local = (points - center) @ frame
    angle, *_ = min_area_rectangle(local[:, :2])
    c, s = math.cos(angle), math.sin(angle)
    r = frame @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    local = (points - center) @ r
    a, b = np.quantile(local[:, :2], low, axis=0), np.quantile(local[:, :2], high, axis=0)
    z = np.median(local[:, 2])
    half = np.append((b - a) / 2, max(thick, float(np.quantile(np.abs(local[:, 2] - z), 0.95))))
    hull = convex_hull(local[:, :2])
    box = float(np.prod(np.ptp(local[:, :2], axis=0)))
    fill = polygon_area(hull) / box if box > 0 and len(hull) > 2 else 0.0
    return r, center + r @ np.append((a + b) / 2, z), half, fill


def split_boxes(points: np.ndarray, normal: np.ndarray, *, least_fill: float = 0.7, splits: int = 3, least: int = 150) -> list[tuple[np.ndarray, tuple]]:
    """Boxes of a patch with the rows of each, split at the median of its longer axis until each is rectangular enough."""
    out, queue = [], [(np.arange(len(points)), 0)]
    while queue:
        rows, depth = queue.pop(0)
        p = points[rows]
        box = plane_box(p, normal)
        along = (p - box[1]) @ box[0][:, int(np.argmax(box[2][:2]))]
        first = along <= np.median(along)
        if box[3] >= least_fill or depth >= splits or min(first.sum(), (~first).sum()) < least:
            out.append((rows, box))
        else:
            queue += [(rows[first], depth + 1), (rows[~first], depth + 1)]
    return out


def consensus_plane(points: np.ndarray, iterations: int = 200, threshold: float = 0.02, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Normal and inliers of the plane of most inliers, refitted to them; the first of equals."""
    rng = np.random.Generator(np.random.PCG64(seed))
    best, normal = np.zeros(len(points), bool), np.array([0.0, 0.0, 1.0])
    for _ in range(iterations if len(points) >= 3 else 0):
        a, b, c = points[rng.choice(len(points), 3, replace=False)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size > 1e-12:
            inside = np.abs((points - a) @ (n / size)) <= threshold
            if inside.sum() > best.sum():
                best, normal = inside, n / size
    if best.sum() >= 3:
        own = points[best] - points[best].mean(axis=0)
        normal = np.linalg.svd(own, full_matrices=False)[2][2]
    return normal, best


def _row(gid: int, part: int, box: tuple, points: pd.DataFrame) -> tuple:
    r, t, half, _ = box
    color = points[["r", "g", "b"]].mean().tolist() if {"r", "g", "b"} <= set(points.columns) else [0.0, 0.0, 0.0]
    return gid, part, np.log(np.maximum(half, 0.02)).tolist(), r.ravel().tolist(), t.tolist(), color, len(points)


def fit_primitives(points: DataFrame, *, least_frames: int = 1, least: int = 50, threshold: float = 0.02, iterations: int = 200) -> DataFrame:
    """Boxes of each global segment of ``(gid, frame, id, x, y, z[, r, g, b])`` with enough frames and plane inliers."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if pdf["frame"].nunique() >= least_frames:
            pdf = pdf.sort_values("id").reset_index(drop=True)
            p = pdf[["x", "y", "z"]].to_numpy(float)
            normal, inside = consensus_plane(p, iterations, threshold)
            if inside.sum() >= least:
                own = pdf[inside].reset_index(drop=True)
                left = own[["x", "y", "z"]].to_numpy(float)
                for part, (members, box) in enumerate(split_boxes(left, normal)):
                    rows.append(_row(int(pdf["gid"].iloc[0]), part, box, own.iloc[members]))
        return pd.DataFrame(rows, columns=["gid", "part", "s_log", "r", "t", "color", "n"])

    return points.groupBy("gid").applyInPandas(fit, PRIMITIVE)


def fit_boxes(points: DataFrame, angles: int = 24, turn: float = math.pi / 2) -> DataFrame:
    """The minimal-volume box of each group of ``(gid, x, y, z)``: (gid, r, t, half)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r, t, half = minimal_box(pdf[["x", "y", "z"]].to_numpy(float), angles, turn)
        return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "r": [r.ravel().tolist()], "t": [t.tolist()], "half": [half.tolist()]})

    return points.groupBy("gid").applyInPandas(fit, "gid long, r array<double>, t array<double>, half array<double>")


def split_planes(points: DataFrame) -> DataFrame:
    """Parts of each planar patch of ``(gid, x, y, z, nx, ny, nz)``: (gid, part, n, fill)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = split_boxes(pdf[["x", "y", "z"]].to_numpy(float), pdf[["nx", "ny", "nz"]].mean().to_numpy(float))
        return pd.DataFrame({"gid": [pdf["gid"].iloc[0]] * len(parts), "part": range(len(parts)), "n": [len(p) for p, _ in parts], "fill": [float(b[3]) for _, b in parts]})

    return points.groupBy("gid").applyInPandas(fit, "gid long, part int, n long, fill double")


def united(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both primitive lists; those without half-axes, rotation or centre fail the read."""
    both = one.unionByName(other, allowMissingColumns=True)
    whole = F.col("s_log").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull()
    return both.withColumn("s_log", F.when(F.assert_true(whole, F.lit("a primitive lacks s, r or t")).isNull(), F.col("s_log")))


def merge_first_match(primitives: DataFrame, by: str, *, cosine: float = 0.9945, gap: float = 0.05) -> DataFrame:
    """Folds planes ``(by, id, n array, c array, area)`` in order of id into the first kept one that is parallel and near: (by, id, into)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        into = []
        pdf = pdf.sort_values("id")
        for row in pdf.itertuples():
            n, c = np.asarray(row.n, float), np.asarray(row.c, float)
            for k in kept:
                if abs(k[1] @ n) >= cosine and abs(k[1] @ (c - k[2])) <= gap:
                    k[2] = (k[2] * k[3] + c * row.area) / max(k[3] + row.area, 1e-9)
                    k[3] += row.area
                    into.append(k[0])
                    break
            else:
                kept.append([row.id, n, c, row.area])
                into.append(row.id)
        return pd.DataFrame({by: pdf[by].to_numpy(), "id": pdf["id"].to_numpy(), "into": into})

    return primitives.groupBy(by).applyInPandas(fold, f"{by} {dict(primitives.dtypes)[by]}, id long, into long")


def reduce_components(planes: DataFrame) -> DataFrame:
    """Each component of ``(component, id, area, color array, corners array of points)``: area-weighted colour and bounds of the corners."""
    c = lambda i: F.sum(F.get("color", F.lit(i)) * F.col("area")) / F.greatest(F.sum("area"), F.lit(1e-6))
    mean = planes.groupBy("component").agg(F.min("id").alias("id"), F.sum("area").alias("area"), F.array(*(c(i) for i in range(3))).alias("color"))
    corners = planes.select("component", F.explode("corners").alias("p"))
    ends = corners.groupBy("component").agg(*(f(F.get("p", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(3)))
    return mean.join(ends, "component").select("component", "id", "area", "color", F.array(*(F.col(f"low{i}") for i in range(3))).alias("low"), F.array(*(F.col(f"high{i}") for i in range(3))).alias("high"))


def gradient_icp(pairs: DataFrame, steps: int = 100) -> DataFrame:
    """Aligns two small clouds of each group ``(gid, side 'a' or 'b', x, y, z)`` by nearest neighbours: (gid, scale, r, t, error).

    Each step solves for the best similarity of a onto its neighbours in b, until the error stays.
    """

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.loc[pdf["side"] == s, ["x", "y", "z"]].to_numpy(float) for s in "ab")
        scale, r, t, last = 1.0, np.eye(3), np.zeros(3), np.inf
        for _ in range(steps):
            moved = scale * a @ r.T + t
            d = ((moved[:, None] - b[None]) ** 2).sum(-1)
            target, error = b[d.argmin(axis=1)], float(np.sqrt(d.min(axis=1)).mean())
            if last - error < 1e-12:
                break
            last = error
            ca, cb = a.mean(axis=0), target.mean(axis=0)
            u, s, vt = np.linalg.svd((a - ca).T @ (target - cb))
            sign = np.sign(np.linalg.det(vt.T @ u.T))
            r = vt.T @ np.diag([1, 1, sign]) @ u.T
            scale = float((s * [1, 1, sign]).sum() / max(((a - ca) ** 2).sum(), 1e-12))
            t = cb - scale * r @ ca
        return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "scale": [scale], "r": [r.ravel().tolist()], "t": [t.tolist()], "error": [last]})

    return pairs.groupBy("gid").applyInPandas(align, "gid long, scale double, r array<double>, t array<double>, error double")


def refine_superquadrics(points: DataFrame, primitives: DataFrame, *, steps: int = 4, rate: float = 0.0) -> DataFrame:
    """Lowers each primitive's mean squared inside-outside value over its points by gradient steps in its half-axes and centre.

    The best state of all steps is kept. With the default rate of 0 primitives stay as they are.
    ``points``: (gid, x, y, z); ``primitives``: (gid, s_log, r, t, eps).
    """
    joined = points.groupBy("gid").agg(F.array_sort(F.collect_list(F.array("x", "y", "z"))).alias("points")).join(primitives.select("gid", "s_log", "r", "t", "eps"), "gid")

    def loss(q: np.ndarray, p: np.ndarray, r: np.ndarray, eps: Sequence[float]) -> float:
        local = np.maximum(np.abs((p - q[3:]) @ r) / np.exp(q[:3]), 1e-6)
        f = (local[:, 0] ** (2 / eps[1]) + local[:, 1] ** (2 / eps[1])) ** (eps[1] / eps[0]) + local[:, 2] ** (2 / eps[0])
        return float(((f ** eps[0] - 1) ** 2).mean())

    def refine(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                p, r = np.array(list(map(list, row.points))), np.array(row.r).reshape(3, 3)
                q = np.array([*row.s_log, *row.t], float)
                best, least = q.copy(), loss(q, p, r, row.eps)
                for _ in range(steps):
                    slope = np.array([(loss(q + h, p, r, row.eps) - loss(q - h, p, r, row.eps)) / 2e-5 for h in np.eye(6) * 1e-5])
                    q = q - rate * slope
                    now = loss(q, p, r, row.eps)
                    if now < least:
                        best, least = q.copy(), now
                rows.append((row.gid, best[:3].tolist(), list(row.r), best[3:].tolist(), list(row.eps), least))
            yield pd.DataFrame(rows, columns=["gid", "s_log", "r", "t", "eps", "loss"])

    return joined.mapInPandas(refine, "gid long, s_log array<double>, r array<double>, t array<double>, eps array<double>, loss double")


def integrate_tsdf(observations: DataFrame, truncation: float) -> DataFrame:
    """Running weighted mean of truncated distances by voxel: ``(i, j, k, sdf, weight)`` to (i, j, k, tsdf, weight)."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sdf") / truncation))
    return observations.groupBy("i", "j", "k").agg((F.sum(clipped * F.col("weight")) / F.sum("weight")).alias("tsdf"), F.sum("weight").alias("weight"))


def padded_cube(voxels: DataFrame, size: int) -> DataFrame:
    """Voxels moved so that their bounds lie in the middle of a cube of ``size``."""
    ends = voxels.agg(*(((F.lit(size) - (F.max(c) - F.min(c) + 1)) / 2 - F.min(c)).alias(f"_{c}") for c in "ijk"))
    return voxels.join(ends).withColumns({c: (F.col(c) + F.floor(f"_{c}")).cast("int") for c in "ijk"}).drop("_i", "_j", "_k")


def trace_outline(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines of a mask's regions along pixel edges, corners as (x, y); holes run the other way."""
    padded = np.pad(mask.astype(bool), 1)
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(padded), strict=True):
        for (dy, dx), (a, b) in (((-1, 0), ((0, 0), (0, 1))), ((0, 1), ((0, 1), (1, 1))), ((1, 0), ((1, 1), (1, 0))), ((0, -1), ((1, 0), (0, 0)))):
            if not padded[y + dy, x + dx]:
                steps.setdefault((x + a[1] - 1, y + a[0] - 1), []).append((x + b[1] - 1, y + b[0] - 1))
    out = []
    while steps:
        start = min(steps)
        path, at = [start], start
        while True:
            following = steps[at].pop(0)
            if not steps[at]:
                del steps[at]
            if following == start:
                break
            path.append(following)
            at = following
        p = np.array(path)
        straight = (np.roll(p, -1, axis=0) - p == p - np.roll(p, 1, axis=0)).all(axis=1)
        out.append(p[~straight])
    return out


def fill_polygon(corners: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centres lie inside (even-odd)."""
    y, x = np.mgrid[:height, :width] + 0.5
    inside = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        if y0 != y1:
            inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def merged_contours(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """One contour that runs along ``inner`` from the corner nearest to ``outer`` and back."""
    d = ((outer[:, None] - inner[None]) ** 2).sum(-1)
    i, j = np.unravel_index(np.argmin(d), d.shape)
    loop = np.concatenate([inner[j:], inner[: j + 1]])
    return np.concatenate([outer[: i + 1], loop, outer[i:]])


def mask_polygons(masks: DataFrame) -> DataFrame:
    """Outlines of each mask of true pixels ``(mask_id, y, x)``: (mask_id, ring, hole, xs, ys)."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        grid = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        grid[y - y.min(), x - x.min()] = True
        rings = [r + [x.min(), y.min()] for r in trace_outline(grid)]
        return pd.DataFrame({"mask_id": [pdf["mask_id"].iloc[0]] * len(rings), "ring": range(len(rings)), "hole": [is_clockwise(r) for r in rings], "xs": [r[:, 0].tolist() for r in rings], "ys": [r[:, 1].tolist() for r in rings]})

    return masks.groupBy("mask_id").applyInPandas(trace, "mask_id long, ring int, hole boolean, xs array<long>, ys array<long>")


def polygon_pixels(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of ``(mask_id, xs, ys)`` polygons."""

    def fill(batches):
        for pdf in batches:
            parts = []
            for row in pdf.itertuples():
                y, x = np.nonzero(fill_polygon(np.stack([row.xs, row.ys], axis=1).astype(float), height, width))
                parts.append(pd.DataFrame({"mask_id": row.mask_id, "y": y, "x": x}))
            yield pd.concat(parts) if parts else pd.DataFrame({"mask_id": [], "y": [], "x": []})

    return polygons.mapInPandas(fill, "mask_id long, y int, x int")


def plane_surfaces(points: DataFrame, cell: float = 0.05) -> DataFrame:
    """Triangulates each plane's points ``(plane_id, x, y, z, plane array)`` on a grid in the plane: (plane_id, tri, corners)."""

    def triangulate(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.array(pdf["plane"].iloc[0], float)
        frame = local_frame(plane[:3])
        local = pdf[["x", "y", "z"]].to_numpy(float) @ frame
        cells = np.unique(np.floor(local[:, :2] / cell).astype(int), axis=0)
        level = -plane[3] / np.linalg.norm(plane[:3])
        rows = []
        for i, j in cells:
            q = [np.array([a * cell, b * cell, level]) @ frame.T for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
            rows += [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
        return pd.DataFrame({"plane_id": [pdf["plane_id"].iloc[0]] * len(rows), "tri": range(len(rows)), "corners": [[p.tolist() for p in r] for r in rows]})

    return points.groupBy("plane_id").applyInPandas(triangulate, "plane_id long, tri int, corners array<array<double>>")


def normals_by_neighbours(pairs: DataFrame, least: int = 3) -> DataFrame:
    """PCA normals of points from neighbour pairs ``(id, x, y, z)``, a row a neighbour: (id, normal, n), null below ``least``.

    Second moments are sums, so a point's neighbours never meet in one row; only the 3x3 matrix of
    each point goes through a vectorised eigen solver.
    """
    c = {"xx": ("x", "x"), "xy": ("x", "y"), "xz": ("x", "z"), "yy": ("y", "y"), "yz": ("y", "z"), "zz": ("z", "z")}
    sums = pairs.groupBy("id").agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(k) for k, (a, b) in c.items()))

    def solve(batches):
        for pdf in batches:
            m = np.empty((len(pdf), 3, 3))
            for k, (a, b) in c.items():
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = pdf[k].fillna(0.0)
            n = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.empty((0, 3))
            ok = pdf["n"].to_numpy() >= least
            yield pd.DataFrame({"id": pdf["id"], "normal": [v.tolist() if good else None for v, good in zip(n, ok, strict=True)], "n": pdf["n"]})

    return sums.mapInPandas(solve, f"id {dict(pairs.dtypes)['id']}, normal array<double>, n long")
