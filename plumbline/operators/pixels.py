"""Operators on pixel tables ``(t, y, x, ...)``: masks, clouds, separable windows, warps and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import camera
from plumbline.functions import linalg as L


def clean_frames(pixels: DataFrame, t: int | None = None) -> DataFrame:
    """A frame's pixels (all without ``t``): confidence 1 and mask false where absent, depth clipped to [1e-4, 99999]."""
    out = pixels if t is None else pixels.filter(F.col("t") == t)
    return out.withColumns({"conf": F.coalesce("conf", F.lit(1.0)), "mask": F.coalesce("mask", F.lit(False)), "depth": F.least(F.greatest("depth", F.lit(1e-4)), F.lit(99999.0))})


def scaled_bundle(frames: DataFrame) -> DataFrame:
    """Camera translations times the scale, and fy = fx. ``frames``: (seq, t, k, c2w, scale)."""
    k, m = L.entries("k", 9), L.entries("c2w", 16)
    c2w = L.pack([v * F.col("scale") if i in (3, 7, 11) else v for i, v in enumerate(m)])
    return frames.withColumns({"k": L.pack([k[0], k[1], k[2], k[3], k[0], *k[5:]]), "c2w": c2w})


def overlay(base: DataFrame, other: DataFrame, keys: Sequence[str], override: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Left join in which ``override`` columns come from ``other`` where present, and ``fill`` columns only where absent in ``base``."""
    other = other.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in (*override, *fill)))
    joined = base.join(other, list(keys), "left")
    values = {c: F.coalesce(f"_o_{c}", c) if c in base.columns else F.col(f"_o_{c}") for c in override}
    values |= {c: F.coalesce(c, f"_o_{c}") if c in base.columns else F.col(f"_o_{c}") for c in fill}
    return joined.withColumns(values).drop(*(f"_o_{c}" for c in (*override, *fill)))


def back_projected(pixels: DataFrame, cameras: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """World points of pixels; ``cameras``: (keys, k, c2w), a row a frame."""
    joined = pixels.join(cameras.select(*keys, "k", "c2w"), list(keys))
    p = camera.back_project(F.col("x"), F.col("y"), F.col("depth"), F.col("k"), F.col("c2w"))
    return joined.withColumn("_p", p).select("*", *(F.get("_p", F.lit(i)).alias(f"w{c}") for i, c in enumerate("xyz"))).drop("_p", "k", "c2w")


def _square(df: DataFrame, value: Column, by: Sequence[str], radius: int, low: bool, high: bool) -> DataFrame:
    """Adds _low and _high, the least and greatest value of the square around, by rows and then by columns."""
    across = W.partitionBy(*by, "y").orderBy("x").rangeBetween(-radius, radius)
    down = W.partitionBy(*by, "x").orderBy("y").rangeBetween(-radius, radius)
    wanted = [(n, f) for n, f, on in (("_low", F.min, low), ("_high", F.max, high)) if on]
    df = df.withColumn("_v", value)
    df = df.select("*", *(f("_v").over(across).alias(f"{n}1") for n, f in wanted))
    return df.select("*", *(f(f"{n}1").over(down).alias(n) for n, f in wanted)).drop("_v", *(f"{n}1" for n, _ in wanted))


def max_pool_2d(df: DataFrame, value: str, by: Sequence[str] = ("t",), radius: int = 1, out: str = "pooled") -> DataFrame:
    """NaN counts as absent; only pixels that are there take part."""
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return _square(df, clean, by, radius, False, True).withColumnRenamed("_high", out)


def depth_edge(df: DataFrame, by: Sequence[str] = ("t",), *, rtol: float = 0.03, out: str = "edge") -> DataFrame:
    """Whether depth varies by more than rtol of itself in the 3x3 around."""
    clean = F.when(~F.isnan("depth"), F.col("depth"))
    found = _square(df, clean, by, 1, True, True)
    return found.withColumn(out, F.coalesce((F.col("_high") - F.col("_low")) / F.col("depth") > rtol, F.lit(False))).drop("_low", "_high")


def depth_aliasing(df: DataFrame, by: Sequence[str] = ("t",), out: str = "aliasing") -> DataFrame:
    found = _square(df, F.col("depth"), by, 1, True, True)
    return found.withColumn(out, F.least(F.col("_high") - F.col("depth"), F.col("depth") - F.col("_low"))).drop("_low", "_high")


def dilate(df: DataFrame, mask: str, by: Sequence[str] = ("t",), radius: int = 11, out: str = "dilated") -> DataFrame:
    """Whether a true pixel lies within a disk; only true pixels are spread."""
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    spread = df.filter(mask).select(*by, "y", "x", F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))).alias("s"))
    hit = spread.select(*by, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct().withColumn(out, F.lit(True))
    return df.join(hit, [*by, "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def boundary(df: DataFrame, mask: str, by: Sequence[str] = ("t",), out: str = "boundary") -> DataFrame:
    """True pixels of which one in the 3x3 around is false or absent."""
    found = _square(df.withColumn("_one", F.lit(1)), F.col(mask).cast("int"), by, 1, True, False)
    across = W.partitionBy(*by, "y").orderBy("x").rangeBetween(-1, 1)
    down = W.partitionBy(*by, "x").orderBy("y").rangeBetween(-1, 1)
    found = found.withColumn("_n1", F.sum("_one").over(across)).withColumn("_n", F.sum("_n1").over(down))
    return found.withColumn(out, F.col(mask) & ((F.col("_low") == 0) | (F.col("_n") < 9))).drop("_low", "_one", "_n1", "_n")


def _neighbours(df: DataFrame, columns: Sequence[str], by: Sequence[str], steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Each pixel with each neighbour's columns as n_*."""
    spread = df.select(*by, "y", "x", *(F.col(c).alias(f"n_{c}") for c in columns)).withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))))
    spread = spread.select(*by, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), *(f"n_{c}" for c in columns))
    return df.join(spread, [*by, "y", "x"])


_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def normals_edge(df: DataFrame, tolerance: float, by: Sequence[str] = ("t",), out: str = "edge") -> DataFrame:
    """Whether the largest angle between the pixel's or a neighbour's normal and those around it exceeds the tolerance (radians)."""
    pairs = _neighbours(df, ["nx", "ny", "nz"], by, _AROUND)
    cosine = F.col("nx") * F.col("n_nx") + F.col("ny") * F.col("n_ny") + F.col("nz") * F.col("n_nz")
    angle = pairs.groupBy(*by, "y", "x").agg(F.max(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("_a"))
    joined = df.join(angle, [*by, "y", "x"], "left")
    return _square(joined, F.col("_a"), by, 1, False, True).withColumn(out, F.coalesce(F.col("_high") > tolerance, F.lit(False))).drop("_a", "_high")


def normals_from_points(df: DataFrame, by: Sequence[str] = ("t",), mask: str | None = None) -> DataFrame:
    """Unit normals: the mean of the four cross products of up, left, down and right differences that exist; px, py, pz are points."""
    valid = df if mask is None else df.filter(mask)
    p = F.struct("px", "py", "pz")
    row, column = W.partitionBy(*by, "y").orderBy("x"), W.partitionBy(*by, "x").orderBy("y")
    at = lambda w, axis, d: F.when(F.lag(axis, -d).over(w) == F.col(axis) + d, F.lag(p, -d).over(w))
    valid = valid.withColumns({"_u": at(column, "y", -1), "_l": at(row, "x", -1), "_d": at(column, "y", 1), "_r": at(row, "x", 1)})
    diff = lambda c: [F.col(f"{c}.{k}") - F.col(k) for k in ("px", "py", "pz")]
    units = [L.normalize(L.cross(diff(a), diff(b))) for a, b in (("_u", "_l"), ("_l", "_d"), ("_d", "_r"), ("_r", "_u"))]
    valid = valid.withColumn("_n", F.filter(F.array(*units), lambda n: n.isNotNull() & F.get(n, F.lit(0)).isNotNull()))
    summed = lambda i: F.aggregate("_n", F.lit(0.0), lambda s, n: s + F.get(n, F.lit(i)))
    total = [summed(i) for i in range(3)]
    unit = L.normalize(total)
    return valid.withColumn("_m", unit).select("*", *(F.get("_m", F.lit(i)).alias(f"n{c}") for i, c in enumerate("xyz"))).drop("_u", "_l", "_d", "_r", "_n", "_m")


def depth_to_normals(df: DataFrame, k: Column, by: Sequence[str] = ("t",), mask: str | None = None) -> DataFrame:
    """Camera-space normals of a depth map."""
    ray = L.matvec(camera.inverse_intrinsics(k), [F.col("x") + 0.5, F.col("y") + 0.5, F.lit(1.0)], 3)
    p = L.scale(ray, F.col("depth"))
    placed = df.withColumn("_p", p).select("*", *(F.get("_p", F.lit(i)).alias(f"p{c}") for i, c in enumerate("xyz"))).drop("_p")
    return normals_from_points(placed, by, mask)


def classified(pixels: DataFrame, by: Sequence[str] = ("t",), *, quantile: float = 0.8, radius: int = 11, rtol: float = 0.03, confidence: float | None = None, objects: str | None = None) -> DataFrame:
    """Adds ``kind``: foreground (dynamic mask), background, object or dropped.

    A background pixel is dropped if the dilated mask covers it, it lies on a depth edge, its depth is
    above the frame's quantile or its confidence too low.
    """
    found = depth_edge(dilate(pixels, "mask", by, radius, "_near"), by, rtol=rtol, out="_edge")
    limit = pixels.groupBy(*by).agg(F.percentile("depth", F.lit(quantile)).alias("_limit"))
    found = found.join(limit, list(by))
    bad = F.col("_near") | F.col("_edge") | (F.col("depth") > F.col("_limit"))
    if confidence is not None:
        bad = bad | (F.col("conf") < confidence)
    kind = F.when(F.col("mask"), "foreground")
    if objects:
        kind = kind.when(F.col(objects), "object")
    return found.withColumn("kind", kind.when(F.coalesce(bad, F.lit(True)), "dropped").otherwise("background")).drop("_near", "_edge", "_limit")


def strided(pixels: DataFrame, step: int) -> DataFrame:
    return pixels.filter((F.col("y") % step == 0) & (F.col("x") % step == 0))


def resize_nearest(pixels: DataFrame, shape: tuple[int, int], to: tuple[int, int], by: Sequence[str] = ("t",)) -> DataFrame:
    """Resizes (h, w) to (H, W): the target pixel takes source floor(y * h / H), floor(x * w / W)."""
    (h, w), (high, wide) = shape, to
    spark = pixels.sparkSession
    grid = spark.range(high * wide).select(F.floor(F.col("id") / wide).cast("int").alias("ty"), (F.col("id") % wide).cast("int").alias("tx"))
    grid = grid.select("ty", "tx", F.floor(F.col("ty") * h / high).cast("int").alias("y"), F.floor(F.col("tx") * w / wide).cast("int").alias("x"))
    return pixels.join(grid, ["y", "x"]).drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})


def valid_unit_vectors(df: DataFrame, coords: Sequence[str], tolerance: float = 1e-2) -> DataFrame:
    """Rows whose vector is finite and of length 1 within the tolerance."""
    finite, square = F.lit(True), F.lit(0.0)
    for c in coords:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        square = square + F.col(c) * F.col(c)
    return df.filter(finite & (F.abs(F.sqrt(square) - 1) < tolerance))


def in_rectangle(points: DataFrame, u: str, v: str, corner: tuple[float, float], opposite: tuple[float, float]) -> DataFrame:
    """Points strictly inside a rectangle given by any two opposite corners."""
    (a, b), (c, d) = corner, opposite
    return points.filter((F.col(u) > min(a, c)) & (F.col(u) < max(a, c)) & (F.col(v) > min(b, d)) & (F.col(v) < max(b, d)))


def observed(points: DataFrame, mask: DataFrame, origin: Sequence[float], size: float, plane: Sequence[float] | None = None) -> DataFrame:
    """Points whose (half-even rounded) cell is in ``mask(i, j, k)`` and that lie on the plane's positive side."""
    keys = [F.bround((F.col(c) - o) / size).cast("long").alias(n) for c, n, o in zip("xyz", "ijk", origin, strict=True)]
    if plane is not None:
        points = points.filter(F.col("x") * plane[0] + F.col("y") * plane[1] + F.col("z") * plane[2] + plane[3] > 0)
    return points.select("*", *keys).join(mask.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi").drop("i", "j", "k")


def static_depth(pixels: DataFrame) -> DataFrame:
    """The mean valid depth of each pixel over all frames, in every frame."""
    mean = pixels.groupBy("y", "x").agg(F.avg(F.when(F.col("depth") > 0, F.col("depth"))).alias("_mean"))
    return pixels.join(mean, ["y", "x"]).withColumn("depth", F.col("_mean")).drop("_mean")


def warp_overlap(labels: DataFrame, flow: DataFrame, height: int, width: int) -> DataFrame:
    """Label overlaps between frames under flow: (fi, fj, seg1, seg2, n, n1, ratio).

    labels: (t, y, x, seg); flow: (fi, fj, y, x, dx, dy). Targets are rounded half to even and must lie
    in the image. ``ratio`` is of the first segment's pixels that have a flow.
    """
    moved = flow.join(labels.select(F.col("t").alias("fi"), "y", "x", F.col("seg").alias("seg1")), ["fi", "y", "x"])
    moved = moved.select("fi", "fj", "seg1", F.bround(F.col("x") + F.col("dx")).cast("int").alias("x"), F.bround(F.col("y") + F.col("dy")).cast("int").alias("y"))
    moved = moved.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    sizes = moved.groupBy("fi", "fj", "seg1").agg(F.count("*").alias("n1"))
    hits = moved.join(labels.select(F.col("t").alias("fj"), "y", "x", F.col("seg").alias("seg2")), ["fj", "y", "x"]).groupBy("fi", "fj", "seg1", "seg2").agg(F.count("*").alias("n"))
    return hits.join(sizes, ["fi", "fj", "seg1"]).withColumn("ratio", F.col("n") / F.col("n1"))


def scored_overlaps(overlaps: DataFrame, normals: DataFrame, *, least: int = 50, ratio: float = 0.3, cosine: float = 0.9) -> DataFrame:
    """Score cos * ratio * n / 100 of overlaps that pass all three bounds; ``normals``: (t, seg, normal)."""
    a = normals.select(F.col("t").alias("fi"), F.col("seg").alias("seg1"), F.col("normal").alias("n1v"))
    b = normals.select(F.col("t").alias("fj"), F.col("seg").alias("seg2"), F.col("normal").alias("n2v"))
    kept = overlaps.filter((F.col("n") >= least) & (F.col("ratio") >= ratio)).join(a, ["fi", "seg1"]).join(b, ["fj", "seg2"]).withColumn("cos", L.dot("n1v", "n2v"))
    return kept.filter(F.col("cos") >= cosine).withColumn("score", F.col("cos") * F.col("ratio") * F.col("n") / 100).drop("n1v", "n2v")


def z_buffer(points: DataFrame, by: Sequence[str], depth: str, value: str, tie: str) -> DataFrame:
    """The nearest point's value in each cell; ties to the smaller ``tie``."""
    return points.groupBy(*by).agg(F.min_by(value, F.struct(depth, tie)).alias(value), F.min(depth).alias(depth))


def painted(masks: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value painted last on each pixel."""
    return masks.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def projected(points: DataFrame, k: Column, extrinsics: Column, height: int, width: int, near: float = 0.1) -> DataFrame:
    """Points in front of the camera and inside the image, with their pixel (px, py) and depth."""
    uv, depth = camera.project_cv([F.col("x"), F.col("y"), F.col("z")], k, extrinsics)
    found = points.withColumns({"_uv": uv, "depth": depth}).filter(F.col("depth") > near)
    found = found.select("*", F.floor(F.get("_uv", F.lit(0))).cast("int").alias("px"), F.floor(F.get("_uv", F.lit(1))).cast("int").alias("py")).drop("_uv")
    return found.filter((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))


def unmasked_by_projection(pixels: DataFrame, points: DataFrame, k: Column, extrinsics: Column, height: int, width: int, radius: int = 3) -> DataFrame:
    """Pixels ``(t, y, x)`` on whose disk no world point projects."""
    hit = projected(points, k, extrinsics, height, width).select(F.col("py").alias("y"), F.col("px").alias("x")).distinct()
    marked = pixels.join(hit.withColumn("_hit", F.lit(True)), ["y", "x"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return dilate(marked, "_hit", ("t",), radius, "_near").filter("NOT _near").drop("_hit", "_near")


def keypoint_segments(images: DataFrame, points3d: DataFrame, labels: DataFrame) -> DataFrame:
    """3D key points of each image segment: (image_id, seg, points).

    images: (id, xys array of structs x, y, point3d_ids); points3d: (id, xyz); labels: (image_id, y, x, seg).
    """
    seen = images.select(F.col("id").alias("image_id"), F.explode(F.arrays_zip("xys", "point3d_ids")).alias("o"))
    seen = seen.select("image_id", F.floor("o.xys.y").cast("int").alias("y"), F.floor("o.xys.x").cast("int").alias("x"), F.col("o.point3d_ids").alias("point_id")).filter("point_id >= 0")
    joined = seen.join(points3d.select(F.col("id").alias("point_id"), "xyz"), "point_id").join(labels, ["image_id", "y", "x"]).filter("seg IS NOT NULL AND seg != -1")
    return joined.select("image_id", "seg", "point_id", "xyz").distinct()


def gather_pixels(batch: DataFrame, *images: DataFrame) -> DataFrame:
    """Values of (image, y, x) from each image table."""
    for values in images:
        batch = batch.join(values, ["image", "y", "x"])
    return batch


def plane_points(pixels: DataFrame, planes: DataFrame, k: Column, most: float | None = None) -> DataFrame:
    """Camera-space points where pixel rays meet their segment's plane; ``planes``: (seg, plane [n, d])."""
    ray = L.matvec(camera.inverse_intrinsics(k), [F.col("x").cast("double"), F.col("y").cast("double"), F.lit(1.0)], 3)
    joined = pixels.join(planes, "seg").withColumn("_ray", ray)
    joined = joined.withColumn("plane_depth", camera.plane_depth("plane", "_ray", most))
    return joined.withColumn("point", L.scale("_ray", F.col("plane_depth"))).drop("_ray")


def pixel_segments_of(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounding rectangle (y0, x0, y1, x1; inclusive) of the true pixels."""
    return mask.filter("mask").groupBy(*by).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


bounding_rect = pixel_segments_of


def masked_extremes(df: DataFrame, value: str, mask: str, by: Sequence[str]) -> DataFrame:
    inside = F.when(F.col(mask), F.col(value))
    return df.groupBy(*by).agg(F.min(inside).alias("least"), F.max(inside).alias("greatest"))


def components_of_mask(mask: DataFrame, folder: str, by: Sequence[str] = ("t",), least: int = 1) -> DataFrame:
    """8-connected components of true pixels of ``(by, y, x, mask)`` with ``least`` pixels at least: adds component, its least pixel key."""
    from plumbline.operators.graph import component_labels

    true = mask.filter("mask").withColumn("_k", F.struct(*by, "y", "x"))
    ahead = true.select(*by, "y", "x", "_k", F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("s"))
    ahead = ahead.select(*by, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("_k").alias("b"))
    edges = true.select(*by, "y", "x", F.col("_k").alias("a")).join(ahead, [*by, "y", "x"]).select("a", "b")
    found = component_labels(true.select(F.col("_k").alias("node")), edges, folder)
    return found.select("node.*", "component").withColumn("_n", F.count("*").over(W.partitionBy("component"))).filter(F.col("_n") >= least).drop("_n")
