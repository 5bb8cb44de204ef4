"""Aggregates: segments, contingency metrics, fits by sums, bounds, boxes and reports."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.numbering import numbered


def segment_properties(pixels: DataFrame, by: Sequence[str], *, least: int = 10) -> DataFrame:
    """Mean unit normal and centroid of each segment of ``(by, x, y, z, nx, ny, nz, depth)`` with enough pixels and valid depths.

    The centroid is over all pixels.
    """
    mean = pixels.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("depth") > 0, 1).otherwise(0)).alias("n_valid"), *(F.avg(c).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    size = F.when(size > 0, size)
    kept = mean.filter((F.col("n") >= least) & (F.col("n_valid") >= least))
    return kept.select(*by, "n", F.array(*(F.col(c) / size for c in ("nx", "ny", "nz"))).alias("avg_normal"), F.array("x", "y", "z").alias("centroid"))


def vector_centroids(vectors: DataFrame, by: str, x: str = "x") -> DataFrame:
    """Mean of each component of array columns by group: (by, dim, mean)."""
    return vectors.select(by, F.posexplode(x).alias("dim", "v")).groupBy(by, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def label_histogram(df: DataFrame, by: Sequence[str], least: int = 0) -> DataFrame:
    return df.groupBy(*by).count().filter(F.col("count") >= least)


def drop_small(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Rows whose group has ``least`` rows at least."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*by))).filter(F.col("_n") >= least).drop("_n")


def dense_labels(df: DataFrame, label: str, out: str = "dense") -> DataFrame:
    """Labels renumbered from 0 in their order; only the distinct labels are numbered."""
    distinct = df.select(label).distinct().filter(F.col(label).isNotNull())
    return df.join(numbered(distinct, [label], out), label, "left")


def contingency(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """Counts of label pairs with marginals, total and IoU."""
    cells = df.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("n_gt", F.sum("n").over(W.partitionBy("gt"))).withColumn("n_pred", F.sum("n").over(W.partitionBy("pred")))
    return cells.withColumn("iou", F.col("n") / (F.col("n_gt") + F.col("n_pred") - F.col("n")))


def covering(cells: DataFrame) -> DataFrame:
    """Mean best IoU of ground-truth labels, weighted by size, the same for predictions, and their mean."""
    side = lambda k: cells.groupBy(k).agg(F.max("iou").alias("iou"), F.first(f"n_{k}").alias("n")).agg((F.sum(F.col("iou") * F.col("n")) / F.sum("n")).alias(f"{k}_covering"))
    both = side("gt").join(side("pred"))
    return both.select("gt_covering", "pred_covering", ((F.col("gt_covering") + F.col("pred_covering")) / 2).alias("covering"))


def rand_index(cells: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    pairs = lambda n: n * (n - 1) / 2
    total = cells.agg(F.sum(d("n")).alias("n"), F.sum(pairs(d("n"))).alias("both"))
    gt = cells.groupBy("gt").agg(F.first("n_gt").alias("m")).agg(F.sum(pairs(d("m"))).alias("gt_pairs"))
    pred = cells.groupBy("pred").agg(F.first("n_pred").alias("m")).agg(F.sum(pairs(d("m"))).alias("pred_pairs"))
    return total.join(gt).join(pred).select(((pairs(F.col("n")) + 2 * F.col("both") - F.col("gt_pairs") - F.col("pred_pairs")) / pairs(F.col("n"))).alias("rand_index"))


def variation_of_information(cells: DataFrame) -> DataFrame:
    """In bits: both conditional entropies."""
    small = cells.select("n", "n_gt", "n_pred").join(cells.agg(F.sum("n").alias("total")))
    part = lambda m: F.sum(-(F.col("n") / F.col("total")) * F.log2(F.col("n") / F.col(m)))
    return small.agg(part("n_gt").alias("split"), part("n_pred").alias("merge")).select("split", "merge", (F.col("split") + F.col("merge")).alias("voi"))


def weighted_meter(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum, count and weighted mean; the mean of nothing is 0."""
    out = df.groupBy(*by).agg(F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(weight), F.lit(0)).alias("count"))
    return out.withColumn("avg", F.coalesce(F.try_divide("sum", "count"), F.lit(0.0)))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """``(scene, metric, value)``: the mean of each metric over the scenes that have it."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("scenes"))


def plane_by_moments(points: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Plane a x + b y + c z + d = 0 through the centroid from second moments, by the largest of the three determinants.

    Unit normal; null for fewer than three points or if they lie on a line.
    """
    cx, cy, cz = (F.col(c).cast("double") for c in (x, y, z))
    pair = {"xx": (cx, cx), "xy": (cx, cy), "xz": (cx, cz), "yy": (cy, cy), "yz": (cy, cz), "zz": (cz, cz)}
    m = points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(cx).alias("mx"), F.avg(cy).alias("my"), F.avg(cz).alias("mz"), *(F.covar_pop(a, b).alias(k) for k, (a, b) in pair.items()))
    c = F.col
    dets = {"dx": c("yy") * c("zz") - c("yz") * c("yz"), "dy": c("xx") * c("zz") - c("xz") * c("xz"), "dz": c("xx") * c("yy") - c("xy") * c("xy")}
    m = m.select("*", *(v.alias(k) for k, v in dets.items())).withColumn("big", F.greatest("dx", "dy", "dz"))
    a, b = c("xz") * c("yz") - c("xy") * c("zz"), c("xy") * c("yz") - c("xz") * c("yy")
    e = c("xy") * c("xz") - c("yz") * c("xx")
    normal = F.when(c("dx") >= c("big"), F.array(c("dx"), a, b)).when(c("dy") >= c("big"), F.array(a, c("dy"), e)).otherwise(F.array(b, e, c("dz")))
    m = m.withColumn("_v", F.when((c("n") >= 3) & (c("big") > 0), normal))
    v = [F.get("_v", F.lit(i)) for i in range(3)]
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    nx, ny, nz = (t / size for t in v)
    return m.select(*by, "n", nx.alias("a"), ny.alias("b"), nz.alias("c"), (-(nx * c("mx") + ny * c("my") + nz * c("mz"))).alias("d"))


def plane_by_least_squares(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """p with p.x = 1 in the least-squares sense, by normal equations; null if they are singular."""
    from plumbline.functions import linalg as L

    names = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = points.groupBy(*by).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in names), *(F.sum(a).alias(f"s{a}") for a in "xyz"))
    m = [F.col(f"s{min(a, b)}{max(a, b)}") for a in "xyz" for b in "xyz"]
    return sums.select(*by, L.matvec(L.inverse(m), [F.col(f"s{a}") for a in "xyz"], 3).alias("p"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def bounds(points: DataFrame, by: Sequence[str] = (), coords: Sequence[str] = ("x", "y", "z"), *, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Least and greatest coordinates, or quantiles of them."""
    end = lambda c, q: F.min(c) if q == 0 else F.max(c) if q == 1 else F.percentile(c, F.lit(q))
    return points.groupBy(*by).agg(*(e for c in coords for e in (end(c, low).alias(f"{c}_min"), end(c, high).alias(f"{c}_max"))))


def square_box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """A box made square about its centre."""
    half = F.greatest(x_max - x_min, y_max - y_min) / 2
    cx, cy = (x_min + x_max) / 2, (y_min + y_max) / 2
    return F.array(cx - half, cy - half, cx + half, cy + half)


def image_errors(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE and PSNR (infinite for equal images)."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.groupBy(*by).agg(F.avg(d * d).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(20 * F.log10(255 / F.sqrt("mse"))))


def mask_iou(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.groupBy(*by).agg(F.try_divide(F.sum(x * y), F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + y)))).alias("iou"))


def voxel_means(points: DataFrame, coords: Sequence[str], size: float, values: Sequence[str] = (), origin: Sequence[float] | None = None) -> DataFrame:
    """Mean of the points of each cell, and how many there are."""
    origin = origin or [0.0] * len(coords)
    cells = [F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(size))).alias(f"cell_{c}") for c, o in zip(coords, origin, strict=True)]
    return points.dropna(subset=list(coords)).groupBy(*cells).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in (*coords, *values)))


def plane_offsets(observations: DataFrame, by: Sequence[str], least: int = 50) -> DataFrame:
    """Offsets weighted by 1/error; -1 for fewer than ``least`` observations."""
    sums = observations.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.col("offset") / F.col("error")) / F.sum(1 / F.col("error"))).alias("o"))
    return sums.select(*by, "n", F.when(F.col("n") >= least, F.col("o")).otherwise(F.lit(-1.0)).alias("offset"))


def reestimated_offsets(planes: DataFrame, samples: DataFrame, most: float) -> DataFrame:
    """Replaces offsets outside (0.1, most) by the mean of -depth * (n . ray) over a plane's samples.

    planes: (image, seg, offset); samples: (image, seg, depth, cos).
    """
    valid = (F.col("offset") > 0.1) & (F.col("offset") < most)
    mean = samples.groupBy("image", "seg").agg(F.avg(-F.col("depth") * F.col("cos")).alias("_mean"))
    return planes.join(mean, ["image", "seg"], "left").select("image", "seg", F.when(valid, F.col("offset")).otherwise(F.coalesce("_mean", "offset")).alias("offset"))


def segment_modes(df: DataFrame, by: Sequence[str], value: str, spread: str, *, share: float = 0.5, most: float = 1e-3) -> DataFrame:
    """Most frequent value of each segment (least of equals) if it holds over ``share`` of it and ``spread`` varies little.

    Where all of a segment's spread are below 10^4 and have four decimals at most, the variance is taken from whole
    numbers and held against ``most`` without rounding, so one equal to it isn't below it in whatever order rows come.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("b"), F.sum("n").alias("total"))
    short = F.col(spread).try_cast("decimal(8,4)")
    exact = F.coalesce(short.cast("double") == F.col(spread).cast("double"), F.col(spread).isNull())
    units = F.when(exact, (short * 10000).cast("long"))
    varied = df.select(*by, F.col(spread).alias("_x"), exact.alias("_exact"), units.alias("_u")).groupBy(*by).agg(
        F.every("_exact").alias("_exact"),
        F.count("_x").cast("decimal(11,0)").alias("_k"),
        F.sum("_u").cast("decimal(19,0)").alias("_s"),
        F.sum((F.col("_u") * F.col("_u")).cast("decimal(17,0)")).alias("_q"),
        F.coalesce(F.var_samp("_x"), F.lit(0.0)).alias("_rounded"),
    )
    # of k whole numbers: k (k - 1) times the variance
    whole = F.when(F.col("_exact") & (F.col("_k") > 1), F.col("_k") * F.col("_q") - F.col("_s") * F.col("_s"))
    pairs = F.col("_k") * (F.col("_k") - 1)
    below = F.coalesce(whole < pairs * F.lit(Decimal(str(most)) * 10**8), F.col("_rounded") < most)
    variance = F.coalesce(F.try_divide(whole.cast("double"), pairs.cast("double")) / 1e8, "_rounded")
    varied = varied.select(*by, below.alias("_below"), variance.alias("variance"))
    return top.join(varied, list(by)).filter((F.col("b.n") > share * F.col("total")) & F.col("_below")).select(*by, (-F.col("b.v")).alias(value), "variance")


def contact_report(contacts: DataFrame) -> DataFrame:
    """``(t, v, touch)``: percentage of touching vertices by frame, and over frames."""
    frames = contacts.groupBy("t").agg((100 * F.avg(F.col("touch").cast("double"))).alias("percent_vertices"), F.max("touch").alias("any"))
    share = frames.agg((100 * F.avg(F.col("any").cast("double"))).alias("percent_frames"))
    return frames.drop("any").join(share)


def segment_report(members: DataFrame) -> DataFrame:
    """``(segment, t, n)``: frames, pixels and mean pixels of each segment, most frames first."""
    return members.groupBy("segment").agg(F.countDistinct("t").alias("frames"), F.sum("n").alias("pixels"), F.avg("n").alias("mean_pixels")).orderBy(F.desc("frames"), "segment")


def mean_direction(df: DataFrame, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    from plumbline.functions import linalg as L

    return df.agg(*(F.avg(c).alias(c) for c in coords)).select(L.normalize([F.col(c) for c in coords]).alias("direction"))


def named_metrics(metrics: DataFrame, predicate: Column) -> DataFrame:
    return metrics.filter(predicate)


def median_scale(pixels: DataFrame, depth: str, reference: str, by: Sequence[str]) -> DataFrame:
    """Scales a depth map by the median of reference / depth over valid pixels of each frame."""
    ratio = F.when((F.col(depth) > 0) & (F.col(reference) > 0), F.col(reference) / F.col(depth))
    scale = pixels.groupBy(*by).agg(F.percentile(ratio, F.lit(0.5)).alias("_scale"))
    return pixels.join(scale, list(by)).withColumn(depth, F.col(depth) * F.col("_scale")).drop("_scale")
