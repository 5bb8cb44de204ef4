"""Sorts, top-k, greedy folds and deterministic samples.

Random choices are hashes of ids, so the same input gives the same sample. Folds whose result
depends on order run on one sorted group each; groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.rotation import uniform
from plumbline.storage import shared_folder, stored


def top_clusters(df: DataFrame, label: str, k: int) -> DataFrame:
    """The k largest labels, ties to the least."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)


def top_by_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def select_planes(planes: DataFrame, k: int, *, strategy: str = "area", trim: float = 0.0, least_ratio: float = 0.0) -> DataFrame:
    """The k best ``(id, area, error, n)`` planes with at least a share of the largest area, in their original order.

    Strategies: area, error, count or density (n per area). Planes with an error above ``trim`` are left out if it is positive.
    """
    score = {"area": F.col("area"), "error": -F.col("error"), "count": F.col("n").cast("double"), "density": F.try_divide(F.col("n").cast("double"), F.col("area"))}[strategy]
    kept = planes if trim <= 0 else planes.filter(F.col("error") <= trim)
    largest = kept.agg(F.max("area").alias("_most"))
    kept = kept.join(largest).filter(F.col("area") >= least_ratio * F.col("_most")).drop("_most")
    return kept.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).orderBy("id")


def depth_order(points: DataFrame, z: str, by: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Back-to-front order by the 16-bit quantised depth."""
    w = W.partitionBy(*by)
    low, high = F.min(z).over(w), F.max(z).over(w)
    keyed = points.withColumn("key", F.floor((F.col(z) - low) * 65535 / (high - low + 1e-5)).cast("int"))
    return keyed.withColumn("order", F.row_number().over(w.orderBy(F.desc("key"), tie)))


def smallest_good(masks: DataFrame, by: Sequence[str], *, iou: float = 0.8, stability: float = 0.9) -> DataFrame:
    """The smallest mask of each prompt that is good enough; the least id of equals."""
    good = masks.filter((F.col("iou") >= iou) & (F.col("stability") >= stability))
    return good.groupBy(*by).agg(F.min(F.struct("area", "mask_id")).alias("b")).select(*by, "b.mask_id", "b.area")


def greedy_matching(scores: DataFrame, by: Sequence[str], left: str, right: str, score: str = "score") -> DataFrame:
    """One-to-one pairs of each group in descending score; ties to the least left, then right.

    Each round keeps the pairs that are the best of both their sides and drops all others of those,
    which gives what going down the sorted list gives; a round is two aggregations, whatever a group
    holds, and there are few unless scores form a chain. Rows with a null or NaN score, side or
    group take no part; of repeated pairs the best row stays.
    """
    folder, found, k = shared_folder(scores.sparkSession), None, 0
    keys, number = [*by, left, right], F.col(score).cast("double")
    rest = scores.select(*keys, number.alias("_s")).dropna().filter(~F.isnan("_s")).groupBy(*keys).agg(F.max("_s").alias("_s"))
    rest = stored(rest, folder, "rest-0")
    while not rest.isEmpty():
        order = F.struct((-F.col("_s")).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
        ours = rest.groupBy(*by, left).agg(F.min(order).alias("_b")).select(*by, left, F.col("_b.r").alias(right), F.col("_b.s").alias("_s"))
        theirs = rest.groupBy(*by, right).agg(F.min(order).alias("_b")).select(*by, F.col("_b.l").alias(left), right)
        pairs = stored(ours.join(theirs, keys).select(*keys, (-F.col("_s")).alias("_s")), folder, f"pairs-{k}")
        found = pairs if found is None else found.unionByName(pairs)
        left_over = rest.join(pairs.select(*by, left), [*by, left], "left_anti").join(pairs.select(*by, right), [*by, right], "left_anti")
        k += 1
        rest = stored(left_over, folder, f"rest-{k}")
    if found is None:
        return scores.limit(0)
    w = W.partitionBy(*keys).orderBy(number.desc())
    kept = scores.join(found.drop("_s"), keys, "left_semi").filter(~F.isnan(number))
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").select(scores.columns)


def suppress_overlaps(boxes: DataFrame, by: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Non-maximum suppression of ``(by, id, x0, y0, x1, y1, score)``: best first, overlapping ones (IoU above the threshold) go."""
    import numpy as np
    import pandas as pd

    def suppress(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        x0, y0, x1, y1 = (pdf[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        area, left, keep = (x1 - x0) * (y1 - y0), np.arange(len(pdf)), []
        while len(left):
            i, rest = left[0], left[1:]
            keep.append(i)
            w = np.clip(np.minimum(x1[i], x1[rest]) - np.maximum(x0[i], x0[rest]), 0, None)
            h = np.clip(np.minimum(y1[i], y1[rest]) - np.maximum(y0[i], y0[rest]), 0, None)
            union = area[i] + area[rest] - w * h
            left = rest[w * h <= threshold * union]
        return pdf.iloc[keep]

    return boxes.groupBy(*by).applyInPandas(suppress, boxes.schema)


def farthest_points(points: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """n points of each group of ``(by, id, x, y, z)``, each the farthest from those before; the first is that of least id."""
    import numpy as np
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        p = pdf[["x", "y", "z"]].to_numpy(float)
        chosen, d = [0], np.full(len(p), np.inf)
        while len(chosen) < min(n, len(p)):
            d = np.minimum(d, ((p - p[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(np.argmax(d)))
        return pdf.iloc[chosen]

    return points.groupBy(*by).applyInPandas(pick, points.schema)


def thinned(points: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """Keeps, in order of id, each point that no kept point of the group is nearer to than ``radius``."""
    import numpy as np
    import pandas as pd

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        p, cells, keep = pdf[["x", "y", "z"]].to_numpy(float), {}, []
        for i, q in enumerate(p):
            c = tuple(np.floor(q / radius).astype(int))
            near = (j for a in (-1, 0, 1) for b in (-1, 0, 1) for e in (-1, 0, 1) for j in cells.get((c[0] + a, c[1] + b, c[2] + e), ()))
            if all(((p[j] - q) ** 2).sum() >= radius * radius for j in near):
                cells.setdefault(c, []).append(i)
                keep.append(i)
        return pdf.iloc[keep]

    return points.groupBy(*by).applyInPandas(thin, points.schema)


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, those of least hash."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def inverse_cdf_samples(weights: DataFrame, by: Sequence[str], item: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n draws of each group in proportion to the weights: (by, draw, item).

    Each draw's number falls into one item's span of the cumulative weight. Spans and draws meet in
    the cells of a ``2 n`` grid over [0, 1), so a group isn't joined all against all.
    """
    w = W.partitionBy(*by)
    end = F.sum(weight).over(w.orderBy(item).rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(w)
    spans = weights.filter(F.col(weight) > 0).withColumn("_end", end)
    spans = spans.withColumn("_start", F.coalesce(F.lag("_end").over(w.orderBy(item)), F.lit(0.0)))
    cell = lambda c: F.floor(c * (2 * n)).cast("long")
    spans = spans.select(*by, item, "_start", "_end", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end")))).alias("_cell"))
    keys = weights.select(*by).distinct()
    draws = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.withColumn("_u", uniform(F.struct(*by, "draw") if by else F.col("draw"), seed)).withColumn("_cell", cell(F.col("_u")))
    joined = draws.join(spans, [*by, "_cell"]).filter((F.col("_u") >= F.col("_start")) & (F.col("_u") < F.col("_end")))
    return joined.select(*by, "draw", item)


def active_density(mask: DataFrame, by: Sequence[str], pool: int = 16) -> DataFrame:
    """Weights of pixels by how little of their pool is covered: (by, y, x, weight)."""
    cells = mask.withColumns({"_cy": F.floor(F.col("y") / pool), "_cx": F.floor(F.col("x") / pool)})
    share = F.avg(F.when(F.col("covered"), 0.0).otherwise(1.0)).over(W.partitionBy(*by, "_cy", "_cx"))
    return cells.withColumn("weight", F.when(~F.col("covered"), share).otherwise(F.lit(0.0))).drop("_cy", "_cx")


def bin_samples(rays: DataFrame, near: Column, far: Column, n: int, seed: int | None = None) -> DataFrame:
    """One depth in each of n equal bins: the middle, or hashed. ``rays``: (ray)."""
    place = F.lit(0.5) if seed is None else uniform(F.struct("ray", "bin"), seed)
    spread = rays.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return spread.withColumn("z", near + (far - near) * (F.col("bin") + place) / n)


def importance_samples(bins: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Depths in proportion to weights of ``(ray, bin, z0, z1, weight)``: (ray, draw, z)."""
    drawn = inverse_cdf_samples(bins, ["ray"], "bin", "weight", n, seed)
    place = uniform(F.struct("ray", "draw"), seed + 1)
    return drawn.join(bins, ["ray", "bin"]).select("ray", "draw", (F.col("z0") + place * (F.col("z1") - F.col("z0"))).alias("z"))


def triangle_samples(faces: DataFrame, n: int) -> DataFrame:
    """A regular barycentric grid on each face with corners p0, p1, p2: (fid, i, j, point)."""
    from plumbline.functions import linalg as L

    grid = faces.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n) - F.col("i"))).alias("j"))
    a, b = F.col("i") / n, F.col("j") / n
    p = [L.entries(f"p{k}", 3) for k in range(3)]
    return grid.select("fid", "i", "j", L.pack([p[0][k] * (1 - a - b) + p[1][k] * a + p[2][k] * b for k in range(3)]).alias("point"))
