"""Windows over trajectories and frames: derivatives, smoothing, runs, best frames, rays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(by: Sequence[str], order: Sequence[str]) -> W:
    return W.partitionBy(*by).orderBy(*order)


def derivatives(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First and second difference, null where earlier rows are missing."""
    w = ordered(by, order)
    velocity = F.col(value) - F.lag(value).over(w)
    df = df.withColumn("velocity", velocity)
    return df.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))


def centroid_motion(points: DataFrame, by: Sequence[str], time: str, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Speed and change of speed of the mean position of each frame; 0 where the frames before are missing."""
    means = points.groupBy(*by, time).agg(*(F.avg(c).alias(c) for c in coords))
    w = ordered(by, [time])
    square = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coords[1:]), (F.col(coords[0]) - F.lag(coords[0]).over(w)) * (F.col(coords[0]) - F.lag(coords[0]).over(w)))
    moved = means.withColumn("speed", F.coalesce(F.sqrt(square), F.lit(0.0)))
    return moved.withColumn("change", F.coalesce(F.abs(F.col("speed") - F.lag("speed").over(w)), F.lit(0.0)))


def savitzky_golay(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], out: str = "smooth") -> DataFrame:
    """Window 5, order 2. The first and last two values come from the parabola through the outermost five; fewer than five stay."""
    w = ordered(by, order)
    n, i = F.count("*").over(W.partitionBy(*by)), F.row_number().over(w)
    # fixed values: least-squares weights of a parabola over five samples, at their places 0 to 4
    weights = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3), (-5, 6, 12, 13, 9), (3, -5, -3, 9, 31))
    at = lambda shift: F.lag(value, -shift).over(w) if shift < 0 else F.lead(value, shift).over(w) if shift else F.col(value)
    fit = lambda place: sum((at(j - place) * c for j, c in enumerate(weights[place]) if j), at(-place) * weights[place][0]) / 35.0
    value_ = F.when(n < 5, F.col(value)).when(i == 1, fit(0)).when(i == 2, fit(1)).when(i == n, fit(4)).when(i == n - 1, fit(3)).otherwise(fit(2))
    return df.withColumn(out, value_)


def gaussian_smooth(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], sigma: float = 3.0, out: str = "smooth") -> DataFrame:
    """Weighted mean over 4 sigma to each side; past the ends the sequence is reflected, edge sample repeated."""
    import math

    radius = int(4 * sigma + 0.5)
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    total = math.fsum(weight)
    rows = df.withColumn("_i", (F.row_number().over(ordered(by, order)) - 1).cast("long")).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(x / total).alias("w")) for d, x in zip(range(-radius, radius + 1), weight, strict=True)))
    asked = rows.select(*by, F.col("_i").alias("_to"), "_n", F.explode(steps).alias("s"))
    place = F.pmod(F.col("_to") + F.col("s.d"), 2 * F.col("_n"))
    asked = asked.select(*by, "_to", F.col("s.w").alias("_w"), F.when(place < F.col("_n"), place).otherwise(2 * F.col("_n") - 1 - place).alias("_i"))
    smooth = asked.join(rows.select(*by, "_i", F.col(value).alias("_v")), [*by, "_i"]).groupBy(*by, "_to").agg(F.sum(F.col("_w") * F.col("_v")).alias(out))
    return rows.join(smooth.withColumnRenamed("_to", "_i"), [*by, "_i"]).drop("_i", "_n")


def centred_majority(df: DataFrame, flag: str, by: Sequence[str], order: Sequence[str], radius: int = 2, share: float = 0.7, out: str = "stable") -> DataFrame:
    """Whether more than ``share`` of the frames around hold the flag; the window ends with the sequence."""
    w = ordered(by, order).rowsBetween(-radius, radius)
    return df.withColumn(out, F.avg(F.col(flag).cast("double")).over(w) > share)


def static_flags(motion: DataFrame, by: Sequence[str], time: str, *, speed: float = 0.01, change: float = 0.005, radius: int = 2) -> DataFrame:
    """Frames in which a body rests, after centred_majority; ``motion`` has speed and change."""
    flagged = motion.withColumn("_still", (F.col("speed") < speed) & (F.col("change") < change))
    return centred_majority(flagged, "_still", by, [time], radius, out="static").drop("_still")


def runs(df: DataFrame, flag: str, by: Sequence[str], order: Sequence[str], least: int) -> DataFrame:
    """Maximal runs of true flags of ``least`` rows at least: start (0-based row), end (exclusive) and length."""
    w = ordered(by, order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).filter(F.col(flag))
    island = rows.withColumn("_g", F.col("_i") - F.row_number().over(w))
    found = island.groupBy(*by, "_g").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end"), F.count("*").alias("length"))
    return found.filter(F.col("length") >= least).drop("_g")


def keep_stable(df: DataFrame, flag: str, by: Sequence[str], order: Sequence[str], least: int, out: str = "stable") -> DataFrame:
    """Keeps a true flag only inside a run of ``least`` rows at least."""
    w = ordered(by, order)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_f", F.coalesce(F.col(flag), F.lit(False)))
    rows = rows.withColumn("_g", F.col("_i") - F.sum(F.col("_f").cast("int")).over(w))
    n = F.count("*").over(W.partitionBy(*by, "_f", "_g"))
    return rows.withColumn(out, F.col("_f") & (n >= least)).drop("_i", "_f", "_g")


def keys_with_run(df: DataFrame, flag: str, by: Sequence[str], order: Sequence[str], least: int) -> DataFrame:
    """Keys that have a run of ``least`` rows at least, with their longest."""
    return runs(df, flag, by, order, least).groupBy(*by).agg(F.max("length").alias("longest"))


def best_frames(segments: DataFrame, counts: DataFrame, by: Sequence[str] = (), fallback: str = "start") -> DataFrame:
    """The frame of the highest count in each segment ``(start, end)``; the earliest wins a tie.

    ``counts``: (by, t, n). If all counts of a segment are 0, its start, middle, end or none is taken.
    """
    s = segments.withColumnRenamed("start", "_start").withColumnRenamed("end", "_end")
    inside = (F.col("t") >= F.col("_start")) & (F.col("t") < F.col("_end"))
    joined = s.alias("s").join(counts.alias("c"), [F.col(f"s.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by] + [inside] if by else inside, "left")
    best = joined.groupBy(*(F.col(f"s.{b}").alias(b) for b in by), F.col("_start").alias("start"), F.col("_end").alias("end")).agg(F.max(F.struct("n", (-F.col("t")).alias("t"))).alias("b"))
    other = {"start": F.col("start"), "middle": F.floor((F.col("start") + F.col("end")) / 2), "end": F.col("end") - 1, "none": F.lit(None)}[fallback].cast("long")
    return best.select(*by, "start", "end", F.when(F.col("b.n") > 0, -F.col("b.t")).otherwise(other).alias("frame"), F.coalesce("b.n", F.lit(0)).alias("n"))


def sliding_windows(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], size: int, stride: int = 1) -> DataFrame:
    """Windows of ``size`` values; there are (n - size + 1) // stride of each sequence."""
    w = ordered(by, order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    held = rows.withColumn("window", F.collect_list(value).over(w.rowsBetween(0, size - 1)))
    place = F.floor(F.col("_i") / stride)
    kept = held.filter((F.col("_i") % stride == 0) & (place < F.floor((F.col("_n") - size + 1) / stride)))
    return kept.select(*by, place.cast("long").alias("window_id"), "window")


def max_pool(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], radius: int = 1, out: str = "pooled") -> DataFrame:
    """Largest value around; NaN counts as absent."""
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.withColumn(out, F.max(clean).over(ordered(by, order).rowsBetween(-radius, radius)))


def transmittance(df: DataFrame, density: str, by: Sequence[str], order: Sequence[str], out: str = "transmittance") -> DataFrame:
    """exp(-sum of the densities before) along a ray."""
    before = ordered(by, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.exp(-F.coalesce(F.sum(density).over(before), F.lit(0.0))))


def composite_weights(df: DataFrame, density: str, step: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Volume rendering weights: transmittance times 1 - exp(-density * step)."""
    thick = df.withColumn("_d", F.col(density) * F.col(step))
    return transmittance(thick, "_d", by, order).withColumn("weight", F.col("transmittance") * (1 - F.exp(-F.col("_d")))).drop("_d")


def virtual_clock(df: DataFrame, wait: str, by: Sequence[str], order: Sequence[str], out: str = "clock") -> DataFrame:
    """Sum of all waits up to and with each row."""
    return df.withColumn(out, F.sum(wait).over(ordered(by, order).rowsBetween(W.unboundedPreceding, 0)))


def every_nth(df: DataFrame, frame: str, step: int = 7) -> DataFrame:
    return df.filter(F.col(frame) % step == 0)


def playback_frames(frames: DataFrame, *, stride: int | None = None, custom: Sequence[int] | None = None) -> DataFrame:
    """Frames that a player shows: all, every ``stride``-th, or up to three given ones, clamped and taken once."""
    if custom is not None:
        last = frames.agg(F.max("t").alias("last"))
        asked = last.select(F.explode(F.array(*(F.lit(int(c)) for c in custom[:3]))).alias("c"), "last").select(F.greatest(F.lit(0), F.least("c", "last")).alias("t")).distinct()
        return frames.join(asked, "t", "left_semi")
    return frames if not stride else frames.filter(F.col("t") % stride == 0)


def clamp_frame(frame: Column, last: Column) -> Column:
    return F.greatest(F.lit(0), F.least(frame, last))


def render_frames(frames: DataFrame, n_pos: int, n_images: int, most: int | None = None, stride: int = 1) -> DataFrame:
    n = min(n_pos, n_images, most if most is not None else n_pos)
    return frames.filter((F.col("t") < n) & (F.col("t") % stride == 0))


def body_pose(bodies: DataFrame, geoms: DataFrame) -> DataFrame:
    """World pose of each geom: body pose (t, body, pos, quat wxyz) joined to local poses (geom, body, local_pos, local_quat)."""
    from plumbline.functions import linalg as L
    from plumbline.functions import rotation as R

    joined = bodies.join(geoms, "body")
    pos = L.add("pos", R.quat_rotate("quat", "local_pos"))
    return joined.select("t", "geom", pos.alias("pos"), R.quat_multiply("quat", "local_quat").alias("quat"))


def contact_frames(scores: DataFrame, parts: DataFrame, segments: DataFrame, *, threshold: float = 0.5, part_thresholds: dict[str, float] | None = None, weights: dict[str, float] | None = None, least: int = 5, fallback: str = "middle") -> DataFrame:
    """Per-part contact analytics: threshold, stability, weighted count of touching vertices, best frame of each segment.

    scores: (t, v, score); parts: (part, v); segments: (start, end).
    """

    def by_part(values: dict[str, float] | None, default: float) -> Column:
        out = F.lit(float(default))
        for part, value in (values or {}).items():
            out = F.when(F.col("part") == part, float(value)).otherwise(out)
        return out

    marked = scores.join(parts, "v").withColumn("touch", F.col("score") > by_part(part_thresholds, threshold))
    stable = keep_stable(marked, "touch", ["part", "v"], ["t"], least)
    weighted = stable.groupBy("t", "v").agg(F.max(F.when(F.col("stable"), by_part(weights, 1.0)).otherwise(F.lit(0.0))).alias("w"))
    return best_frames(segments, weighted.groupBy("t").agg(F.sum("w").alias("n")), fallback=fallback)
