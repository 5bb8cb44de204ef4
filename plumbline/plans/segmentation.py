"""From clustered pixels to global segments and their primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import aggregates, cluster, pixels, primitives, sampling
from plumbline.storage import stored


def frame_segments(points: DataFrame, folder: str, *, eps: float = 2.0, min_samples: int = 10, least: int = 1400) -> DataFrame:
    """Segments of each frame and normal cluster: ``points(id, t, cluster, y, x)`` with seg, small ones left out."""
    spots = points.select("id", "t", F.col("cluster").alias("kind"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    found = cluster.dbscan(spots, ("y", "x"), eps, min_samples, folder, by=("t", "kind")).filter("cluster IS NOT NULL")
    kept = aggregates.drop_small(found, ["t", "cluster"], least)
    return points.join(kept.select("id", F.col("cluster").alias("seg")), "id")


def linked_segments(segments: DataFrame, flow: DataFrame, height: int, width: int, folder: str, *, least: int = 50, ratio: float = 0.3, cosine: float = 0.9) -> DataFrame:
    """Global ids (frame, seg, gid) of ``segments(t, y, x, seg, wx, wy, wz, nx, ny, nz, depth)`` that flow carries into each other.

    Overlaps are scored, matched one to one in each frame pair, and connected.
    """
    named = segments.select("t", "seg", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"), "nx", "ny", "nz", "depth")
    props = stored(aggregates.segment_properties(named, ["t", "seg"]), folder, "properties")
    overlaps = pixels.warp_overlap(segments.select("t", "y", "x", "seg"), flow, height, width)
    scored = pixels.scored_overlaps(overlaps, props.select("t", "seg", F.col("avg_normal").alias("normal")), least=least, ratio=ratio, cosine=cosine)
    pairs = sampling.greedy_matching(scored, ["fi", "fj"], "seg1", "seg2")
    edges = stored(pairs.select("fi", F.col("seg1").alias("si"), "fj", F.col("seg2").alias("sj")), folder, "edges")
    return cluster.global_segments(props.select(F.col("t").alias("frame"), "seg"), edges, folder)


def segment_primitives(points: DataFrame, flow: DataFrame, height: int, width: int, folder: str, *, eps: float = 2.0, min_samples: int = 10, least: int = 1400, least_frames: int = 1, overlap: int = 50) -> DataFrame:
    """The whole way: pixels ``(id, t, cluster, y, x, wx, wy, wz, nx, ny, nz, depth)`` to primitives of global segments."""
    segments = stored(frame_segments(points, folder, eps=eps, min_samples=min_samples, least=least), folder, "segments")
    linked = linked_segments(segments, flow, height, width, folder, least=overlap)
    named = linked.select(F.col("frame").alias("t"), "seg", F.xxhash64("gid").alias("gid"))
    joined = segments.join(named, ["t", "seg"]).select("gid", F.col("t").alias("frame"), "id", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    return primitives.fit_primitives(joined, least_frames=least_frames)
