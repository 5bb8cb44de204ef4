"""Motion summaries and reconstruction scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import aggregates, sequence, spatial


def motion(points: DataFrame, by: Sequence[str] = (), *, speed: float = 0.01, change: float = 0.005, least: int = 15) -> DataFrame:
    """Static runs of ``least`` frames at least of each body: by, start, end, length."""
    flagged = sequence.static_flags(sequence.centroid_motion(points, by, "t"), by, "t", speed=speed, change=change)
    return sequence.runs(flagged, "static", by, ["t"], least)


def part_motion(points: DataFrame, parts: DataFrame, **options) -> DataFrame:
    """The same for each body part of ``parts(part, v)``."""
    return motion(points.join(parts, "v"), ["part"], **options)


def reconstruction_scores(predicted: DataFrame, target: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Geometry metrics and Chamfer terms of two clouds ``(id, x)`` in rows (metric, value)."""
    metrics = spatial.geometry_metrics(predicted, target, threshold).join(spatial.chamfer(predicted, target, power=1).select(F.col("chamfer").alias("chamfer_l1"))).join(spatial.chamfer(predicted, target).select(F.col("chamfer").alias("chamfer_l2")))
    return metrics.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics.columns))).alias("m")).select("m.metric", "m.value")


def segmentation_scores(labels: DataFrame, gt: str, pred: str) -> DataFrame:
    """Rand index, variation of information and covering in one row."""
    cells = aggregates.contingency(labels, gt, pred)
    return aggregates.rand_index(cells).join(aggregates.variation_of_information(cells)).join(aggregates.covering(cells))


def mean_over_scenes(scores: DataFrame) -> DataFrame:
    return aggregates.mean_metrics(scores)
