"""A store of voxels into which observations are merged batch by batch, and resampling to a cube.

A version holds one batch's sums, sorted by brick; the state is the sum of all versions. A batch that
is merged again writes its version again, so it never counts twice, and no earlier one is rewritten.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voxels along a brick's side.
BRICK = 8

_SUMS = "bi long, bj long, bk long, i long, j long, k long, weight double, total double, n long"


def summed(observations: DataFrame) -> DataFrame:
    """``(i, j, k, value, weight)`` to sums by voxel; rows with a null, NaN or weight of no more than 0 don't count."""
    sound = observations.filter("value IS NOT NULL AND NOT isnan(value) AND weight > 0 AND NOT isnan(weight)")
    sums = sound.groupBy("i", "j", "k").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("value")).alias("total"), F.count("*").alias("n"))
    brick = [F.floor(F.col(c) / BRICK).cast("long").alias(f"b{c}") for c in "ijk"]
    return sums.select(*brick, *(F.col(c).cast("long").alias(c) for c in "ijk"), F.col("weight").cast("double").alias("weight"), F.col("total").cast("double").alias("total"), "n")


def merge(observations: DataFrame, store: str, version: int) -> None:
    """Adds a batch as a version of its own; the same version again replaces it."""
    rows = summed(observations).repartitionByRange("bi", "bj", "bk").sortWithinPartitions("bi", "bj", "bk", "i", "j", "k")
    rows.write.mode("overwrite").parquet(f"{store}/v={version}")


def state(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """``(i, j, k, value, weight, n)``: the weighted mean of all versions, or of those up to one.

    Filters on bricks (bi, bj, bk) reach the files when given through ``region``.
    """
    return _mean(_versions(spark, store, upto))


def _versions(spark: SparkSession, store: str, upto: int | None) -> DataFrame:
    rows = spark.read.schema(_SUMS + ", v int").parquet(store)
    return rows if upto is None else rows.filter(F.col("v") <= upto)


def _mean(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("i", "j", "k").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("i", "j", "k", (F.col("total") / F.col("weight")).alias("value"), "weight", "n")


def region(spark: SparkSession, store: str, low: tuple[int, int, int], high: tuple[int, int, int], upto: int | None = None) -> DataFrame:
    """The state of a box of voxels, both corners included; other bricks' rows aren't read."""
    rows = _versions(spark, store, upto)
    for c, a, b in zip("ijk", low, high, strict=True):
        rows = rows.filter(F.col(f"b{c}").between(a // BRICK, b // BRICK) & F.col(c).between(a, b))
    return _mean(rows)


def compact(spark: SparkSession, store: str, into: str, upto: int) -> None:
    """The versions up to one, as the one version of a new store."""
    rows = _versions(spark, store, upto).groupBy("bi", "bj", "bk", "i", "j", "k").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows.repartitionByRange("bi", "bj", "bk").sortWithinPartitions("bi", "bj", "bk", "i", "j", "k").write.mode("overwrite").parquet(f"{into}/v={upto}")


def resampled(voxels: DataFrame, side: int, background: float = 0.0) -> DataFrame:
    """``(x, y, z, value)`` of a cube of ``side`` cells over the box of the voxels, corners on corners, by trilinear weights.

    Absent voxels have the background's value; a side of length one is constant along its axis.
    """
    box = voxels.agg(*(f(c).alias(f"{n}{c}") for c in "ijk" for n, f in (("a", F.min), ("b", F.max)))).first()
    cells = voxels.sparkSession.range(side**3)
    if box["ai"] is None:
        return cells.limit(0).select(*(F.col("id").alias(c) for c in "xyz"), F.lit(background).alias("value"))
    out = cells.select((F.col("id") % side).alias("x"), (F.floor(F.col("id") / side) % side).alias("y"), F.floor(F.col("id") / side**2).alias("z"))
    for c, t in zip("ijk", "xyz", strict=True):
        at: Column = F.lit(box[f"a{c}"]) + F.col(t) * F.lit((box[f"b{c}"] - box[f"a{c}"]) / max(side - 1, 1))
        out = out.withColumn(f"_{c}", at)
    corners = []
    for steps in itertools.product((0, 1), repeat=3):
        weight, fields = F.lit(1.0), []
        for c, s in zip("ijk", steps, strict=True):
            share = F.col(f"_{c}") - F.floor(f"_{c}")
            weight = weight * (share if s else 1 - share)
            fields.append((F.floor(f"_{c}") + s).cast("long").alias(c))
        corners.append(F.struct(*fields, weight.alias("w")))
    parts = out.select("x", "y", "z", F.explode(F.array(*corners)).alias("_e")).select("x", "y", "z", "_e.*").filter("w > 0")
    joined = parts.join(voxels.select("i", "j", "k", "value"), ["i", "j", "k"], "left")
    return joined.groupBy("x", "y", "z").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(float(background)))).alias("value"))
