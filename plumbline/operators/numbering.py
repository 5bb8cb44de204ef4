"""Consecutive numbers over a whole ordered table without a single task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.storage import shared_folder, stored


def numbered(df: DataFrame, order: Sequence, out: str = "number", start: int = 0) -> DataFrame:
    """Adds the row's place in the order. Ranges of rows are numbered in parallel; one row a range gives their starts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, shared_folder(df.sparkSession), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row a range
    own = W.partitionBy("_range").orderBy(*order)
    return ranged.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_own") + start).drop("_range", "_own", "_start")
