"""Windows and pooling over any axes of a grid whose cells are rows, one pass an axis.

A pass sends each cell to the windows along one axis that hold it, ``size / stride`` of them, so
pooling costs the sum of the kernel's sides and not their product. An axis of n cells has
(n + 2 * padding - size + 1) // stride windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _each(value: int | Sequence[int], n: int) -> list[int]:
    return [value] * n if isinstance(value, int) else list(value)


def _spread(cells: DataFrame, axis: str, n: int, size: int, stride: int, padding: int) -> DataFrame:
    """Each cell once a window that holds it: ``_o``, the window, and ``_in``, the cell's place in it."""
    count = (n + 2 * padding - size + 1) // stride
    x = F.col(axis) + padding
    first = F.greatest(F.lit(0).cast("long"), F.ceil((x - size + 1) / stride))
    last = F.least(F.lit(count - 1).cast("long"), F.floor(x / stride))
    within = cells.filter((F.col(axis) >= 0) & (F.col(axis) < n) & (first <= last))
    return within.withColumn("_o", F.explode(F.sequence(first, last))).withColumn("_in", F.col(axis) + padding - F.col("_o") * stride)


def pooled(cells: DataFrame, by: Sequence[str], axes: Mapping[str, int], value: str, size: int | Sequence[int], stride: int | Sequence[int] = 1, padding: int | Sequence[int] = 0) -> DataFrame:
    """The largest value of each window: ``by``, the axes (now windows) and ``value``.

    ``axes`` names the axes with their lengths. NaN and null cells, absent ones and padding don't
    count; a window with no other cells is null, and one with no row at all has none.
    """
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    out = cells.select(*by, *(F.col(a).cast("long").alias(a) for a in axes), clean.alias(value))
    for (axis, n), k, s, p in zip(axes.items(), _each(size, len(axes)), _each(stride, len(axes)), _each(padding, len(axes)), strict=True):
        others = [a for a in axes if a != axis]
        spread = _spread(out, axis, n, k, s, p)
        out = spread.groupBy(*by, *others, F.col("_o").alias(axis)).agg(F.max(value).alias(value))
    return out.select(*by, *axes, value)


def windows(cells: DataFrame, by: Sequence[str], axes: Mapping[str, int], value: str, size: int | Sequence[int], stride: int | Sequence[int] = 1) -> DataFrame:
    """Each window's values in row-major order: ``by``, the axes (now windows) and ``window``, null where a cell is absent."""
    sizes = _each(size, len(axes))
    out, place, most = cells.select(*by, *(F.col(a).cast("long").alias(a) for a in axes), F.col(value).alias("_v")).withColumn("_p", F.lit(0).cast("long")), F.col("_p"), 1
    for (axis, n), k, s in zip(axes.items(), sizes, _each(stride, len(axes)), strict=True):
        spread = _spread(out, axis, n, k, s, 0)
        out = spread.withColumn("_p", place * k + F.col("_in")).drop(axis, "_in").withColumnRenamed("_o", axis)
        most *= k
    held: Column = F.map_from_entries(F.collect_list(F.struct("_p", "_v")))
    found = out.groupBy(*by, *axes).agg(held.alias("_m"))
    return found.select(*by, *axes, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda i: F.try_element_at("_m", i)).alias("window"))
