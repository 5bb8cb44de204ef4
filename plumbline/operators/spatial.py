"""Spatial joins of low-dimensional points through grid cells.

A cell has the search radius as its side, so a point's neighbours lie in the 3**d cells around it.
Points are sent to those cells (or queries, whichever the caller gives as the smaller side) and an
equi-join on the cell finds all pairs. A crowded cell's queries are dealt over ``salts`` tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.linalg import array_dot
from plumbline.operators import blocks
from plumbline.storage import shared_folder, stored


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for x, y in zip(a, b, strict=True):
        term = (x - y) * (x - y)
        total = term if total is None else total + term
    return total


def cell(coords: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(size))).cast("long") for c in coords]


def _keyed(left: DataFrame, right: DataFrame, coords: Sequence[str], radius: float, salts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Left rows with their cell and a salt, right rows in all neighbouring cells and salts, coordinates renamed."""
    cells = [f"_c{i}" for i in range(len(coords))]
    left = left.dropna(subset=list(coords)).select("*", *(c.alias(n) for c, n in zip(cell(coords, radius), cells, strict=True)))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*coords), F.lit(salts)).cast("int"))
    steps = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(s, cells, strict=True))) for s in itertools.product((-1, 0, 1), repeat=len(coords))))
    right = right.dropna(subset=list(coords)).withColumn("_step", F.explode(steps))
    right = right.select(*(F.col(c) for c in right.columns if c not in (*coords, "_step")), *(F.col(c).alias(f"_r_{c}") for c in coords), *((k + F.col(f"_step.{n}")).alias(n) for k, n in zip(cell(coords, radius), cells, strict=True)))
    right = right.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return left, right, [*cells, "_salt"]


def radius_join(left: DataFrame, right: DataFrame, coords: Sequence[str], radius: float, *, how: str = "inner", salts: int = 1) -> DataFrame:
    """Pairs of rows within ``radius`` (inclusive), with their ``distance``; ``left_semi`` and ``left_anti`` keep left rows.

    Other columns of both sides must have distinct names. Rows with a null coordinate have no neighbours.
    """
    keyed, others, keys = _keyed(left, right, coords, radius, salts)
    near = squared_distance([F.col(c) for c in coords], [F.col(f"_r_{c}") for c in coords]) <= F.lit(float(radius) ** 2)
    if how in ("left_semi", "left_anti"):
        condition = [keyed[k] == others[k] for k in keys]
        for c in condition:
            near = near & c
        kept = keyed.join(others, near, how).drop(*keys)
        if how == "left_semi":
            return kept
        absent = F.lit(False)
        for c in coords:
            absent = absent | F.col(c).isNull()
        return kept.unionByName(left.filter(absent))
    joined = keyed.join(others, keys).filter(near)
    d = F.sqrt(squared_distance([F.col(c) for c in coords], [F.col(f"_r_{c}") for c in coords]))
    return joined.withColumn("distance", d).drop(*keys, *(f"_r_{c}" for c in coords))


def within_radius(points: DataFrame, centers: DataFrame, coords: Sequence[str], radius: float, salts: int = 1) -> DataFrame:
    """Points within ``radius`` of any center."""
    return radius_join(points, centers.select(*coords).distinct(), coords, radius, how="left_semi", salts=salts)


def radius_counts(points: DataFrame, coords: Sequence[str], radius: float, id_column: str = "id", parts: int = 2) -> DataFrame:
    """How many points, itself included, lie within ``radius`` of each.

    Cells are so small that a few lie inside of the radius. Cells that are near for certain by their
    bounds count as a whole, and only places of cells between are compared, equal places once. Rows
    with a coordinate that isn't a finite number have no row.
    """
    folder, d = shared_folder(points.sparkSession), len(coords)
    side = radius / (parts * math.sqrt(d))
    finite = F.lit(True)
    for c in coords:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    rows = points.filter(finite).select(id_column, *coords)
    keys = [f"_c{i}" for i in range(d)]
    places = rows.groupBy(*coords).agg(F.count("*").alias("_n"))
    places = stored(places.select("*", *(c.alias(k) for c, k in zip(cell(coords, side), keys, strict=True))), folder, "places")
    counted = stored(places.groupBy(*keys).agg(F.sum("_n").alias("_all")), folder, "cells")
    reach = math.ceil(radius / side) + 1
    steps = []
    for step in itertools.product(range(-reach, reach + 1), repeat=d):
        least, most = (math.sqrt(sum(max(0, abs(x) + e) ** 2 for x in step)) * side for e in (-1, 1))
        if least * (1 - 1e-9) <= radius:
            steps.append(F.struct(*(F.lit(x).cast("long").alias(f"d{i}") for i, x in enumerate(step)), F.lit(most * (1 + 1e-9) < radius).alias("sure")))
    moved = counted.select(*keys, F.explode(F.array(*steps)).alias("_s")).select(*keys, "_s.sure", *((F.col(k) + F.col(f"_s.d{i}")).alias(f"_o{i}") for i, k in enumerate(keys)))
    others = counted.select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)), "_all")
    pairs = stored(moved.join(others, [f"_o{i}" for i in range(d)]), folder, "pairs")
    whole = pairs.filter("sure").groupBy(*keys).agg(F.sum("_all").alias("_whole"))
    there = places.select(*(F.col(c).alias(f"_r_{c}") for c in coords), F.col("_n").alias("_there"), *(F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)))
    border = places.select(*coords, *keys).join(pairs.filter("NOT sure").drop("_all"), keys).join(there, [f"_o{i}" for i in range(d)])
    near = squared_distance([F.col(c) for c in coords], [F.col(f"_r_{c}") for c in coords]) <= F.lit(float(radius) ** 2)
    some = border.filter(near).groupBy(*coords).agg(F.sum("_there").alias("_some"))
    found = places.join(whole, keys, "left").join(some, list(coords), "left")
    found = found.select(*coords, (F.coalesce("_whole", F.lit(0)) + F.coalesce("_some", F.lit(0))).alias("neighbors"))
    return rows.join(found, list(coords)).select(id_column, "neighbors")


def nearest_by_grid(queries: DataFrame, points: DataFrame, coords: Sequence[str], start: float, *, most: float | None = None, salts: int = 4) -> DataFrame:
    """``queries(query_id, coords)`` to (query_id, point_id, distance) of the nearest of ``points(point_id, coords)``.

    Distinct places only are searched, by blocks along a curve over the grid and a tree of their boxes, so
    that work doesn't grow with the points about a query, however crowded a cell of side ``start`` is or
    however far the next point. A query has no match (null) beyond ``most``, where its coordinates aren't
    numbers, and where there is no point. Ties go to the smaller point_id. ``start`` and ``salts`` belong
    to callers that size cells; neither changes the result.
    """
    folder = shared_folder(queries.sparkSession)
    number = F.lit(True)
    for c in coords:
        number = number & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = F.array(*(F.col(c).cast("double") for c in coords)).alias("x")
    there = points.filter(number & F.col("point_id").isNotNull()).groupBy(x).agg(F.min("point_id").alias("id"))
    marked = queries.select("query_id", F.when(F.coalesce(number, F.lit(False)), x).alias("x"))
    asked = stored(marked.filter("x IS NOT NULL").select("x").distinct().withColumn("id", F.monotonically_increasing_id()), folder, "asked")
    found = blocks.nearest(asked, there).join(asked.withColumnRenamed("id", "query_id"), "query_id").select("x", "point_id", "distance")
    if most is not None:
        found = found.filter(F.col("distance") <= most)
    return marked.join(found, "x", "left").select("query_id", "point_id", "distance")


def clipped_nearest(queries: DataFrame, points: DataFrame, most: float) -> DataFrame:
    """Nearest points of vectors, the distance clipped at ``most``; point_id -1 where none lies strictly within it."""
    found = blocks.nearest(queries, points)
    return found.select("query_id", F.when(F.col("distance") < most, F.col("point_id")).otherwise(F.lit(-1)).alias("point_id"), F.least("distance", F.lit(float(most))).alias("distance"))


def transfer_attribute(targets: DataFrame, sources: DataFrame, attribute: str, *, most: float | None = None, squared: bool = False, default=0) -> DataFrame:
    """Gives each of ``targets(id, x)`` the attribute of its nearest of ``sources(id, x, attribute)``.

    Beyond ``most`` the default holds. ``squared`` compares the squared distance with it.
    """
    found = blocks.nearest(targets, sources.select("id", "x"))
    value = F.col("distance") * F.col("distance") if squared else F.col("distance")
    near = F.lit(True) if most is None else value <= most
    named = sources.select(F.col("id").alias("point_id"), F.col(attribute).alias("_value"))
    joined = found.join(named, "point_id", "left")
    return joined.select(F.col("query_id").alias("id"), F.coalesce(F.when(near, F.col("_value")), F.lit(default)).alias(attribute), "distance")


def chamfer(a: DataFrame, b: DataFrame, *, power: int = 2, reduction: str = "mean") -> DataFrame:
    """Both one-way terms over nearest neighbours of ``(id, x)`` sets and their sum; L1 or squared L2; mean or sum."""
    value = F.col("distance") if power == 1 else F.col("distance") * F.col("distance")
    total = F.avg(value) if reduction == "mean" else F.sum(value)
    one, two = (blocks.nearest(x, y).agg(total.alias(n)) for x, y, n in ((a, b, "forward"), (b, a, "backward")))
    return one.join(two).select("forward", "backward", (F.col("forward") + F.col("backward")).alias("chamfer"))


def chamfer_l1_l2(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both one-way mean distances, their sum, and the sum of mean squared distances (``l2``), by one search each way."""
    d = F.col("distance")
    one, two = (blocks.nearest(x, y).agg(F.avg(d).alias(n), F.avg(d * d).alias(f"_{n}")) for x, y, n in ((a, b, "forward"), (b, a, "backward")))
    return one.join(two).select("forward", "backward", (F.col("forward") + F.col("backward")).alias("chamfer"), (F.col("_forward") + F.col("_backward")).alias("l2"))


def chamfer_normals(a: DataFrame, b: DataFrame, weight: str | None = None) -> DataFrame:
    """Both one-way means over ``(id, x, n)`` sets of 1 - |cos| of a row's normal and its nearest row's, and their sum.

    ``weight``, a column of both, weighs the rows; ids must be unique in each set.
    """

    def one_way(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        w = F.col(weight) if weight else F.lit(1.0)
        own = p.select(F.col("id").alias("query_id"), F.col("n").alias("_n"), w.alias("_w"))
        found = blocks.nearest(p, q).join(own, "query_id").join(q.select(F.col("id").alias("point_id"), F.col("n").alias("_m")), "point_id")
        size = lambda c: F.sqrt(array_dot(c, c))
        apart = 1 - F.abs(array_dot("_n", "_m")) / F.greatest(size("_n") * size("_m"), F.lit(1e-12))
        return found.agg((F.sum(F.col("_w") * apart) / F.sum("_w")).alias(name))

    both = one_way(a, b, "forward").join(one_way(b, a, "backward"))
    return both.select("forward", "backward", (F.col("forward") + F.col("backward")).alias("normals"))


def geometry_metrics(predicted: DataFrame, target: DataFrame, threshold: float) -> DataFrame:
    """Accuracy, completeness, Chamfer, precision, recall and F-score (in percent) of ``(id, x)`` clouds; F is null at 0/0."""
    inside = F.avg(F.when(F.col("distance") < threshold, 100.0).otherwise(0.0))
    to_target = blocks.nearest(predicted, target).agg(F.avg("distance").alias("accuracy"), inside.alias("precision"))
    to_predicted = blocks.nearest(target, predicted).agg(F.avg("distance").alias("completeness"), inside.alias("recall"))
    both = to_target.join(to_predicted)
    return both.select("accuracy", "completeness", ((F.col("accuracy") + F.col("completeness")) / 2).alias("chamfer"), "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("fscore"))


def capped_means(predicted: DataFrame, target: DataFrame, most: float) -> DataFrame:
    """Mean distances both ways, of those below ``most`` only."""
    under = F.avg(F.when(F.col("distance") < most, F.col("distance")))
    a = blocks.nearest(predicted, target).agg(under.alias("accuracy"))
    b = blocks.nearest(target, predicted).agg(under.alias("completeness"))
    return a.join(b).select("accuracy", "completeness", ((F.col("accuracy") + F.col("completeness")) / 2).alias("overall"))


def best_match(distances: DataFrame) -> DataFrame:
    """``(group, query_id, target, distance)``: for each group the target of least mean distance, ties to the least target."""
    means = distances.groupBy("group", "target").agg(F.avg("distance").alias("mean_distance"))
    return means.groupBy("group").agg(F.min(F.struct("mean_distance", "target")).alias("b")).select("group", "b.target", "b.mean_distance")


def plane_metrics(predicted: DataFrame, target: DataFrame, *, k: int = 20, most: float = 1.0, least: int = 20) -> DataFrame:
    """Completeness, accuracy and their mean over the k target planes with most points, weighted by those.

    Both are ``(id, x, plane)`` with ids of their own. Distances are clipped at ``most``. A target plane is matched
    with the predicted one, of more than ``least`` points, to which its points are nearest on average, ties to the
    least; accuracy is the mean distance back. Without predicted planes all three are ``most``. One row.
    """
    folder = shared_folder(predicted.sparkSession)
    sizes = target.filter("plane IS NOT NULL").groupBy("plane").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "plane").limit(k)
    sizes = stored(sizes.withColumnRenamed("plane", "goal"), folder, "largest")
    goals = target.withColumnRenamed("plane", "goal").join(F.broadcast(sizes.select("goal")), "goal", "left_semi")  # k rows
    large = predicted.groupBy("plane").count().filter(F.col("count") > least).select("plane")
    planes = predicted.join(large, "plane", "left_semi")
    clipped = F.avg(F.least("distance", F.lit(float(most))))
    there = blocks.nearest(goals, planes, by="plane").join(goals.select(F.col("id").alias("query_id"), "goal"), "query_id")
    means = there.groupBy("goal", "plane").agg(clipped.alias("completeness"))
    match = means.groupBy("goal").agg(F.min(F.struct("completeness", "plane")).alias("b")).select("goal", "b.plane", "b.completeness")
    match = stored(match, folder, "matches")
    back = blocks.nearest(planes, goals, by="goal").join(planes.select(F.col("id").alias("query_id"), "plane"), "query_id")
    accuracy = back.join(F.broadcast(match), ["goal", "plane"]).groupBy("goal").agg(clipped.alias("accuracy"))
    found = sizes.join(match, "goal").join(accuracy, "goal")
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("count")) / F.sum("count"), F.lit(float(most))).alias(c)
    return found.agg(mean("completeness"), mean("accuracy")).select("completeness", "accuracy", ((F.col("completeness") + F.col("accuracy")) / 2).alias("chamfer"))


def as_of(samples: DataFrame, knots: DataFrame, by: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Gives each sample the last knot at or before it and the first at or after it: prev_* and next_* of time and values.

    Knots and samples share a window ordered by time; equal times count as both.
    """
    marks = knots.select(*by, F.col(time), F.lit(0).alias("_kind"), F.struct(F.col(time), *values).alias("_knot"))
    asked = samples.select(*by, F.col(time), F.lit(1).alias("_kind"), F.lit(None).cast(dict(marks.dtypes)["_knot"]).alias("_knot"))
    rows = marks.unionByName(asked)
    back = W.partitionBy(*by).orderBy(time, "_kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(F.desc(time), "_kind").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", F.last("_knot", True).over(back).alias("_prev"), F.last("_knot", True).over(ahead).alias("_next")).filter("_kind = 1")
    out = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("_prev", "prev"), ("_next", "next")) for c in (time, *values)]
    return rows.select(*by, time, *out)


def interpolate(samples: DataFrame, knots: DataFrame, by: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Piecewise-linear values at the samples' times; constant beyond the first and last knot. ``time`` is a number."""
    found = as_of(samples, knots, by, time, values)
    span = F.col(f"next_{time}") - F.col(f"prev_{time}")
    u = (F.col(time) - F.col(f"prev_{time}")) / F.greatest(span, F.lit(1e-12))
    lerp = lambda v: F.coalesce(F.col(f"prev_{v}") + u * (F.col(f"next_{v}") - F.col(f"prev_{v}")), F.col(f"prev_{v}"), F.col(f"next_{v}"))
    return found.select(*by, time, *(lerp(v).alias(v) for v in values))


def interpolate_poses(samples: DataFrame, knots: DataFrame, by: Sequence[str], time: str, pose: str) -> DataFrame:
    """4x4 poses at the samples' times between those of the knots; constant beyond the ends."""
    from plumbline.functions import rotation as R

    found = as_of(samples, knots, by, time, [pose])
    u = (F.col(time) - F.col(f"prev_{time}")) / F.greatest(F.col(f"next_{time}") - F.col(f"prev_{time}"), F.lit(1e-12))
    between = R.lerp_se3_matrix(F.col(f"prev_{pose}"), F.col(f"next_{pose}"), u)
    inner = F.col(f"prev_{pose}").isNotNull() & F.col(f"next_{pose}").isNotNull()
    return found.select(*by, time, F.when(inner, between).otherwise(F.coalesce(f"prev_{pose}", f"next_{pose}")).alias(pose))


def semi_by_key(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is among ``keys``, such as contact vertices of a body part."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def hungarian(costs: DataFrame, group: str = "group") -> DataFrame:
    """Least-cost one-to-one assignment in each group of ``(group, row, col, cost)``; a group's matrix is one task's work.

    Missing pairs can't be assigned; the number of assigned pairs is as large as the method of shortest
    augmenting paths finds with them at a prohibitive cost.
    """
    import numpy as np
    import pandas as pd

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(pdf["row"]), np.unique(pdf["col"])
        n, m = len(rows), len(cols)
        far = 1e6 * (1 + np.abs(pdf["cost"]).sum())
        cost = np.full((n, m), far)
        cost[np.searchsorted(rows, pdf["row"]), np.searchsorted(cols, pdf["col"])] = pdf["cost"]
        turned = n > m
        c = cost.T if turned else cost
        pick = shortest_augmenting(c)
        pairs = [(j, i) if turned else (i, j) for i, j in enumerate(pick)]
        pairs = [(i, j) for i, j in pairs if cost[i, j] < far]
        return pd.DataFrame({group: pdf[group].iloc[0], "row": [rows[i] for i, _ in pairs], "col": [cols[j] for _, j in pairs], "cost": [cost[i, j] for i, j in pairs]})

    kinds = dict(costs.dtypes)
    return costs.select(group, "row", "col", F.col("cost").cast("double").alias("cost")).groupBy(group).applyInPandas(assign, f"{group} {kinds[group]}, row {kinds['row']}, col {kinds['col']}, cost double")


def shortest_augmenting(cost) -> list[int]:
    """The column of each row of a least-cost assignment; rows must not outnumber columns."""
    import numpy as np

    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        reach, via = np.full(m, np.inf), np.full(m, -1)
        settled, row, last, base = np.zeros(m, bool), start, -1, 0.0
        while True:
            slack = base + cost[row] - row_price[row] - col_price
            better = ~settled & (slack < reach)
            reach[better], via[better] = slack[better], last
            open_ = np.where(settled, np.inf, reach)
            last = int(np.argmin(open_))
            base, settled[last] = open_[last], True
            if owner[last] < 0:
                break
            row = owner[last]
        done = settled & (np.arange(m) != last)
        for j in np.flatnonzero(done):
            row_price[owner[j]] += base - reach[j]
            col_price[j] -= base - reach[j]
        row_price[start] += base
        while last >= 0:
            before = via[last]
            owner[last] = start if before < 0 else owner[before]
            last = before
    out = [0] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out
