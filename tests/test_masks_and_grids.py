"""Run-length masks, windows over several axes, the voxel store, negative planes and split primitives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster, grids, primitives, runs, voxels


def masks(spark, data):
    return runs.encode(spark.createDataFrame([(k, p) for k, places in data.items() for p in places], "m string, p long"), ["m"], "p")


def test_runs_and_back(spark):
    r = masks(spark, {"a": [3, 4, 4, 5, 9, None], "b": [-1, 0]})
    assert sorted(tuple(x) for x in r.collect()) == [("a", 3, 6), ("a", 9, 10), ("b", -1, 1)]
    assert sorted(x["place"] for x in runs.decode(r).filter("m = 'a'").collect()) == [3, 4, 5, 9]
    with pytest.raises(ValueError, match="key"):
        runs.encode(spark.range(3), [], "id")


def test_algebra_of_random_masks(spark):
    r = random.Random(1)
    a = {k: {r.randrange(60) for _ in range(r.randrange(50))} for k in "uvwx"}
    b = {k: {r.randrange(60) for _ in range(r.randrange(50))} for k in "vwxy"}
    left, right = masks(spark, a), masks(spark, b)
    for how, f in (("union", set.union), ("intersection", set.intersection), ("difference", set.difference), ("symmetric", set.symmetric_difference)):
        found = runs.combine(left, right, ["m"], how)
        want = {(k, p) for k in "uvwxy" for p in f(a.get(k, set()), b.get(k, set()))}
        assert {tuple(x) for x in runs.decode(found).select("m", "place").collect()} == want
        assert found.exceptAll(runs.encode(runs.decode(found), ["m"], "place").select(found.columns)).count() == 0  # as few runs as can be
    one = {x["m"]: x for x in runs.scores(left, right, ["m"]).collect()}
    assert all(abs((one[k]["iou"] or 0) - len(a[k] & b[k]) / max(1, len(a[k] | b[k]))) < 1e-12 for k in "vwx" if k in one)


def test_overlapping_and_empty_runs(spark):
    r = spark.createDataFrame([("i", 0, 10), ("i", 5, 12), ("i", 5, 5), ("i", 20, 21), ("i", 12, 13)], "image string, start long, end long")
    assert sorted(tuple(x)[1:] for x in runs.coverage(r, ["image"]).collect()) == [(0, 13), (20, 21)]
    assert sorted(tuple(x)[1:] for x in runs.overlaps(r, ["image"]).collect()) == [(1, 9), (2, 5)]
    assert runs.new_keys(spark.range(3), spark.range(1, 5), ["id"]).count() == 2 and runs.common_keys(spark.range(3), spark.range(1, 5), ["id"]).count() == 2


def test_places_and_ends_are_held_in_no_table(spark):
    """Masks are encoded and swept in sorted order: only a key's sums are aggregated, of which there are few."""
    r = masks(spark, {"a": [3, 4, 4, 5, 9, None], "b": [-1, 0]})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(r)
    assert "Aggregate" not in plan(runs.combine(r, r, ["m"], "union"))
    assert plan(runs.scores(r, r, ["m"])).count("Aggregate") == 1


def test_all_operations_from_one_sweep(spark):
    r = random.Random(5)
    a, b = ({k: {r.randrange(-20, 40) for _ in range(r.randrange(50))} for k in keys} for keys in ("uvwx", "vwxy"))
    left, right = masks(spark, a), masks(spark, b)
    got = runs.algebra(left, right, ["m"])
    want = None
    for how in ("union", "intersection", "difference", "symmetric"):
        one = runs.combine(left, right, ["m"], how).withColumn("how", F.lit(how))
        want = one if want is None else want.unionByName(one)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_shared_areas_need_no_join(spark):
    data = spark.createDataFrame([("i", 0, 10), ("i", 5, 12), ("i", 5, 5), ("i", 20, 21), ("i", 12, 13), (None, 1, 3), ("e", 4, 4)], "image string, start long, end long")
    got = runs.shared_areas(data, ["image"])
    assert {tuple(x) for x in got.collect()} == {("i", 14, 5, 2, 2), (None, 2, 0, 1, 1)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("shape", "size", "stride", "padding"), [((9,), 3, 2, 1), ((7, 8), (3, 2), (1, 2), (1, 0)), ((5, 6, 4), (2, 3, 2), (2, 1, 1), (1, 1, 0))])
def test_pooling_over_axes(spark, shape, size, stride, padding):
    x = np.random.default_rng(3).normal(0, 1, shape)
    x[x > 1] = np.nan
    names = "abc"[: len(shape)]
    cells = spark.createDataFrame([(*map(int, i), float(x[i])) for i in np.ndindex(shape)], ", ".join(f"{n} int" for n in names) + ", v double")
    got = {tuple(r)[:-1]: r["v"] for r in grids.pooled(cells, [], dict(zip(names, shape, strict=True)), "v", size, stride, padding).collect()}
    k, s, p = (np.broadcast_to(z, len(shape)) for z in (size, stride, padding))
    full = np.pad(x, [(q, q) for q in p], constant_values=np.nan)
    counts = [(n - a + 1) // b for n, a, b in zip(full.shape, k, s, strict=True)]
    for o in np.ndindex(*counts):
        part = full[tuple(slice(i * b, i * b + a) for i, a, b in zip(o, k, s, strict=True))]
        want = None if np.isnan(part).all() else np.nanmax(part)
        assert got[o] == want
    assert len(got) == np.prod(counts)


def test_windows_over_axes(spark):
    x = np.arange(30.0).reshape(5, 6)
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in np.ndindex(5, 6) if (i, j) != (0, 1)], "y int, x int, v double")
    got = {(r["y"], r["x"]): r["window"] for r in grids.windows(cells, [], {"y": 5, "x": 6}, "v", (2, 3), (1, 2)).collect()}
    view = np.lib.stride_tricks.sliding_window_view(x, (2, 3))[:4, ::2]
    assert set(got) == set(np.ndindex(4, 2)) and got[0, 0][1] is None
    assert all(got[o] == view[o].ravel().tolist() for o in got if o != (0, 0))


SEEN = "i long, j long, k long, value double, weight double"


def test_two_batches_equal_one(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(-9, 9), r.randrange(9), r.randrange(9), r.random(), r.choice([0.5, 1.0, 2.0])) for _ in range(400)] + [(0, 0, 0, None, 1.0), (0, 0, 0, float("nan"), 1.0), (0, 0, 0, 1.0, 0.0)]
    first, second = spark.createDataFrame(rows[:150], SEEN), spark.createDataFrame(rows[150:], SEEN)
    voxels.merge(spark.createDataFrame(rows, SEEN), f"{tmp_path}/one", 0)
    voxels.merge(first, f"{tmp_path}/two", 0)
    for _ in range(2):  # a run that is repeated counts once
        voxels.merge(second, f"{tmp_path}/two", 1)
    rounded = lambda df: sorted((x["i"], x["j"], x["k"], round(x["value"], 9), round(x["weight"], 9), x["n"]) for x in df.collect())
    want = rounded(voxels.state(spark, f"{tmp_path}/one"))
    assert rounded(voxels.state(spark, f"{tmp_path}/two")) == want
    assert rounded(voxels.state(spark, f"{tmp_path}/two", 0)) == rounded(voxels._mean(voxels.summed(first)))
    voxels.compact(spark, f"{tmp_path}/two", f"{tmp_path}/three", 1)
    assert rounded(voxels.state(spark, f"{tmp_path}/three")) == want
    assert rounded(voxels.region(spark, f"{tmp_path}/two", (-4, 0, 2), (3, 4, 8))) == [w for w in want if -4 <= w[0] <= 3 and w[1] <= 4 and w[2] >= 2]


def test_a_linear_field_stays_linear(spark):
    grid = spark.createDataFrame([(i, j, k, 1.0 * i + 10 * j - 3 * k, 1.0) for i in range(2, 6) for j in range(3) for k in range(5)], SEEN)
    got = voxels.resampled(grid, 7).collect()
    assert len(got) == 343
    assert all(abs(r["value"] - ((2 + r["x"] * 0.5) + 10 * r["y"] / 3 - 3 * r["z"] * 4 / 6)) < 1e-9 for r in got)
    assert voxels.resampled(grid.limit(0), 4).count() == 0 and voxels.resampled(grid.limit(1), 2).count() == 8


def test_negative_planes_equal_all_pairs(spark):
    r = np.random.default_rng(5)
    n = r.normal(0, 1, (300, 3)) * [1, 0.3, 0.3]
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    n[100:150], d = n[7], r.choice([0.0, 0.1, 0.35, 1.0], 300) + r.random(300) * 0.1
    d[100:150] = d[7]
    rows = [(i, n[i].tolist(), float(d[i])) for i in range(300)] + [(None, [1.0, 0.0, 0.0], 0.0), (900, None, 0.0)]
    for angle, gap in ((0.02, 0.2), (0.3, 0.05)):
        got = {x["id"]: x["negatives"] for x in cluster.negative_counts(spark.createDataFrame(rows, "id long, n array<double>, d double"), angle=angle, gap=gap).collect()}
        want = ((1 - n @ n.T > angle) | (np.abs(d[:, None] - d) > gap)).sum(axis=1)
        assert got == dict(enumerate(want.tolist()))


def test_split_parts_have_their_own_colours(spark):
    r = np.random.default_rng(6)
    low, high = r.random((400, 2)) * [4, 0.5], r.random((400, 2)) * [0.5, 4] + [0, 0.5]
    p = np.concatenate([low, high])
    rows = [(1, i % 3, i, float(x), float(y), 0.0, float(x), float(y), 0.5) for i, (x, y) in enumerate(p.tolist())]
    points = spark.createDataFrame(rows, "gid long, frame int, id long, x double, y double, z double, r double, g double, b double")
    parts = primitives.fit_primitives(points).collect()
    assert len(parts) > 1 and sum(x["n"] for x in parts) == 800
    assert np.allclose(sum(np.array(x["color"]) * x["n"] for x in parts) / 800, [*p.mean(axis=0), 0.5])
    for x in parts:  # colours are the points' places, so they lie in the part's box
        box, at = np.array(x["r"]).reshape(3, 3), np.array([*x["color"][:2], 0.0]) - np.array(x["t"])
        assert (np.abs(at @ box) <= np.exp(x["s_log"]) + 0.02).all()
    assert len({tuple(np.round(x["color"], 3)) for x in parts}) == len(parts)
