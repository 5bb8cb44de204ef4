"""Nearest neighbours through bounding volumes against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import blocks, sampling, spatial
from plumbline.storage import shared_folder

KIND = "id long, x array<double>"


def cloud(n: int, d: int, seed: int, step: float | None = None) -> list[tuple]:
    r = random.Random(seed)
    value = lambda: r.choice([0.0, 0.5, 1.0, 1.5]) if step else r.gauss(0, 1) * r.choice([0.1, 1, 5])
    return [(i, [value() for _ in range(d)]) for i in range(n)]


def plain(queries, points, k, same=False, groups=None) -> Counter:
    out = Counter()
    for q, a in queries:
        found = [(float(np.sqrt(((np.array(b) - np.array(a)) ** 2).sum())), i, groups[i % len(groups)] if groups else None) for i, b in points if not (same and i == q)]
        for g in groups or [None]:
            for rank, (d, i, _) in enumerate(sorted(x for x in found if x[2] == g)[:k], 1):
                out[(q, rank, *([g] if groups else []), i, round(d, 9))] += 1
    return out


def got(df) -> Counter:
    return Counter((*r[:-1], round(r[-1], 9)) for r in map(tuple, df.collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in {"FEW_ROWS": 16, "ROWS": 16, "FAN": 3, "FLAT": 1, "RUN": 2, "TASK_ROWS": 300}.items():
        monkeypatch.setattr(blocks, name, value)


@pytest.mark.parametrize(("d", "k", "step"), [(1, 1, None), (2, 3, None), (3, 1, None), (3, 4, 0.5), (2, 1, 0.5), (6, 2, None), (9, 3, 0.5)])
def test_equal_to_all_pairs(spark, small, d, k, step):
    a, b = cloud(150, d, 1, step), cloud(400, d, 2, step)
    assert got(blocks.k_nearest(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), k)) == plain(a, b, k)


@pytest.mark.parametrize("flat", [False, True])
def test_nearest_of_each_group_in_one_pass(spark, flat, request):
    if not flat:
        request.getfixturevalue("small")
    a, b, groups = cloud(60, 3, 3), cloud(500, 3, 4), ["p", "q", "r"]
    points = spark.createDataFrame([(i, x, groups[i % 3]) for i, x in b], KIND + ", plane string")
    found = blocks.k_nearest(spark.createDataFrame(a, KIND), points, 2, by="plane")
    assert found.columns == ["query_id", "rank", "plane", "point_id", "distance"]
    assert got(found) == plain(a, b, 2, groups=groups)


def test_own_ids_negative_ids_and_odd_rows(spark, small):
    b = [(i - 200, x) for i, x in cloud(300, 2, 5, 0.5)]
    odd = [(None, [0.0, 0.0]), (900, None), (901, [float("nan"), 0.0]), (902, [float("inf"), 0.0]), (903, [None, 1.0])]
    df = spark.createDataFrame([*b, *odd, b[7]], KIND)
    assert got(blocks.k_nearest(df, df, 2, exclude_same_id=True)) == plain([*b, b[7]], [*b, b[7]], 2, same=True)


def test_empty_sides(spark):
    some, none = spark.createDataFrame(cloud(5, 2, 6), KIND), spark.createDataFrame([], KIND)
    assert blocks.k_nearest(none, some, 1).count() == blocks.k_nearest(some, none, 1).count() == 0
    assert blocks.nearest(some, none).columns == blocks.nearest(some, some).columns


def test_equal_points_are_spread(spark, small):
    b = [(i, [1.0, 2.0]) for i in range(500)] + [(1000 + i, x) for i, x in cloud(100, 2, 7)]
    a = cloud(40, 2, 8) + [(99, [1.0, 2.0])]
    assert got(blocks.k_nearest(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), 3)) == plain(a, b, 3)


def admitted(spark, n: int) -> tuple[int, int]:
    points = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("x"))
    folder = shared_folder(spark)
    key = blocks.curve([0.0] * 2, [1.0] * 2)
    packed = blocks.pack(blocks._clean(points, None), folder, "points", key, 64, n)
    pairs, _ = blocks.pairs_of(packed, packed, 2, 1, True, folder)
    return pairs.count(), packed.boxes.count() ** 2


def test_pairs_grow_with_the_cloud_not_its_square(spark):
    (few, all_few), (many, all_many) = admitted(spark, 16_000), admitted(spark, 32_000)
    assert few < 0.2 * all_few and many < 0.1 * all_many
    assert many < 2.5 * few


def test_queries_leave_blocks_out():
    r = np.random.default_rng(1)
    batch = next(blocks._packed(1000)(iter([_table(r.normal(0, 1, (200, 2)), 0)]))), next(blocks._packed(1000)(iter([_table(r.normal(0, 1, (200, 2)), 0)]))), next(blocks._packed(1000)(iter([_table(r.normal(50, 1, (200, 2)), 500)])))
    search = blocks.Search(batch[0]["blob"][0].as_py(), None, 1, False)
    for b in batch[1:]:
        search.add(b["blob"][0].as_py())
    assert search.compared == 200 * 200


def _table(x: np.ndarray, start: int):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"id": pa.array(range(start, start + len(x)), pa.int64()), "x": pa.array(x.tolist()), "part": pa.array([0] * len(x), pa.int32())})


def test_plane_metrics(spark):
    target = [(i, [float(i % 10), 0.0, 0.0], "floor") for i in range(60)] + [(100 + i, [0.0, float(i % 8), 5.0], "wall") for i in range(40)] + [(200, [9.0, 9.0, 9.0], "speck")]
    predicted = [(i, [float(i % 10), 0.0, 0.1], 7) for i in range(30)] + [(50 + i, [0.0, float(i % 8), 5.3], 8) for i in range(24)] + [(90 + i, [0.0, 0.0, 5.0], 9) for i in range(5)]
    kind = "id long, x array<double>, plane "
    found = spatial.plane_metrics(spark.createDataFrame(predicted, kind + "int"), spark.createDataFrame(target, kind + "string"), k=2, most=0.25)
    want = (0.1 * 60 + 0.25 * 40) / 100
    assert [round(v, 9) for v in found.first()] == [round(v, 9) for v in (want, want, want)]
    none = spark.createDataFrame([], kind + "int")
    assert tuple(spatial.plane_metrics(none, spark.createDataFrame(target, kind + "string"), most=0.25).first()) == (0.25, 0.25, 0.25)


@pytest.mark.parametrize(("d", "parts"), [(1, 2), (2, 2), (2, 4), (3, 1)])
def test_radius_counts_with_crowded_places(spark, d, parts):
    r = random.Random(d * 10 + parts)
    rows = [(i, *(r.choice([0.0, 0.3, r.random() * 4]) for _ in range(d))) for i in range(250)] + [(1000 + i, *[0.0] * d) for i in range(120)]
    coords = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([*rows, (5000, *[None] * d), (5001, *[float("nan")] * d)], "id long, " + ", ".join(f"{c} double" for c in coords))
    x = np.array([row[1:] for row in rows])
    want = (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.5**2).sum(axis=1)
    got = {row["id"]: row["neighbors"] for row in spatial.radius_counts(df, coords, 0.5, parts=parts).collect()}
    assert got == {row[0]: n for row, n in zip(rows, want.tolist(), strict=True)}


def test_greedy_matching_equals_going_down_the_list(spark):
    r = random.Random(4)
    rows = [(g, a, b, r.choice([0.1, 0.2, 0.5, r.random()])) for g in "pq" for a in range(12) for b in range(9) if r.random() < 0.6]
    kind = "pair string, gt int, pred int, score double"
    found = sampling.greedy_matching(spark.createDataFrame([*rows, ("p", 0, 0, None), ("p", 1, 1, float("nan"))], kind), ["pair"], "gt", "pred")
    want = set()
    for g in "pq":
        used: set = set()
        for _, a, b, s in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[1], x[2])):
            if ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                want.add((g, a, b, s))
    assert {tuple(x) for x in found.collect()} == want and found.columns == ["pair", "gt", "pred", "score"]
    assert sampling.greedy_matching(spark.createDataFrame([], kind), ["pair"], "gt", "pred").count() == 0
