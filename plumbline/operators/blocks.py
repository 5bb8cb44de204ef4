"""Exact nearest neighbours through a tree of bounding volumes.

Rows are dealt out along a Z-curve; a task halves its rows across their widest side until they fit
blocks, each with its box and the sphere around its middle. Blocks of points are the leaves of a tree of boxes; a level is a small table, and a node's
children are found by an equi-join on its number. Each block of queries first descends to the one
block that looks nearest, which bounds how far its neighbours can lie. Then it descends again into
all boxes within that bound, and only the blocks found there are searched, the nearest first; a
query leaves one out where its box lies farther off than the k-th point so far. So in two or three
dimensions a block of queries meets a number of blocks that doesn't grow with the cloud. In many
dimensions boxes tell little apart and most pairs of blocks are searched.

With ``by``, points belong to groups, each with a tree of its own, and each query gets the nearest
points of every group in one pass.
"""

from __future__ import annotations

import io
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.numbering import numbered
from plumbline.storage import shared_folder, stored

#: Up to so many dimensions blocks are small, as boxes tell them apart; rows of a block there, and beyond.
LOW, FEW_ROWS, ROWS = 4, 512, 4096

#: Children of a node; nodes of a level that a first descent follows; blocks a group of points may have without a tree; blocks of points that one task searches for a block of queries.
FAN, BEAM, FLAT, RUN = 32, 4, 2, 64

#: Dimensions and bits of a place on the curve, rows and bytes of a sorting or searching task.
KEYED, KEY_BITS, TASK_ROWS, TASK_BYTES = 8, 48, 1 << 16, 32 << 20

#: More than the rounding errors of a bound.
_SLACK = 1e-9


@dataclass
class Blocks:
    """Packed rows: ``data`` (block, blob) and ``boxes`` (block, part, n, lo, hi, middle, radius); blocks ascend along the curve."""

    data: DataFrame
    boxes: DataFrame


def _clean(df: DataFrame, by: str | None) -> DataFrame:
    x = F.transform("x", lambda v: v.cast("double"))
    part = F.col(by) if by else F.lit(0)
    rows = df.select(F.col("id").cast("long").alias("id"), x.alias("x"), part.alias("part")).filter("id IS NOT NULL AND x IS NOT NULL AND part IS NOT NULL")
    return rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))))


def curve(low: list[float], high: list[float]) -> Column:
    """A vector's place on a Z-curve over the box of its first dimensions."""
    d = len(low)
    bits = KEY_BITS // d
    cells = []
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        share = (F.get("x", F.lit(i)) - F.lit(a)) / F.lit((b - a) or 1.0)
        cells.append(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (2**bits - 1)).cast("long"))
    key = F.lit(0).cast("long")
    for i, c in enumerate(cells):
        for j in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, j).bitwiseAND(F.lit(1).cast("long")), j * d + i))
    return key


def halved(x: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in compact sets of ``most`` at most: cut in two across the widest side, again and again."""
    waiting = [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= most:
            yield rows
            continue
        side = x[rows, np.ptp(x[rows], axis=0).argmax()]
        half = most * math.ceil(len(rows) / most / 2)
        order = np.argpartition(side, half - 1)
        waiting += [rows[order[half:]], rows[order[:half]]]


def _packed(most: int):
    def block(part: pa.Array, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = io.BytesIO()
        np.savez(out, ids=ids, x=x)
        lo, hi = x.min(axis=0), x.max(axis=0)
        middle = (lo + hi) / 2
        radius = float(np.sqrt(((x - middle) ** 2).sum(axis=1).max()))
        lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (lo, hi, middle)]
        return pa.RecordBatch.from_arrays([part, pa.array([len(ids)], pa.int32()), *lists, pa.array([radius]), pa.array([out.getvalue()], pa.binary())], ["part", "n", "lo", "hi", "middle", "radius", "blob"])

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([b["id"].to_numpy() for b in held])
        x = np.concatenate([np.array(b["x"].to_pylist(), dtype=np.float64).reshape(b.num_rows, -1) for b in held])
        for rows in halved(x, most):
            yield block(held[0]["part"].slice(0, 1), ids[rows], x[rows])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            parts = batch["part"].to_pylist()
            starts = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
            for a, b in itertools.pairwise(starts):
                if held and (n >= TASK_ROWS or held[0]["part"][0].as_py() != parts[a]):
                    yield from blocks(held)
                    held, n = [], 0
                held.append(batch.slice(a, b - a))
                n += b - a
        if held:
            yield from blocks(held)

    return pack


def pack(df: DataFrame, folder: str, name: str, key: Column, rows: int, count: int) -> Blocks:
    """Rows (id, x, part) dealt along the curve and packed; a block has one part. Few rows are packed by one task, without the curve."""
    n = max(1, math.ceil(count / TASK_ROWS))
    order = ["part", "key", "id"] if n > 1 else ["part"]
    ranged = stored(df.withColumn("key", key), folder, f"{name}-rows").repartitionByRange(n, *order) if n > 1 else df.coalesce(1)
    kind = dict(df.dtypes)["part"]
    found = ranged.sortWithinPartitions(*order).select("id", "x", "part").mapInArrow(_packed(rows), f"part {kind}, n int, lo array<double>, hi array<double>, middle array<double>, radius double, blob binary")
    found = stored(found.withColumn("block", F.monotonically_increasing_id()), folder, name)
    return Blocks(found.select("block", "blob"), found.drop("blob"))


def apart(a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> Column:
    """The least distance of points of two boxes."""
    over = F.zip_with(a_lo, b_hi, lambda a, b: a - b)
    under = F.zip_with(b_lo, a_hi, lambda b, a: b - a)
    gaps = F.zip_with(over, under, lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


def _between(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, g: s + g))


def tree(blocks: Blocks, folder: str, d: int, most: int) -> list[DataFrame]:
    """Levels of (part, node, up, lo, hi), leaves first; the last has a node for each part, of ``most`` blocks at most."""
    places = stored(numbered(blocks.boxes, ["block"], "place"), folder, "places")
    starts = places.groupBy("part").agg(F.min("place").alias("start"))
    leaves = places.join(starts, "part").select("part", "block", (F.col("place") - F.col("start")).alias("node"), "lo", "hi", "middle", "radius")
    up = F.floor(F.col("node") / FAN).alias("up")
    levels = [stored(leaves.select("*", up), folder, "tree-0")]
    while most > 1:
        side = lambda f, c: F.array(*(f(F.get(c, F.lit(i))) for i in range(d))).alias(c)
        nodes = levels[-1].groupBy("part", "up").agg(side(F.min, "lo"), side(F.max, "hi")).withColumnRenamed("up", "node")
        levels.append(stored(nodes.select("*", up), folder, f"tree-{len(levels)}"))
        most = math.ceil(most / FAN)
    return levels


def _descend(queries: DataFrame, levels: list[DataFrame], nearest: bool) -> DataFrame:
    """(query, part, block, gap) of the leaves that each query block reaches: the one that looks nearest, or all within ``bound``."""
    root = levels[-1].select("part", "node")
    at = queries.join(root, "part") if "part" in queries.columns else queries.crossJoin(root)  # a row for each part
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if k < len(levels) - 1:
            at = at.withColumnRenamed("node", "up").join(level, ["part", "up"]).drop("up")
        else:
            at = at.join(level.drop("up"), ["part", "node"])
        gap = apart("q_lo", "q_hi", "lo", "hi")
        if k == 0:
            gap = F.greatest(gap, _between("q_middle", "middle") - F.col("q_radius") - F.col("radius"))
        at = at.withColumn("gap", gap * (1 - _SLACK))
        if nearest:
            middle = F.transform(F.arrays_zip("lo", "hi"), lambda z: (z["lo"] + z["hi"]) / 2)
            at = at.withColumn("near", middle).withColumn("near", _between("q_middle", "near"))
            kept = ["q_lo", "q_hi", "q_middle", "q_radius"]
            last = ["node", "block"] if k == 0 else ["node"]
            first = F.slice(F.sort_array(F.collect_list(F.struct("gap", "near", *last))), 1, BEAM if k else 1)  # of BEAM x FAN nodes at most
            best = at.groupBy("query", "part").agg(first.alias("b"), *(F.first(c).alias(c) for c in kept)).withColumn("b", F.explode("b"))
            at = best.select("query", "part", *kept, *(f"b.{c}" for c in last), "b.gap")
        else:
            at = at.filter(F.col("gap") <= F.col("bound")).select("query", "part", "q_lo", "q_hi", "q_middle", "q_radius", "bound", "node", "gap", *(["block"] if k == 0 else []))
    return at.select("query", "part", "block", "gap")


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return found["ids"], found["x"]


def k_best(a: np.ndarray, b: np.ndarray, b_ids: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids, (rows of a, k), of the nearest rows of b, whose ids ascend; inf and -1 where there are fewer."""
    n, k_here = len(a), min(k, len(b))
    d, ids = np.full((n, k), np.inf), np.full((n, k), -1, dtype=np.int64)
    if a.shape[1] <= LOW:
        for i in range(0, n, 512):
            full = np.sqrt(((a[i : i + 512, None, :] - b[None]) ** 2).sum(axis=2))
            if own is not None:
                full[own[i : i + 512, None] == b_ids[None]] = np.inf
            pick = full.argmin(axis=1)[:, None] if k == 1 else np.argsort(full, axis=1, kind="stable")[:, :k_here]
            d[i : i + 512, :k_here] = np.take_along_axis(full, pick, 1)
            ids[i : i + 512, :k_here] = b_ids[pick]
    else:
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        for i in range(0, n, 512):
            part = na[i : i + 512, None] + nb[None, :] - 2 * (a[i : i + 512] @ b.T)
            for j, row in enumerate(part, i):
                if own is not None:
                    row[b_ids == own[j]] = np.inf
                slack = 1e-9 * (na[j] + nb.max(initial=0)) + 1e-30
                kth = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                able = np.flatnonzero((row <= kth + slack) & (row < np.inf))
                exact = np.sqrt(((b[able] - a[j]) ** 2).sum(axis=1))
                best = np.lexsort((b_ids[able], exact))[:k]
                d[j, : len(best)], ids[j, : len(best)] = exact[best], b_ids[able][best]
    ids[d == np.inf] = -1
    return d, ids


def merged(d: np.ndarray, ids: np.ndarray, more_d: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of k for each row, ties to the smaller id."""
    k = d.shape[1]
    d, ids = np.concatenate([d, more_d], axis=1), np.concatenate([ids, more_ids], axis=1)
    order = np.argsort(ids, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


class Search:
    """The k best of a block of queries, while blocks of points come one by one."""

    def __init__(self, blob: bytes, bounds: bytes | None, k: int, exclude_same_id: bool):
        self.ids, self.x = _unpacked(blob)
        self.k, self.own = k, self.ids if exclude_same_id else None
        self.bounds = np.frombuffer(bounds) if bounds else np.full(len(self.x), np.inf)
        self.d, self.found = np.full((len(self.x), k), np.inf), np.full((len(self.x), k), -1, dtype=np.int64)
        self.compared = 0

    def add(self, blob: bytes) -> None:
        ids, x = _unpacked(blob)
        gap = np.maximum(np.maximum(x.min(axis=0) - self.x, self.x - x.max(axis=0)), 0)
        near = np.sqrt((gap * gap).sum(axis=1)) * (1 - _SLACK)
        at = np.flatnonzero(near <= np.minimum(self.bounds, self.d[:, -1]))
        if len(at):
            self.compared += len(at) * len(x)
            best = k_best(self.x[at], x, ids, None if self.own is None else self.own[at], self.k)
            self.d[at], self.found[at] = merged(self.d[at], self.found[at], *best)


def _bounds(k: int, exclude_same_id: bool):
    """For each pair of a query block and its seed: each query's distance to its k-th point there, and the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bytes] = []
            most: list[float] = []
            for q, p in zip(batch["q_blob"], batch["blob"], strict=True):
                search = Search(q.as_py(), None, k, exclude_same_id)
                search.add(p.as_py())
                kth = search.d[:, -1] * (1 + _SLACK)
                kept.append(kth.tobytes())
                most.append(float(kth.max()))
            yield pa.RecordBatch.from_arrays([batch["query"], batch["part"], pa.array(kept, pa.binary()), pa.array(most, pa.float64())], ["query", "part", "bounds", "bound"])

    return run


def _searched(k: int, exclude_same_id: bool):
    names = ["query", "part", "row", "query_id", "point_id", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, search, part = None, None, None

        def done() -> pa.RecordBatch:
            row, place = np.nonzero(search.d < np.inf)
            parts = part.take(pa.array(np.zeros(len(row), np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), query), pa.int64()), parts, pa.array(row, pa.int32()), pa.array(search.ids[row]), pa.array(search.found[row, place]), pa.array(search.d[row, place])], names)

        for batch in batches:
            for i in range(batch.num_rows):
                if batch["kind"][i].as_py() == 0:
                    if search is not None:
                        yield done()
                    query, part = batch["query"][i].as_py(), batch["part"].slice(i, 1)
                    search = Search(batch["blob"][i].as_py(), batch["bounds"][i].as_py(), k, exclude_same_id)
                else:
                    search.add(batch["blob"][i].as_py())
        if search is not None:
            yield done()

    return run


def pairs_of(queries: Blocks, points: Blocks, d: int, k: int, exclude_same_id: bool, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """(query, part, block, gap) of the blocks to search, and (query, part, bounds) of the queries' own bounds."""
    own = queries.boxes.select(F.col("block").alias("query"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("middle").alias("q_middle"), F.col("radius").alias("q_radius"))
    most = points.boxes.groupBy("part").count().agg(F.max("count")).first()[0]
    if most <= FLAT:
        every = own.select("query").crossJoin(points.boxes.select("part", "block"))  # FLAT blocks of each part at most
        return every.withColumn("gap", F.lit(0.0)), None
    levels = tree(points, folder, d, most)
    seeds = stored(_descend(own, levels, True), folder, "seeds")
    seeds = seeds.join(queries.data.select(F.col("block").alias("query"), F.col("blob").alias("q_blob")), "query").join(points.data, "block")
    kind = dict(points.boxes.dtypes)["part"]
    bounds = stored(seeds.select("query", "part", "q_blob", "blob").mapInArrow(_bounds(k, exclude_same_id), f"query long, part {kind}, bounds binary, bound double"), folder, "bounds")
    wide = own.join(bounds.select("query", "part", "bound"), "query")
    return stored(_descend(wide, levels, False), folder, "pairs"), bounds.select("query", "part", "bounds")


def k_nearest(queries: DataFrame, points: DataFrame, k: int, *, exclude_same_id: bool = False, by: str | None = None) -> DataFrame:
    """``queries(id, x)`` and ``points(id, x)``, x an array, to (query_id, rank, point_id, distance).

    With ``by``, a column of ``points``, each query has its k nearest in each of those groups, and
    the group is a column of that name. Ties go to the smaller point id. Rows with a null id, vector
    or group, and vectors with a component that isn't a finite number, take no part. Repeated
    queries have their points each time. Vectors must be equally long.
    """
    spark = queries.sparkSession
    folder = shared_folder(spark)
    asked, there = _clean(queries, None), _clean(points, by)
    first = there.select(F.size("x").alias("d")).first()
    kind = dict(there.dtypes)["part"]
    name = by or "part"
    if first is None:
        empty = spark.createDataFrame([], f"query_id long, rank int, `{name}` {kind}, point_id long, distance double")
        return empty if by else empty.drop(name)
    d = first["d"]
    extent = there.agg(F.count("*").alias("n"), *(f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(min(d, KEYED)) for n, f in (("a", F.min), ("b", F.max)))).first()
    keyed = range(min(d, KEYED))
    key = curve([extent[f"a{i}"] for i in keyed], [extent[f"b{i}"] for i in keyed])
    rows = FEW_ROWS if d <= LOW else ROWS
    q, p = pack(asked, folder, "queries", key, rows, asked.count()), pack(there, folder, "points", key, rows, extent["n"])
    pairs, bounds = pairs_of(q, p, d, k, exclude_same_id, folder)
    near = W.partitionBy("query", "part").orderBy("gap", "block")
    runs = pairs.withColumn("run", F.floor((F.row_number().over(near) - 1) / RUN) if bounds is not None else F.lit(0).cast("long"))
    nothing = F.lit(None).cast("binary").alias("bounds")
    heads = runs.select("query", "part", "run").distinct().join(q.data.withColumnRenamed("block", "query"), "query")
    heads = heads.withColumn("bounds", nothing) if bounds is None else heads.join(bounds, ["query", "part"])
    heads = heads.select("query", "part", "run", F.lit(0).alias("kind"), F.lit(0.0).alias("gap"), "blob", "bounds")
    bodies = runs.join(p.data, "block").select("query", "part", "run", F.lit(1).alias("kind"), "gap", "blob", nothing)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() * rows * (d + 1) * 8 / TASK_BYTES))
    dealt = heads.unionByName(bodies).repartition(tasks, "query", "part", "run").sortWithinPartitions("query", "part", "run", "kind", "gap")
    hits = dealt.select("query", "part", "kind", "blob", "bounds").mapInArrow(_searched(k, exclude_same_id), f"query long, part {kind}, row int, query_id long, point_id long, distance double")
    order = W.partitionBy("query", "row", "part").orderBy("distance", "point_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", *([F.col("part").alias(by)] if by else []), "point_id", "distance")


def nearest(queries: DataFrame, points: DataFrame, *, exclude_same_id: bool = False, by: str | None = None) -> DataFrame:
    """Each query's nearest point (of each group): (query_id, point_id, distance)."""
    return k_nearest(queries, points, 1, exclude_same_id=exclude_same_id, by=by).drop("rank")
