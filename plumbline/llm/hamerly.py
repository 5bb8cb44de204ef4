"""Lloyd's rounds on integer vectors, with Hamerly's bounds kept beside each vector.

The state is a table in the shared folder: a vector, its cluster, an upper bound on the distance to
that cluster's centroid and a lower bound on the distance to any other. After an update the bounds
are loosened by how far the centroids have moved. Where the upper bound still lies under the lower
one, or under half the way to the nearest other centroid, the cluster can't change, ties included;
then the upper bound is made exact and held against them once more, and only vectors that fail
again are compared with all centroids, in integers. Sums are integers too and change by the vectors
that moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, stored
from plumbline.storage import remove

#: Components of a kept vector, what they are multiplied with, clusters, and updates.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3

#: Components must lie under this size, so that squared distances fit 64 bits.
LARGEST = 2**27

#: More than all rounding errors of a few operations on doubles.
_SLACK = 1e-12

_STATE = "vec_id long, x array<long>, cluster int, before int, upper double, lower double, scanned boolean"


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, integers floor(scale * component), of vectors with so many finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    rows = vectors.filter((F.size("embedding") == dimensions) & sound)
    whole = F.transform(x, lambda v: F.when(F.abs(v) * scale < LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} must lie under {LARGEST}")).cast("long")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> list[list[int]]:
    """The vectors of the least hashes of ``seed:vec_id``, in their order; null ids come last, equal ids by components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r["x"] for r in rows.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, (vectors, centroids), as integers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest**2 * x.shape[1] < 2**53:  # every partial sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + _SLACK)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - _SLACK)


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bounds on how far the centroids went."""
    return _above(((new - old) ** 2).sum(axis=1))


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its bounds, and which were compared with all centroids."""
    k = len(centroids)
    cluster, fresh = cluster.copy(), cluster < 0
    at = np.where(fresh, 0, cluster)
    most = np.argmax(drift)
    second = np.max(np.delete(drift, most), initial=0.0)
    between = _exact(centroids, centroids)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = _below(between.min(axis=1)) / 2 if k > 1 else np.full(1, np.inf)
    upper = np.where(fresh, np.inf, (upper + drift[at]) * (1 + _SLACK))
    lower = np.where(fresh, 0.0, lower - np.where(at == most, second, drift[most]))
    lower = np.where(lower > 0, lower * (1 - _SLACK), 0.0) if k > 1 else np.full(len(x), np.inf)
    bound = np.maximum(lower, half[at])
    open_ = np.flatnonzero(~(upper < bound))
    near = open_[~fresh[open_]]
    upper[near] = _above(((x[near] - centroids[at[near]]) ** 2).sum(axis=1))
    scan = open_[~(upper[open_] < bound[open_])]
    if len(scan):
        d = _exact(x[scan], centroids)
        best = d.argmin(axis=1)  # the first of equals
        cluster[scan] = best
        upper[scan] = _above(d[np.arange(len(scan)), best])
        if k > 1:
            d[np.arange(len(scan)), best] = np.iinfo(np.int64).max
            lower[scan] = _below(d.min(axis=1))
    scanned = np.zeros(len(x), dtype=bool)
    scanned[scan] = True
    return cluster, upper, lower, scanned


def _assigned(centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, upper, lower = (batch[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, scanned = assign(_matrix(batch["x"], centroids.shape[1]), before, upper.copy(), lower.copy(), centroids, drift)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned)], ["vec_id", "x", "cluster", "before", "upper", "lower", "scanned"])

    return run


def _changes(clusters: int, dimensions: int):
    """For each task and cluster what the vectors that moved add to its count and sums; component -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dimensions + 1), dtype=np.int64)
        for batch in batches:
            x = np.pad(_matrix(batch["x"], dimensions), ((0, 0), (1, 0)), constant_values=1)
            for column, sign in (("cluster", 1), ("before", -1)):
                at = batch[column].to_numpy(zero_copy_only=False)
                np.add.at(total, at[at >= 0], sign * x[at >= 0])
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i - 1, pa.int32()), pa.array(total[k, i])], ["cluster", "component", "change"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch["x"], centroids.shape[1]), batch["cluster"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(((x - centroids[at]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return run


def fit(vectors: DataFrame, *, dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, history: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """The state after ``rounds`` updates and a last assignment, and the centroids of that.

    The state's rows are ``kept``'s, each with its ``cluster``. ``history`` gets, for each
    assignment, how many vectors there are and how many were compared with all centroids.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = stored(kept(vectors, dimensions, scale), folder, "vectors")
    first = seeds(rows, clusters, seed)
    centroids = np.array(first, dtype=np.int64).reshape(len(first), dimensions)
    state = rows.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(math.inf).alias("upper"), F.lit(0.0).alias("lower"), F.lit(False).alias("scanned"))
    if not first:
        return state, centroids
    drift, sums = np.zeros(len(first)), [[0] * (dimensions + 1) for _ in first]
    for n in range(rounds + 1):
        state = stored(state.mapInArrow(_assigned(centroids, drift), _STATE), folder, f"state-{n}")
        remove(spark, f"{folder}/state-{n - 1}" if n else f"{folder}/vectors")
        if history is not None:
            history.append(state.agg(F.count("*"), F.sum(F.col("scanned").cast("long"))).first())
        if n < rounds:
            moved = state.filter("cluster != before").select("x", "cluster", "before").mapInArrow(_changes(len(first), dimensions), "cluster int, component int, change long")
            for r in moved.groupBy("cluster", "component").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect():  # clusters x dimensions at most
                sums[r["cluster"]][r["component"] + 1] += int(r["change"])
            new = np.array([[s // t[0] for s in t[1:]] if t[0] else old for t, old in zip(sums, centroids.tolist(), strict=True)], dtype=np.int64)
            drift, centroids = moved_by(centroids, new), new
    return state, centroids


def cluster(vectors: DataFrame, **options) -> DataFrame:
    """Each kept vector's cluster, squared distance and its centroid's digest, with sums of the distances.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite; a null vector
    isn't. Null ids are kept, but seed a centroid only when too few others are there; repeated rows
    count each time, and vectors of one id are ordered by components as seeds. Ties go to the
    smaller number, empty clusters keep their centroid, and fewer vectors than clusters make fewer
    clusters. Scaled components of 2**27 or more raise an error, as their squares don't fit. An
    empty table gives no rows. Other columns are not read.
    """
    state, centroids = fit(vectors, **options)
    found = stored(state.select("vec_id", "x", "cluster").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), shared_folder(vectors.sparkSession), "distances")
    whole = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row a cluster
    digests = [(r["cluster"], int(r["inertia"]), sum(int(x["inertia"]) for x in whole), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in whole]
    about = vectors.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> str:
    """The query's rows in DuckDB SQL, every vector against every centroid in each round."""
    ctes = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e AS double)) AS bigint)) AS x FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v) ORDER BY c LIMIT {clusters})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"d{n} AS (SELECT v.r, v.vec_id, c.c, cast(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS bigint) AS distance FROM v, c{n} c)")
        ctes.append(f"a{n} AS (SELECT r, vec_id, c, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)")
        if n < rounds:
            ctes.append(f"s{n} AS (SELECT c, i, sum(e)::hugeint AS s, count(*)::hugeint AS m FROM (SELECT a.c, unnest(v.x) AS e, unnest(range({dimensions})) AS i FROM a{n} a JOIN v ON v.r = a.r) GROUP BY c, i)")
            ctes.append(f"n{n} AS (SELECT c, list(cast((s - ((s % m) + m) % m) // m AS bigint) ORDER BY i) AS x FROM s{n} GROUP BY c)")
            ctes.append(f"c{n + 1} AS (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{n} c LEFT JOIN n{n} n ON n.c = c.c)")
    return f"WITH {', '.join(ctes)} SELECT a.vec_id, cast(a.c AS integer) AS cluster, a.distance, cast(sum(a.distance) OVER (PARTITION BY a.c) AS bigint) AS cluster_inertia, cast(sum(a.distance) OVER () AS bigint) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"
