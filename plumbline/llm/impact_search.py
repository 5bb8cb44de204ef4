"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Rows are packed into index blocks of bounded size. In a block, a posting is a component of a
vector; its quantised impact is the level of its magnitude, each level half as large as the one
before, and a segment holds the postings of a level, by dimension. A query block is scored against
an index block segment by segment in descending impact. After a segment, what is left of a score is
bounded by the norms of the query and of the row's components still to come (Cauchy-Schwarz). A
query stops only when that, held against its k best scores so far in this and earlier blocks,
proves which few rows can still be among them; those are rescored exactly.

A query set that is a fixed part of all rows against all rows is quadratic, so blocks meet in
pairs. An index block is read once, query blocks are read beside it, and only k rows a query leave
a pair: neither is shuffled for it.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import partitions_for, shared_folder, stored

#: Impact levels, rows of an index block, and queries of a query block.
LEVELS, ROWS, QUERIES = 6, 8192, 2048
SCALE = 64

_HITS = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding)`` with components floor(scale * x); those that can't be scored are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros, which adds nothing to a score."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    d = int(lengths.max(initial=0))
    if (lengths == d).all():
        return values.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), dtype=np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = values
    return out


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def build_index(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> dict[str, np.ndarray]:
    """Segments in descending impact: for each level postings by dimension; vectors in order of their row numbers.

    rest[l] holds the norms of what segments after the first l still add to a vector.
    """
    order = np.argsort(rows, kind="stable")
    rows, ids, x = rows[order], ids[order], x[order]
    size = np.abs(x)
    top = int(size.max(initial=0))
    level = np.zeros(x.shape, dtype=np.int8)
    for s in range(1, levels):
        level += size <= top >> s
    if top < 2**31:
        x = x.astype(np.int32)
    out = {"rows": rows, "ids": ids, "x": x}
    rest = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))]
    for s in range(levels):
        dimension, row = np.nonzero((level == s).T & (x != 0).T)
        out |= {f"start{s}": np.searchsorted(dimension, np.arange(x.shape[1] + 1)), f"row{s}": row.astype(np.int32), f"impact{s}": x[row, dimension]}
        rest.append(np.sqrt((np.where(level > s, x, 0).astype(np.float64) ** 2).sum(axis=1)))
    return out | {"rest": np.stack(rest)}


def segment(index: dict[str, np.ndarray], s: int, kind: type) -> np.ndarray:
    """A segment's postings spread over a (dimensions, vectors) tile."""
    tile = np.zeros((index["x"].shape[1], len(index["ids"])), dtype=kind)
    dimension = np.repeat(np.arange(tile.shape[0]), np.diff(index[f"start{s}"]))
    tile[dimension, index[f"row{s}"]] = index[f"impact{s}"]
    return tile


def widened(index: dict[str, np.ndarray], queries: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Index and queries with as many dimensions each."""
    x = index["x"]
    d = max(x.shape[1], queries.shape[1])
    if x.shape[1] < d or queries.shape[1] < d:
        x, queries = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, queries))
        index = index | {"x": x} | {f"start{s}": np.pad(index[f"start{s}"], (0, d + 1 - len(index[f"start{s}"])), mode="edge") for s in range(len(index["rest"]) - 1)}
    return index, queries


def search(index: dict[str, np.ndarray], query_rows: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None, counter: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and scores of those of its k best vectors that the block can add, best first.

    floor: for each query a score that k vectors of earlier blocks reach, raised here in place;
    vectors below it are left out. A query's own row is no candidate. counter: postings in all, and
    those that queries did not process, are added to ``all`` and ``skipped``.
    """
    index, queries = widened(index, queries)
    rows, ids, x, rest = index["rows"], index["ids"], index["x"], index["rest"]
    levels = len(rest) - 1
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    most = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * x.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # sums are exact
    place = np.minimum(np.searchsorted(rows, query_rows), max(0, len(rows) - 1))
    own = np.where(rows[place] == query_rows, place, -1) if len(rows) else np.full(len(queries), -1)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    postings = np.array([len(index[f"row{s}"]) for s in range(levels)])
    active = np.arange(len(queries))
    total = np.zeros((len(active), len(ids)), dtype=kind)
    few = max(4 * k, len(ids) // 8)
    for s in range(levels):
        total += queries[active].astype(kind) @ segment(index, s, kind)
        done = np.ones(len(active), dtype=bool)
        for n, q in enumerate(active):
            mine = int(own[q])
            if s == levels - 1:  # every segment is in: the totals are the scores
                scores = total[n].astype(np.int64)
                able = np.ones(len(ids), dtype=bool)
                if mine >= 0:
                    able[mine] = False
                able = np.flatnonzero(able & (scores >= floor[q]))
                exact = scores[able]
            else:
                bound = norm[q] * rest[s + 1] + 1
                low, high = total[n] - bound, total[n] + bound
                if mine >= 0:
                    low[mine] = high[mine] = -np.inf
                least = max(floor[q], np.partition(low, -k)[-k] if len(ids) > k else -np.inf)
                able = np.flatnonzero((high >= least) & (high > -np.inf))
                if len(able) > few:
                    done[n] = False
                    continue
                exact = x[able].astype(np.int64) @ queries[q]
            if counter is not None:
                counter["all"] = counter.get("all", 0) + int(postings.sum())
                counter["skipped"] = counter.get("skipped", 0) + int(postings[s + 1 :].sum())
            if len(able) > k:
                best = exact >= np.partition(exact, -k)[-k]
                able, exact = able[best], exact[best]
            best = np.lexsort((ids[able], -exact))[:k]
            if len(best) == k:
                floor[q] = max(floor[q], exact[best[-1]])
            yield int(q), ids[able][best], exact[best]
        active, total = active[~done], total[~done]
        if not len(active):
            return


def _blocks(rows: int, index: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block_of(n: int) -> pa.RecordBatch:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            numbers, ids, x = table["row"][:n].to_numpy(), table["vec_id"][:n].to_numpy(), matrix_of(table["x"][:n].combine_chunks())
            held = table[n:].to_batches()
            data = packed(**build_index(numbers, ids, x)) if index else packed(rows=numbers, ids=ids, x=x)
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                yield block_of(rows)
        if n := sum(b.num_rows for b in held):
            yield block_of(n)

    return run


def _search_pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, floors = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["index_block"][i].as_py() != at:
                    at, index = batch["index_block"][i].as_py(), unpacked(batch["index_data"][i].as_py())
                query = unpacked(batch["query_data"][i].as_py())
                floor = floors.setdefault(batch["query_block"][i].as_py(), np.full(len(query["ids"]), -np.inf))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for q, ids, scores in search(index, query["rows"], query["x"], k, floor):
                    for column, value in zip(out, (np.full(len(ids), query["rows"][q]), np.full(len(ids), query["ids"][q]), ids, scores), strict=True):
                        column.append(value)
                columns = [pa.array(np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64)) for v in out]
                yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 20, *, every: int = 20, scale: int = SCALE) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but the query's
    own, among them other rows of the same vec_id. Ties go to the smaller vec_id. A null vec_id or
    vector, and one with a null or non-finite component, takes no part; an empty vector scores 0,
    and a shorter one counts as filled with zeros. A repeated row is a candidate each time, and a
    repeated query has its k rows each time. Very long vectors only make blocks larger. Scores must
    fit 64 bits. An empty table gives no rows. Other columns of ``vectors`` are not read.
    """
    folder = shared_folder(vectors.sparkSession)
    rows = stored(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()), folder, "rows")
    n = partitions_for(vectors, 2 << 20)

    def blocks(part: DataFrame, tasks: int, most: int, index: bool, name: str) -> DataFrame:
        found = part.repartition(tasks).mapInArrow(_blocks(most, index), "data binary")
        return stored(found.select(F.monotonically_increasing_id().alias(f"{name}_block"), F.col("data").alias(f"{name}_data")), folder, name)

    index = blocks(rows, n, ROWS, True, "index")
    queries = blocks(rows.filter(F.col("vec_id") % every == 0), math.ceil(n / every), QUERIES, False, "query")
    hits = index.repartition(n).crossJoin(queries).mapInArrow(_search_pairs(k), _HITS)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 20, every: int = 20, scale: int = SCALE) -> str:
    """The query's rows in DuckDB SQL, by brute force."""
    return f"""
    WITH rows AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: cast(floor({scale} * cast(v AS double)) AS bigint)) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    scores AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS bigint) AS score
        FROM rows q JOIN rows c ON q.vec_id % {every} = 0 AND c.r != q.r)
    SELECT query_id, cast(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id, score FROM scores QUALIFY rank <= {k}"""
