"""Near-copies of which one stays: candidates of SimHash and of least hashes, linked where word shingles are alike.

A bound of a few bits on 64-bit fingerprints misses most pairs at a similarity of 0.8, and a wider one
has no selective keys. So a text has further keys beside its SimHash component: BANDS keys of ROWS least
shingle hashes. Texts that share a key are candidates, and a candidate is a link only if the Jaccard
similarity of both shingle sets, computed from the texts, is high enough. A pair at 0.8 shares no key of
least hashes with a probability of (1 - 0.8**ROWS)**BANDS = 7e-5, a closer one with less.

First each text is compared with the least one of its key. In a key whose texts then lie in several
components, those outside its largest one are held against all of its texts, so that a least text
unlike the others hides none of them. Both are dealt into blocks of about BLOCK texts, and a pair of
blocks is a group of its own, so that no task holds the texts of a key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash_pigeonring
from plumbline.llm.common import WINDOW_BASES, hash_windows, hash_words, join_counted, mix, shared_folder, shuffle_partitions, stored, text_of, text_slices, word_spans
from plumbline.operators.graph import connected_components

SIMILARITY, SHINGLE = 0.8, 5
BANDS, ROWS = 24, 5
#: Texts of a block.
BLOCK = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_R = np.random.Generator(np.random.PCG64(20240611))
_FACTORS = _R.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _R.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_JOINS = _R.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its shingles, sorted; a text of fewer words is one shingle, one without words 0."""
    for _, _, data, limits in text_slices(column):
        data = _LOWER[data]
        starts, ends, first = word_spans(data, limits)
        words = hash_words(data, starts, ends)
        windows = hash_windows(words, shingle, WINDOW_BASES[0])
        for a, b in itertools.pairwise(first):
            if a == b:
                yield np.zeros(1, dtype=np.uint64)
            elif b - a < shingle:
                yield hash_windows(words[a:b], int(b - a), WINDOW_BASES[0])
            else:
                yield np.unique(windows[a : b - shingle + 1])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, (shingles[a : a + (1 << 12)] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    bands = (mix(least).reshape(BANDS, ROWS) * _JOINS).sum(axis=1, dtype=np.uint64)
    return mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _keys(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(s) for s in shingle_sets(batch["_text"], shingle)]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(keys, pa.list_(pa.int64()))], ["h", "keys"])

    return run


def _alike(similarity: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(shingle_sets(batch["_text"], shingle), shingle_sets(batch["_other"], shingle), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["h"], batch["rep"]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def search_key(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], queries: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the texts at ``queries`` and all others that join alike ones which aren't in one component yet."""
    sizes = np.array([len(s) for s in sets])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    names, cells = np.unique(np.concatenate(sets), return_inverse=True)
    roots, found = roots.copy(), []
    for i in np.flatnonzero(queries):
        if (roots == roots[i]).all():
            continue
        mark = np.zeros(len(names), dtype=np.int64)
        mark[cells[starts[i] : starts[i] + sizes[i]]] = 1
        both = np.add.reduceat(mark[cells], starts)
        alike = both >= similarity * (sizes[i] + sizes - both) - 1e-9
        for j in np.flatnonzero(alike):
            if roots[j] != roots[i]:
                found.append((int(ids[j]), int(ids[i])))
                roots[roots == roots[j]] = roots[i]
    return found


def _search(similarity: float, shingle: int):
    def edges(held: list[tuple]) -> pa.RecordBatch:
        ids, roots, queries, sets = zip(*held, strict=True)
        found = search_key(np.array(ids), np.array(roots), list(sets), np.array(queries), similarity)
        return pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("key", "i", "j", "h", "root", "query"))
            for *at, h, root, query, shingles in zip(*columns, shingle_sets(batch["_text"], shingle), strict=True):
                if at != pair and held:
                    yield edges(held)
                    held = []
                pair = at
                held.append((h, root, query, shingles))
        if held:
            yield edges(held)

    return run


def block_pairs(rooted: DataFrame, block: int) -> DataFrame:
    """``rooted(key, h, root)`` of keys with several roots to (key, i, j, h, root, query): queries, outside the key's largest root, in block i meet all texts in block j."""
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = F.max(F.struct("size", "root"))
    keys = parts.groupBy("key").agg(F.count("*").alias("roots"), F.sum("size").alias("n"), largest.alias("l")).filter("roots > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    keys = keys.select("key", "n", F.col("l.root").alias("main"), blocks(F.col("n") - F.col("l.size")).alias("ni"), blocks(F.col("n")).alias("nj"))
    held = join_counted(rooted, stored(keys, shared_folder(rooted.sparkSession), "keys"), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    texts = held.select("key", every(F.col("ni")).alias("i"), F.pmod(F.xxhash64("h"), F.col("nj")).cast("int").alias("j"), "h", "root", F.lit(False).alias("query"))
    queries = held.filter("root != main").select("key", F.pmod(F.xxhash64("h", F.lit(1)), F.col("ni")).cast("int").alias("i"), every(F.col("nj")).alias("j"), "h", "root", F.lit(True).alias("query"))
    return texts.unionByName(queries)


def components(docs: DataFrame, own: DataFrame, *, text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of text hashes that alike shingles connect; ``own(text_hash, group)`` has SimHash groups."""
    folder = shared_folder(docs.sparkSession)
    texts = docs.select(text_of(docs, text).alias("_text")).select(F.xxhash64("_text").alias("h"), "_text")
    keys = stored(texts.mapInArrow(_keys(shingle), "h long, keys array<long>").dropDuplicates(["h"]), folder, "keys")
    of_simhash = own.select(F.col("text_hash").alias("h"), F.xxhash64("group", F.lit("simhash")).alias("key")).distinct()
    keyed = keys.select("h", F.explode("keys").alias("key")).unionByName(of_simhash)
    several = keyed.groupBy("key").agg(F.min("h").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = stored(keyed.join(several, "key").select("key", "h", "rep"), folder, "members")
    pairs = stored(members.filter("h != rep").select("h", "rep").distinct(), folder, "pairs")
    needed = pairs.select("h").unionByName(pairs.select(F.col("rep").alias("h"))).distinct()
    texts = stored(texts.join(needed, "h", "left_semi").dropDuplicates(["h"]), folder, "texts")
    others = texts.select(F.col("h").alias("rep"), F.col("_text").alias("_other"))
    alike = pairs.join(texts, "h").join(others, "rep").select("h", "rep", "_text", "_other").mapInArrow(_alike(similarity, shingle), "a long, b long")
    first = stored(connected_components(alike, folder), folder, "first")
    rooted = members.join(first.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    pairs = stored(block_pairs(rooted, BLOCK), folder, "pairs-of-blocks")
    rest = pairs.join(texts, "h").select("key", "i", "j", "h", "root", "query", "_text")
    n = shuffle_partitions(docs.sparkSession)
    found = rest.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_search(similarity, shingle), "a long, b long")
    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
    return connected_components(edges, f"{folder}/again")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, as ``simhash_pigeonring.keep_one`` chooses it."""
    folder = shared_folder(docs.sparkSession)
    own = stored(simhash_pigeonring.grouped(docs, id_column=id_column, text=text, shingle=shingle), folder, "own")
    roots = components(docs, own, text=text, similarity=similarity, shingle=shingle).withColumnRenamed("node", "text_hash")
    own = own.drop("group").join(roots, "text_hash", "left").withColumn("group", F.coalesce("root", "text_hash"))
    return simhash_pigeonring.chosen_rows(docs, own, id_column=id_column, text=text)
