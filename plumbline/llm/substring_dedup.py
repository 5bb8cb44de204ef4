"""Substring deduplication by difference-cover anchors.

A window is ``length`` consecutive words of one text. Any two equal windows, wherever they start,
share an offset below the period at which both lie on a position of a difference cover modulo the
period. So it is enough to hash short windows (anchors) at cover positions only: equal windows hold
an equal, equally placed anchor. Anchors that occur twice mark where matches can be; from there
the candidates extend to full windows, which are compared by two independent 64-bit hashes of words
and windows.

Data flow: texts are dealt into buckets of bounded size, once. A bucket sends each of its distinct
anchor hashes to a shard of the hash space, packed with others; a shard, having seen all buckets,
answers each with a bit for each hash: whether it also occurs elsewhere. The same exchange settles
candidate windows. A hash thus travels once for each bucket, however often it occurs, and the
answer takes a bit, so a passage that a third of all texts share weighs no more than another.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WINDOW_BASES, hash_windows, hash_words, input_bytes, plainly_named, shuffle_partitions, text_of, text_slices, word_spans

#: Words of a window.
LENGTH = 35
#: A perfect difference set: every residue modulo the period is a difference of two of them.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

_PACKED = "shard int, bucket int, hashes binary, twice binary"
_ANSWER = "bucket int, stage int, shard int, bits binary"


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class Plan:
    """Window length, cover and shard count, and what follows from them."""

    def __init__(self, length: int, period: int, cover: tuple[int, ...], shards: int) -> None:
        if not covers(period, cover) or period > length:
            raise ValueError("not a difference cover of a period up to the window's length")
        self.length, self.period, self.shards = length, period, shards
        self.anchor = length - period + 1
        self.on = np.zeros(period, dtype=bool)
        self.on[list(cover)] = True

    def words(self, data: np.ndarray, limits: np.ndarray):
        """Word spans and hashes of a slice, and of each word its place in its text and the words from it on."""
        starts, ends, first = word_spans(data, limits)
        n = np.diff(first)
        at = np.arange(len(starts), dtype=np.int32) - np.repeat(first[:-1], n).astype(np.int32)
        return starts, ends, first, hash_words(data, starts, ends), at, np.repeat(n, n).astype(np.int32) - at

    def anchors(self, h: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors start, and their hashes; none in a text that is shorter than a window."""
        where = np.flatnonzero(self.on[at % self.period] & (left >= self.anchor) & (at + left >= self.length))
        return where, hash_windows(h, self.anchor, WINDOW_BASES[0])[where]

    def candidates(self, where: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Windows that hold one of the anchors at ``where`` at an offset below the period."""
        step = np.zeros(len(left) + 1, dtype=np.int32)
        np.add.at(step, where - np.minimum(self.period - 1, at[where]), 1)
        np.add.at(step, where + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (left >= self.length))

    def windows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Two hashes of each window, a row of two numbers; the second one is over other hashes of the words."""
        if not len(where):
            return np.empty((0, 2), np.uint64)
        pair = zip((h, hash_words(data, starts, ends, 1)), WINDOW_BASES, strict=True)
        return np.stack([hash_windows(words, self.length, base)[where] for words, base in pair], axis=1)

    def shard_of(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(33)).astype(np.int64) % self.shards


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of one or two hashes: their order, the group of each row, and each group's size."""
    order = np.argsort(rows[:, 0], kind="stable") if rows.shape[1] == 1 else np.lexsort((rows[:, 1], rows[:, 0]))
    ordered = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    group = np.empty(len(rows), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    return ordered[firsts], group, np.diff(np.append(firsts, len(rows)))


def _packed(plan: Plan, bucket: int, rows: np.ndarray) -> pa.Table:
    """A row for each shard: distinct hashes in order, and a bit for each that occurs twice in the bucket."""
    found, _, size = _distinct(rows)
    shard = plan.shard_of(found[:, 0])
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(plan.shards + 1))
    out = [(s, order[cuts[s] : cuts[s + 1]]) for s in np.flatnonzero(np.diff(cuts))]
    return pa.table(
        {
            "shard": pa.array([s for s, _ in out], pa.int32()),
            "bucket": pa.array([bucket] * len(out), pa.int32()),
            "hashes": pa.array([found[x].tobytes() for _, x in out], pa.binary()),
            "twice": pa.array([np.packbits(size[x] > 1).tobytes() for _, x in out], pa.binary()),
        }
    )


def _bits(value: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value, np.uint8), count=n).astype(bool)


def _answers(width: int, stage: int):
    """A shard's answers: which hashes of each bucket occur in another one too, or twice in one."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, width) for x in table["hashes"]]
        twice = np.concatenate([_bits(x.as_py(), len(p)) for x, p in zip(table["twice"], parts, strict=True)])
        rows = np.concatenate(parts)
        _, group, size = _distinct(rows)
        many = size > 1
        many[group[twice]] = True
        cuts = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(many[group[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"bucket": table["bucket"], "stage": pa.array([stage] * len(bits), pa.int32()), "shard": table["shard"], "bits": pa.array(bits, pa.binary())})

    return run


def _marked(plan: Plan, rows: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """Which of a bucket's hashes, in the order in which they were found, occur elsewhere too."""
    found, group, _ = _distinct(rows)
    shard = plan.shard_of(found[:, 0])
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(plan.shards + 1))
    many = np.zeros(len(found), dtype=bool)
    for s in np.flatnonzero(np.diff(cuts)):
        many[order[cuts[s] : cuts[s + 1]]] = _bits(answers[int(s)], cuts[s + 1] - cuts[s])
    return many[group]


def _by_stage(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
    for stage, shard, bits in zip(*(table[c].to_pylist() for c in ("stage", "shard", "bits")), strict=True):
        out[stage][shard] = bits
    return out


class Bucket:
    """The texts of a bucket, gone through slice by slice in the same order at each stage."""

    def __init__(self, plan: Plan, texts: pa.ChunkedArray) -> None:
        self.plan, self.texts = plan, texts

    def slices(self):
        for i, j, data, limits in text_slices(self.texts):
            yield i, j, data, self.plan.words(data, limits)

    def anchors(self) -> np.ndarray:
        parts = [self.plan.anchors(h, at, left)[1] for *_, (_, _, _, h, at, left) in self.slices()]
        return np.concatenate([*parts, np.empty(0, np.uint64)])[:, None]

    def candidates(self, answers: dict[int, bytes]):
        """Each slice with its candidate windows."""
        marks, done = _marked(self.plan, self.anchors(), answers), 0
        for i, j, data, (starts, ends, first, h, at, left) in self.slices():
            where, _ = self.plan.anchors(h, at, left)
            own = where[marks[done : done + len(where)]]
            done += len(where)
            yield i, j, data, (starts, ends, first, h), self.plan.candidates(own, left, at)

    def windows(self, answers: dict[int, bytes]) -> np.ndarray:
        parts = [self.plan.windows(data, starts, ends, h, where) for _, _, data, (starts, ends, _, h), where in self.candidates(answers)]
        return np.concatenate([*parts, np.empty((0, 2), np.uint64)])

    def removed(self, answers: dict[int, dict[int, bytes]]):
        """For each text: row, bytes, word starts and ends in them, and which words a repeated window covers.

        Only the windows' hashes are held for the whole bucket; slices are gone through once more.
        """
        marks = _marked(self.plan, self.windows(answers[0]), answers[1])
        done = 0
        for i, j, data, (starts, ends, first, _), where in self.candidates(answers[0]):
            own = where[marks[done : done + len(where)]]
            done += len(where)
            step = np.zeros(len(starts) + self.plan.length + 1, dtype=np.int32)
            np.add.at(step, own, 1)
            np.add.at(step, own + self.plan.length, -1)
            gone = np.cumsum(step)[: len(starts)] > 0
            for row in range(i, j):
                a, b = first[row - i], first[row - i + 1]
                yield row, data, starts[a:b], ends[a:b], gone[a:b]


def digest_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """SHA-256 of the kept words, joined by one space."""
    if not len(starts):
        return hashlib.sha256(b"").hexdigest()
    words = data[starts[0] : ends[-1]].tobytes().split()
    return hashlib.sha256(b" ".join(compress(words, ~gone) if gone.any() else words)).hexdigest()


def kept_text(text: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """The text without the removed words and the white space after them."""
    if not gone.any():
        return text
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], int(starts[0])
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(data[at : starts[a]].tobytes())
        at = int(starts[b]) if b < len(starts) else int(ends[-1])
    out.append(data[at : ends[-1]].tobytes())
    return b"".join(out).decode().rstrip(" \t\n\x0b\x0c\r")


def bucket_count(docs: DataFrame) -> int:
    """Buckets of about 1 MB of stored text, 16 MB at most, growing with the square root of the input.

    Buckets times shards are rows of the exchange, so both must not grow with the input.
    """
    size, least = input_bytes(docs), shuffle_partitions(docs.sparkSession)
    if size >= 2**60:  # the plan's size is unknown
        return 8 * least
    each = min(16.0, max(1.0, math.sqrt(size / 2**30))) * 2**20
    return int(min(2**24, max(least, math.ceil(size / each))))


def shard_count(docs: DataFrame) -> int:
    """Shards of the hash space, one for 64 MB of stored text at least, so that none grows with the input."""
    size, least = input_bytes(docs), shuffle_partitions(docs.sparkSession)
    return least if size >= 2**60 else int(min(2**20, max(least, math.ceil(size / 2**26))))


def remove_repeated(docs: DataFrame, *, text: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, digest: bool = False) -> DataFrame:
    """Removes each word covered by a ``length``-word window whose word sequence starts anywhere else too.

    Windows are judged on the input. Returns the columns of ``docs`` with n_words, n_removed and
    either the text without the removed words or, with ``digest``, the SHA-256 of the kept words in
    place of it (kept_sha256). A text from which nothing goes stays as it is.

    A null text has no words and stays null. Texts of fewer words than a window stay. A text of any
    length is gone through in slices. A row that is repeated repeats its windows. Null ids, empty
    tables and further columns pass through; those named like an added one are replaced. Equality of
    two independent 64-bit hashes counts as equality.
    """
    at = docs.columns.index(text)
    new = ["n_words", "n_removed", *["kept_sha256"] * digest]
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if i != at and c.lower() not in new]
    found = _removed(docs, text, Plan(length, period, cover, shard_count(docs)), digest)
    return found.select(*kept, "n_words", "n_removed", F.col("value").alias("kept_sha256" if digest else text))


def without_repeated(docs: DataFrame, *, text: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """``docs`` in its own columns, whatever their names, its texts without the words that ``remove_repeated`` removes."""
    at = docs.columns.index(text)
    found = _removed(docs, text, Plan(length, period, cover, shard_count(docs)), False)
    return found.select(*(F.col("value" if i == at else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _removed(docs: DataFrame, text: str, plan: Plan, digest: bool) -> DataFrame:
    """Columns c0, c1, ... of ``docs`` but the text, n_words, n_removed and value."""
    n, parts = bucket_count(docs), shuffle_partitions(docs.sparkSession)
    inner = plainly_named(docs)
    at = docs.columns.index(text)
    others = [c for i, c in enumerate(inner.columns) if i != at]
    # equal rows are dealt apart by where they were read, which a task that runs again finds again
    rows = inner.select(*others, F.col(f"c{at}").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), "row"), F.lit(n)).cast("int")).drop("row")
    # the same exchange serves all three stages
    dealt = dealt.repartition(max(parts, min(n, plan.shards)), "bucket")

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _packed(plan, key[0].as_py(), Bucket(plan, table["text"]).anchors())

    def windows(key: tuple[pa.Scalar, ...], answers: pa.Table, table: pa.Table) -> pa.Table:
        return _packed(plan, key[0].as_py(), Bucket(plan, table["text"]).windows(_by_stage(answers)[0]))

    def removed(key: tuple[pa.Scalar, ...], answers: pa.Table, table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        column = table["text"].combine_chunks()
        for row, data, starts, ends, gone in Bucket(plan, table["text"]).removed(_by_stage(answers)):
            value = digest_of(data, starts, ends, gone) if digest else kept_text(column[row].as_py(), data, starts, ends, gone)
            rows.append((len(starts), int(gone.sum()), value))
        n_words, n_removed, values = zip(*rows, strict=True) if rows else ((), (), ())
        columns = {c: table[c] for c in others} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "value": pa.array(values, pa.string())}
        return pa.table(columns)

    first = dealt.groupBy("bucket").applyInArrow(anchors, _PACKED).groupBy("shard").applyInArrow(_answers(1, 0), _ANSWER)
    both = lambda answers, f, schema: answers.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(f, schema)
    second = both(first, windows, _PACKED).groupBy("shard").applyInArrow(_answers(2, 1), _ANSWER)
    schema = T.StructType([*inner.select(*others).schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, value string").fields])
    return both(first.unionByName(second), removed, schema)


def oracle_sql(length: int = LENGTH) -> str:
    """The query's rows in DuckDB SQL: every window by its words, and what repeated ones cover."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    g AS (SELECT r, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d WHERE len(w) >= {length}),
    h AS (SELECT r, i, md5(array_to_string(w[i : i + {length - 1}], ' ')) AS k FROM g),
    twice AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + {length})) AS p FROM twice),
    each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS words FROM each ANTI JOIN gone USING (r, p) GROUP BY r),
    lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
    SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""
