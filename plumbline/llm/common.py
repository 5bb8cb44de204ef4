"""Helpers that the training-data operators share.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. All hashing of words and word windows is
vectorised over the bytes of an Arrow buffer: a polynomial over random byte values gives a
word's 64-bit hash, a polynomial over word hashes that of a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import shared_folder, stored

#: The six separators between words.
SPACES = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Two independent hashes of words: values of bytes and a base for each.
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, (2, 256), dtype=np.uint64)
_WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BLOCK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n; the base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_spans(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words of several texts that lie one after another.

    data: bytes of all texts. limits: len(texts) + 1 offsets. Returns starts, ends and, for each
    text, the index of its first word (len(texts) + 1 entries).
    """
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = limits[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, limits)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, one of two independent ones, a block of bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(_WORD_BASES[which], b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[which][data[a:b]] * up[: b - a], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mix(out)


def hash_windows(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; the caller masks those over a text's end."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        part = words[a : b + k - 1]
        up, down = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[a:b] = (total[k:] - total[:-k]) * down[: b - a]
    return mix(out)


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column with at most so many bytes (one row at least).

    Yields first row, end row, the bytes and the offsets in them. A null is an empty text.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        wide = pa.types.is_large_string(chunk.type)
        _, offsets, values = chunk.buffers()
        n = len(chunk)
        if n == 0:
            continue
        at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            j = min(j, n)
            yield base + i, base + j, data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        base += n


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a DataFrame's size; it only sets partition counts."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, each: int, least: int = 1) -> int:
    """As many partitions as the estimated bytes ask for at ``each`` bytes a partition."""
    size = input_bytes(df)
    return max(least, min(2**20, math.ceil(size / each))) if size < 2**60 else max(least, shuffle_partitions(df.sparkSession))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: A key is hot if more than one in so many rows has it; there are as many hot keys at most.
HOT = 1024


def join_counted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a stored ``table`` that has each key once, and in ``n`` its number of rows.

    Rows of hot keys never meet in a task: the table's rows of those, HOT at most, are broadcast.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    hot = table.filter(F.col("n") * HOT > total).drop("n")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col("n") * HOT <= total).drop("n").hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns by their names as they are, dots included."""
    return [F.col(f"`{c}`") for c in df.columns]


def plainly_named(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: Python functions can't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def text_of(df: DataFrame, column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


__all__ = ["free_name", "own_columns", "plainly_named", "shared_folder", "stored"]
