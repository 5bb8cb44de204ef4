"""NPZ bundles: one row an array, or exploded to pixels; and a sink."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "path string, key string, dtype string, shape array<long>, data array<double>"


def binary_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files (path, content, length) whose name fits a glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def list_files(spark: SparkSession, path: str, extensions: Sequence[str], recursive: bool = False) -> DataFrame:
    """Paths with one of the extensions, in order."""
    pattern = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}" if len(extensions) > 1 else "*." + extensions[0].lstrip(".")
    return binary_files(spark, path, pattern, recursive).select("path", "length").orderBy("path")


def read_npz(spark: SparkSession, path: str, keys: Sequence[str] | None = None, aliases: dict[str, str] | None = None, pattern: str = "*.npz") -> DataFrame:
    """A row for each numeric array: path, key, dtype, shape and its values in row-major order. ``aliases`` renames keys."""
    wanted, renamed = set(keys) if keys else None, aliases or {}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as bundle:
                    found = {renamed.get(k, k): k for k in bundle.files}
                    rows = [(name, k, bundle[own]) for k, own in found.items() if wanted is None or k in wanted]
                rows = [(n, k, a) for n, k, a in rows if a.dtype.kind in "biuf"]
                yield pd.DataFrame({"path": [n for n, _, _ in rows], "key": [k for _, k, _ in rows], "dtype": [str(a.dtype) for *_, a in rows], "shape": [list(a.shape) for *_, a in rows], "data": [a.astype(np.float64).ravel() for *_, a in rows]})

    return binary_files(spark, path, pattern).select("path", "content").mapInPandas(parse, ARRAYS)


def exploded(arrays: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """A row for each element, its place along each axis named."""
    rows = arrays.select("path", "key", "shape", F.posexplode("data").alias("_i", value))
    rest: Column = F.col("_i").cast("long")
    places = {}
    for axis in range(len(names) - 1, -1, -1):
        size = F.get("shape", F.lit(axis))
        places[names[axis]] = (rest % size).cast("long")
        rest = F.floor(rest / size)
    return rows.select("path", "key", *(places[n].alias(n) for n in names), value)


def write_npz(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """One bundle, of arrays that fit the driver, written through Hadoop's file system."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    write_bytes(spark, path, out.getvalue())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def camera_bundle(arrays: DataFrame) -> DataFrame:
    """Frames (path, t, c2w, k, scale) of bundles with cam_c2w (N, 4, 4), intrinsic (3, 3) and optional scale."""
    c2w = arrays.filter("key = 'cam_c2w'").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.get("shape", F.lit(0)) - 1)).alias("t"), "data")
    c2w = c2w.select("path", "t", F.slice("data", (F.col("t") * 16 + 1).cast("int"), F.lit(16)).alias("c2w"))
    k = arrays.filter("key = 'intrinsic'").select("path", F.col("data").alias("k"))
    scale = arrays.filter("key = 'scale'").select("path", F.get("data", F.lit(0)).alias("scale"))
    return c2w.join(k, "path", "left").join(scale, "path", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
