"""COLMAP sparse models, text and binary: cameras, images, points; and text sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.arrays import binary_files

CAMERAS = "id int, model string, width long, height long, params array<double>"
IMAGES = "id int, qvec array<double>, tvec array<double>, camera_id int, name string, xys array<struct<x: double, y: double>>, point3d_ids array<long>"
POINTS = "id long, xyz array<double>, rgb array<short>, error double, image_ids array<int>, point2d_idxs array<int>"

#: Camera models in the order of their numbers, with their parameter counts.
MODELS = (
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("trim(value) != '' AND value NOT LIKE '#%'").select(F.split(F.trim("value"), r"\s+").alias("w"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    w = lambda i: F.get("w", F.lit(i))
    return _lines(spark, path).select(w(0).cast("int").alias("id"), w(1).alias("model"), w(2).cast("long").alias("width"), w(3).cast("long").alias("height"), F.expr("transform(slice(w, 5, size(w)), x -> cast(x AS double))").alias("params"))


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Each image takes two lines, so a file is read as a whole; lines of observations can be empty."""
    files = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#")).alias("lines"))
    count = F.floor(F.size("lines") / 2).cast("int")
    pairs = files.filter(F.size("lines") >= 2).select(F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array(F.get("lines", 2 * i), F.coalesce(F.get("lines", 2 * i + 1), F.lit(""))))).alias("k", "p"))
    head, seen = F.split(F.trim(F.get("p", F.lit(0))), r"\s+"), F.filter(F.split(F.trim(F.get("p", F.lit(1))), r"\s+"), lambda x: x != "")
    rows = pairs.select(head.alias("h"), seen.alias("o")).filter("size(h) >= 10")
    number = lambda a, b: F.expr(f"transform(array({', '.join(f'h[{i}]' for i in range(a, b))}), x -> cast(x AS double))")
    xys = F.expr("transform(sequence(1, cast(size(o) / 3 AS int)), i -> struct(cast(o[3 * i - 3] AS double) AS x, cast(o[3 * i - 2] AS double) AS y))")
    ids = F.expr("transform(sequence(1, cast(size(o) / 3 AS int)), i -> cast(o[3 * i - 1] AS bigint))")
    some = F.size("o") >= 3
    name = F.array_join(F.expr("slice(h, 10, size(h))"), " ")
    empty = F.from_json(F.lit("[]"), "array<struct<x: double, y: double>>")
    return rows.select(F.expr("cast(h[0] AS int)").alias("id"), number(1, 5).alias("qvec"), number(5, 8).alias("tvec"), F.expr("cast(h[8] AS int)").alias("camera_id"), name.alias("name"), F.when(some, xys).otherwise(empty).alias("xys"), F.when(some, ids).otherwise(F.expr("cast(array() AS array<bigint>)")).alias("point3d_ids"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path)
    n = "cast((size(w) - 8) / 2 AS int)"
    track = lambda d: F.expr(f"CASE WHEN size(w) >= 10 THEN transform(sequence(0, {n} - 1), i -> cast(w[8 + 2 * i + {d}] AS int)) ELSE cast(array() AS array<int>) END")
    cast = lambda a, b, kind: F.expr(f"transform(array({', '.join(f'w[{i}]' for i in range(a, b))}), x -> cast(x AS {kind}))")
    return rows.select(F.expr("cast(w[0] AS bigint)").alias("id"), cast(1, 4, "double").alias("xyz"), cast(4, 7, "smallint").alias("rgb"), F.expr("cast(w[7] AS double)").alias("error"), track(0).alias("image_ids"), track(1).alias("point2d_idxs"))


class Cursor:
    """Little-endian records of a byte string, one after another."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        kind = struct.Struct("<" + form)
        out = kind.unpack_from(self.data, self.at)
        self.at += kind.size
        return out

    def name(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def _parsed(spark: SparkSession, path: str, pattern: str, one, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.replace("<", " <").split(", ") if not c.startswith("y:")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                cursor = Cursor(bytes(content))
                (n,) = cursor.take("Q")
                yield pd.DataFrame([one(cursor) for _ in range(n)], columns=columns)

    return binary_files(spark, path, pattern).select("content").mapInPandas(parse, schema)


def _camera(c: Cursor) -> tuple:
    number, model, width, height = c.take("iiQQ")
    name, n = MODELS[model]
    return number, name, width, height, list(c.take(f"{n}d"))


def _image(c: Cursor) -> tuple:
    number, *pose, camera = c.take("i7di")
    name = c.name()
    (n,) = c.take("Q")
    seen = c.take("ddq" * n)
    return number, pose[:4], pose[4:], camera, name, [{"x": x, "y": y} for x, y in zip(seen[::3], seen[1::3], strict=True)], list(seen[2::3])


def _point(c: Cursor) -> tuple:
    number, x, y, z, r, g, b, error = c.take("Q3d3Bd")
    (n,) = c.take("Q")
    track = c.take("ii" * n)
    return number, [x, y, z], [r, g, b], error, list(track[::2]), list(track[1::2])


def read_cameras_binary(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, "cameras*.bin", _camera, CAMERAS)


def read_images_binary(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, "images*.bin", _image, IMAGES)


def read_points_binary(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, "points3D*.bin", _point, POINTS)


def intrinsics(cameras: DataFrame) -> DataFrame:
    """(id, k): intrinsics of SIMPLE_PINHOLE, PINHOLE and SIMPLE_RADIAL cameras; null for others."""
    p = lambda i: F.get("params", F.lit(i))
    k = lambda fx, fy, cx, cy: F.array(fx, F.lit(0.0), cx, F.lit(0.0), fy, cy, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    one = k(p(0), p(0), p(1), p(2))
    return cameras.select("id", F.when(F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL"), one).when(F.col("model") == "PINHOLE", k(p(0), p(1), p(2), p(3))).alias("k"))


def extrinsics(images: DataFrame) -> DataFrame:
    """(id, name, camera_id, extrinsics): world-to-camera matrices."""
    from plumbline.functions import linalg as L
    from plumbline.functions import rotation as R

    return images.select("id", "name", "camera_id", L.se3_matrix(R.qvec_to_matrix("qvec"), "tvec").alias("extrinsics"))


def _joined(values, sep: str = " "):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def write_cameras_text(cameras: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "id", "model", "width", "height", _joined(F.col("params")))
    cameras.orderBy("id").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_images_text(images: DataFrame, path: str) -> None:
    """Two lines an image; without observations (an empty reconstruction) the second is empty."""
    head = F.concat_ws(" ", "id", _joined(F.col("qvec")), _joined(F.col("tvec")), "camera_id", "name")
    seen = F.array_join(F.zip_with("xys", "point3d_ids", lambda p, i: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), i.cast("string"))), " ") if "xys" in images.columns else F.lit("")
    images.orderBy("id").select(F.concat(head, F.lit("\n"), F.coalesce(seen, F.lit(""))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_points_text(points: DataFrame, path: str) -> None:
    track = F.array_join(F.zip_with("image_ids", "point2d_idxs", lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))), " ")
    line = F.concat_ws(" ", "id", _joined(F.col("xyz")), _joined(F.col("rgb")), "error", track)
    points.orderBy("id").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_empty_reconstruction(cameras: DataFrame, images: DataFrame, path: str) -> None:
    """Cameras and images without points."""
    write_cameras_text(cameras, f"{path}/cameras.txt")
    write_images_text(images.drop("xys", "point3d_ids"), f"{path}/images.txt")
