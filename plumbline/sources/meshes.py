"""OBJ and PLY meshes and clouds, URDF export, MJCF geometry."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.mesh import concatenated, triangulate
from plumbline.sources.arrays import binary_files, write_bytes

#: Keywords that an OBJ file can hold.
KEYWORDS = ("v", "vt", "vn", "vp", "f", "o", "g", "s", "l", "usemtl", "mtllib")


def read_obj(spark: SparkSession, path: str, ignore_unknown: bool = False) -> DataFrame:
    """Statements of OBJ files: part (file), n (place among those of its keyword), keyword, words.

    An unknown keyword fails the read unless it is ignored.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("part"), F.split("value", r"\r?\n").alias("lines"))
    lines = files.select("part", F.posexplode("lines").alias("line", "value"))
    words = lines.select("part", "line", F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+").alias("w")).filter("w[0] != ''")
    known = F.get("w", F.lit(0)).isin(*KEYWORDS)
    words = words.filter(known) if ignore_unknown else words.filter(F.coalesce(F.assert_true(known, F.concat(F.lit("unknown keyword in OBJ: "), F.get("w", F.lit(0)))).isNull(), F.lit(True)))
    kept = words.select("part", "line", F.get("w", F.lit(0)).alias("keyword"), F.expr("slice(w, 2, size(w))").alias("words"))
    return kept.withColumn("n", F.row_number().over(W.partitionBy("part", "keyword").orderBy("line")) - 1)


def obj_mesh(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (part, vid, x, y, z) and triangles (part, fid, v0, v1, v2); polygons become fans, negative indices count from the end."""
    number = lambda i: F.get("words", F.lit(i)).cast("double")
    vertices = statements.filter("keyword = 'v'").select("part", F.col("n").cast("long").alias("vid"), *(number(i).alias(c) for i, c in enumerate("xyz")))
    before = statements.withColumn("_v", F.sum(F.when(F.col("keyword") == "v", 1).otherwise(0)).over(W.partitionBy("part").orderBy("line"))).filter("keyword = 'f'")
    index = F.transform("words", lambda w: F.split_part(w, F.lit("/"), F.lit(1)).cast("long"))
    polygons = before.select("part", F.col("n").alias("fid"), F.transform(index, lambda i: F.when(i > 0, i - 1).otherwise(F.col("_v") + i)).alias("vs"))
    fans = triangulate(polygons.withColumn("fid", F.struct("part", "fid")))
    order = W.partitionBy("fid.part").orderBy("fid.fid", "part")
    return vertices, fans.select(F.col("fid.part").alias("part"), (F.row_number().over(order) - 1).cast("long").alias("fid"), *(F.col(f"v{i}").cast("long").alias(f"v{i}") for i in range(3)))


def read_scene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All ``part_*.obj`` of a folder in one mesh, parts in order of their names."""
    return concatenated(*obj_mesh(read_obj(spark, f"{path}/part_*.obj", ignore_unknown=True)))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, colors: bool = False) -> None:
    """One OBJ file (1-based faces) in a folder; with r, g, b of vertices if asked for."""
    fields = ["x", "y", "z", *(["r", "g", "b"] if colors else [])]
    v = vertices.select(F.lit(0).alias("k"), F.col("vid").alias("i"), F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in fields)).alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("fid").alias("i"), F.concat_ws(" ", F.lit("f"), *((F.col(f"v{i}") + 1).cast("string") for i in range(3))).alias("value"))
    v.unionByName(f).orderBy("k", "i").select("value").coalesce(1).write.mode("overwrite").text(path)


#: PLY's scalar types and their struct codes.
PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def parse_ply(data: bytes) -> dict[str, list[dict]]:
    """Elements of a PLY file, ascii or binary of either order; list properties become lists."""
    end = data.index(b"end_header")
    header, body = data[:end].decode().split("\n"), data[data.index(b"\n", end) + 1 :]
    form, elements = "ascii", []
    for line in header:
        words = line.split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], words[1:-1]))
    out, tokens, at = {}, iter(body.split()) if form == "ascii" else iter(()), 0
    mark = "<" if "little" in form else ">"

    def read(kind: str):
        nonlocal at
        if form == "ascii":
            word = next(tokens)
            return float(word) if PLY_TYPES[kind] in "fd" else int(word)
        value = struct.unpack_from(mark + PLY_TYPES[kind], body, at)[0]
        at += struct.calcsize(PLY_TYPES[kind])
        return value

    for name, n, properties in elements:
        out[name] = [{p: [read(t[2]) for _ in range(read(t[1]))] if t[0] == "list" else read(t[0]) for p, t in properties} for _ in range(n)]
    return out


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, vid, x, y, z, other numbers by name) and polygons (path, fid, vs) of PLY files, a task a file."""

    def rows(element: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, content in zip(pdf["path"], pdf["content"], strict=True):
                    found = parse_ply(bytes(content)).get(element, [])
                    if element == "vertex":
                        yield pd.DataFrame([(name, i, v["x"], v["y"], v["z"], {k: float(x) for k, x in v.items() if k not in "xyz"}) for i, v in enumerate(found)], columns=["path", "vid", "x", "y", "z", "rest"])
                    else:
                        yield pd.DataFrame([(name, i, next(x for x in v.values() if isinstance(x, list))) for i, v in enumerate(found)], columns=["path", "fid", "vs"])

        return run

    files = binary_files(spark, path, "*.ply").select("path", "content")
    return files.mapInPandas(rows("vertex"), "path string, vid long, x double, y double, z double, rest map<string, double>"), files.mapInPandas(rows("face"), "path string, fid long, vs array<long>")


def write_ply(spark: SparkSession, path: str, points: DataFrame, faces: DataFrame | None = None, *, ascii: bool = True) -> None:
    """One PLY file of ``points(x, y, z[, nx, ny, nz][, r, g, b])`` that fit the driver."""
    columns = [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b") if c in points.columns]
    names = {"r": "red", "g": "green", "b": "blue"}
    order = [c for c in ("vid", "id") if c in points.columns]
    table = (points.orderBy(*order) if order else points).select(*columns).collect()
    triangles = faces.orderBy("fid").select("v0", "v1", "v2").collect() if faces is not None else []
    head = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0", f"element vertex {len(table)}"]
    head += [f"property {'uchar' if c in names else 'float'} {names.get(c, c)}" for c in columns]
    if faces is not None:
        head += [f"element face {len(triangles)}", "property list uchar int vertex_indices"]
    out = bytearray(("\n".join([*head, "end_header"]) + "\n").encode())
    if ascii:
        for row in table:
            out += (" ".join(str(int(v)) if c in names else repr(float(v)) for c, v in zip(columns, row, strict=True)) + "\n").encode()
        for face in triangles:
            out += ("3 " + " ".join(map(str, face)) + "\n").encode()
    else:
        kind = struct.Struct("<" + "".join("B" if c in names else "f" for c in columns))
        for row in table:
            out += kind.pack(*(int(v) if c in names else float(v) for c, v in zip(columns, row, strict=True)))
        for face in triangles:
            out += struct.pack("<B3i", 3, *face)
    write_bytes(spark, path, bytes(out))


def urdf_text(name: str, parts: Sequence[tuple[str, Sequence[float], Sequence[float]]]) -> str:
    """A URDF of parts (OBJ file, position, roll-pitch-yaw), each a link fixed to the base."""
    robot = ET.Element("robot", name=name)
    ET.SubElement(robot, "link", name="base")
    for k, (file, xyz, rpy) in enumerate(parts):
        link = ET.SubElement(robot, "link", name=f"part_{k:03d}")
        for kind in ("visual", "collision"):
            geometry = ET.SubElement(ET.SubElement(link, kind), "geometry")
            ET.SubElement(geometry, "mesh", filename=file)
        joint = ET.SubElement(robot, "joint", name=f"joint_{k:03d}", type="fixed")
        ET.SubElement(joint, "parent", link="base")
        ET.SubElement(joint, "child", link=f"part_{k:03d}")
        ET.SubElement(joint, "origin", xyz=" ".join(map(str, xyz)), rpy=" ".join(map(str, rpy)))
    ET.indent(robot)
    return ET.tostring(robot, encoding="unicode")


def write_scene_urdf(spark: SparkSession, path: str, parts: dict[str, tuple[DataFrame, DataFrame]], places: dict[str, tuple[Sequence[float], Sequence[float]]]) -> None:
    for name, (vertices, faces) in parts.items():
        write_obj(vertices, faces, f"{path}/{name}.obj")
    write_bytes(spark, f"{path}/scene.urdf", urdf_text("scene", [(f"{n}.obj", *places.get(n, ((0, 0, 0), (0, 0, 0)))) for n in parts]).encode())


def read_mjcf(spark: SparkSession, path: str) -> DataFrame:
    """Geoms of MJCF files with their body's number in pre-order: (path, body, body_name, geom, kind, size, pos, quat)."""

    def numbers(value: str | None, default: list[float]) -> list[float]:
        return [float(v) for v in value.split()] if value else default

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, body = [], -1
                world = ET.fromstring(bytes(content).decode()).find("worldbody")
                stack = [b for b in reversed(world.findall("body"))] if world is not None else []
                while stack:
                    node = stack.pop()
                    body += 1
                    for geom in node.findall("geom"):
                        rows.append((name, body, node.get("name"), len(rows), geom.get("type", "sphere"), numbers(geom.get("size"), []), numbers(geom.get("pos"), [0.0] * 3), numbers(geom.get("quat"), [1.0, 0.0, 0.0, 0.0])))
                    stack += reversed(node.findall("body"))
                yield pd.DataFrame(rows, columns=["path", "body", "body_name", "geom", "kind", "size", "pos", "quat"])

    return binary_files(spark, path, "*.xml").select("path", "content").mapInPandas(run, "path string, body int, body_name string, geom int, kind string, size array<double>, pos array<double>, quat array<double>")
