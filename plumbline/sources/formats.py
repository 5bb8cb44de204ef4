"""NPZ bundles, PLY clouds, OBJ statements and COLMAP models as Spark data sources.

``register(spark)`` makes ``spark.read.format("npz" | "ply" | "obj" | "colmap")`` and the writers of
the first three known. Files are read and written by executors, through whatever file system the
path's scheme names. A reader makes a partition of each file, of a large binary PLY file several;
what isn't in the requested schema isn't decoded, and the options ``files`` and ``keys`` (of arrays,
or keywords) leave others unread. A writer's tasks write into a folder of the job's own, which the commit moves into
place and an abort removes.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from plumbline.sources import colmap
from plumbline.sources.meshes import KEYWORDS, PLY_TYPES, parse_ply

#: Rows of a read partition, and of a written file.
ROWS = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    system, place = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else posixpath.abspath(path))
    return system, place


def files_of(path: str, suffix: str) -> list[str]:
    """Files of a folder with the suffix, in order, or the file itself."""
    system, place = opened(path)
    info = system.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [place]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pafs.FileSelector(place))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


@dataclass
class Part(InputPartition):
    file: str
    start: int = 0
    n: int = -1


class _Reader(DataSourceReader):
    """Reads files of a suffix; the options ``files`` and ``keys`` name those files and entries that are wanted."""

    # no pushFilters: Spark keeps a reader with its filters for all queries of a DataFrame

    suffix = ""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns, self.path = options, [f.name for f in schema.fields], options["path"]
        self.names = self.options_of("files")
        self.keys = self.options_of("keys")

    def options_of(self, name: str) -> set[str] | None:
        given = self.options.get(name)
        return None if given is None else {x.strip() for x in given.split(",")}

    def files(self) -> list[str]:
        return [f for f in files_of(self.path, self.suffix) if self.names is None or posixpath.basename(f) in self.names]

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(f) for f in self.files()] or [Part("")]

    def batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self.rows(opened(self.path)[0], partition)

    def rows(self, system: pafs.FileSystem, part: Part) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Tasks write files into ``_temporary-<job>``; the commit moves them beside each other."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.overwrite, self.path, self.job = options, overwrite, options["path"], uuid.uuid4().hex
        self.columns = [f.name for f in schema.fields]

    def folder(self) -> tuple[pafs.FileSystem, str, str]:
        system, place = opened(self.path)
        return system, place, f"{place}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self.folder()
        task, out = f"{folder}/{uuid.uuid4().hex}", []  # a repeated attempt has a folder of its own
        for name, data in self.contents(iterator):
            system.create_dir(task)
            with system.open_output_stream(f"{task}/{name}") as f:
                f.write(data)
            out.append(f"{task}/{name}")
        return Written(out)

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def commit(self, messages: list[Written | None]) -> None:
        system, place, folder = self.folder()
        files = [f for m in messages if m for f in m.files]
        names = [posixpath.basename(f) for f in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"several tasks wrote a file of one name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
            system.create_dir(place)
            if self.overwrite:
                for f in system.get_file_info(pafs.FileSelector(place)):
                    if f.type == pafs.FileType.File:
                        system.delete_file(f.path)
            for f, name in zip(files, names, strict=True):
                system.move(f, f"{place}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self.folder()
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class _Source(DataSource):
    kind: str
    read_with: type[_Reader]
    write_with: type[_Writer] | None = None

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.read_with(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if self.write_with is None:
            raise ValueError(f"{self.kind} can't be written")
        return self.write_with(self.options, schema, overwrite)


# NPZ


class NpzReader(_Reader):
    suffix = ".npz"

    def rows(self, system, part):
        with system.open_input_file(part.file) as f, zipfile.ZipFile(f) as bundle:
            for member in bundle.namelist():
                key = member.removesuffix(".npy")
                if self.keys is not None and key not in self.keys:
                    continue
                with bundle.open(member) as data:
                    version = np.lib.format.read_magic(data)
                    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(data)
                if dtype.kind not in "biuf":
                    continue
                columns = {"path": pa.array([part.file]), "key": pa.array([key]), "dtype": pa.array([str(dtype)]), "shape": pa.array([list(shape)], pa.list_(pa.int64()))}
                if "data" in self.columns:  # else the header was enough
                    values = np.lib.format.read_array(io.BytesIO(bundle.read(member)), allow_pickle=False).astype(np.float64).ravel()
                    columns["data"] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                yield self.batch(columns)


class NpzWriter(_Writer):
    """Rows (bundle, key, dtype, shape, data), rows of a bundle in one task and beside each other: a file a bundle."""

    def contents(self, batches):
        name, arrays = None, {}

        def bundle() -> tuple[str, bytes]:
            out = io.BytesIO()
            np.savez(out, **arrays)
            return f"{name}.npz", out.getvalue()

        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if arrays:
                        yield bundle()
                    name, arrays = row["bundle"], {}
                arrays[row["key"]] = np.array(row["data"], dtype=np.float64).astype(row["dtype"]).reshape(row["shape"])
        if arrays:
            yield bundle()


class Npz(_Source):
    kind, read_with, write_with = "npz", NpzReader, NpzWriter

    def schema(self) -> str:
        return "path string, key string, dtype string, shape array<long>, data array<double>"


# PLY


def ply_header(f) -> tuple[int, str, list[tuple[str, int, list[tuple[str, list[str]]]]]]:
    """Where the body starts, the format, and the elements with their properties."""
    data = b""
    while b"end_header" not in data or b"\n" not in data[data.index(b"end_header") :]:
        more = f.read(4096)
        if not more:
            raise ValueError("a PLY file without an end of its header")
        data += more
    end = data.index(b"end_header")
    form, elements = "ascii", []
    for words in map(str.split, data[:end].decode().splitlines()):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], words[1:-1]))
    return data.index(b"\n", end) + 1, form, elements


#: What colour columns are called in files.
_COLOURS = {"r": "red", "g": "green", "b": "blue"}


class PlyReader(_Reader):
    """Vertices: path, vid and numbers by name; missing ones are null. Binary files are read from the rows asked for on."""

    suffix = ".ply"

    def partitions(self):
        system, out = opened(self.path)[0], []
        for file in self.files():
            with system.open_input_file(file) as f:
                _, form, elements = ply_header(f)
            n = elements[0][1] if elements else 0
            whole = form == "ascii" or any(t[0] == "list" for _, t in elements[0][2]) or elements[0][0] != "vertex"
            out += [Part(file)] if whole else [Part(file, a, min(ROWS, n - a)) for a in range(0, n, ROWS)]
        return out or [Part("")]

    def rows(self, system, part):
        with system.open_input_file(part.file) as f:
            if part.n < 0:
                found = parse_ply(f.read()).get("vertex", [])
                names = set(found[0]) if found else set()
                values = {c: np.array([v[c] for v in found], dtype=np.float64) for c in names}
                n = len(found)
            else:
                start, form, elements = ply_header(f)
                mark = "<" if "little" in form else ">"
                kind = np.dtype([(p, mark + PLY_TYPES[t[0]]) for p, t in elements[0][2]])
                f.seek(start + part.start * kind.itemsize)
                table = np.frombuffer(f.read(part.n * kind.itemsize), dtype=kind)
                values, n = {c: table[c] for c in kind.names}, part.n
        for a in range(0, n, 1 << 16):
            b = min(n, a + (1 << 16))
            columns = {}
            for c in self.columns:
                own = _COLOURS.get(c, c)
                if c == "path":
                    columns[c] = pa.array([part.file] * (b - a))
                elif c == "vid":
                    columns[c] = pa.array(np.arange(part.start + a, part.start + b))
                else:
                    columns[c] = pa.array(values[own][a:b].astype(np.float64)) if own in values else pa.nulls(b - a, pa.float64())
            yield self.batch(columns)


class PlyWriter(_Writer):
    """Binary files of at most ROWS points; ``x, y, z`` and what there is of normals as floats (doubles with ``precision=double``), colours as bytes."""

    def contents(self, batches):
        double = self.options.get("precision", "double") == "double"
        fields = [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b") if c in self.columns]
        kind = np.dtype([(c, "u1" if c in _COLOURS else "<f8" if double else "<f4") for c in fields])
        head = [f"property {'uchar' if c in _COLOURS else 'double' if double else 'float'} {_COLOURS.get(c, c)}" for c in fields]

        def file(tables: list[np.ndarray]) -> tuple[str, bytes]:
            rows = np.concatenate(tables)
            text = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *head, "end_header", ""])
            return f"part-{uuid.uuid4().hex}.ply", text.encode() + rows.tobytes()

        held, n = [], 0
        for batch in batches:
            table = np.empty(batch.num_rows, dtype=kind)
            for c in fields:
                table[c] = batch[c].to_numpy(zero_copy_only=False)
            while len(table):
                take = table[: ROWS - n]
                held.append(take)
                table, n = table[len(take) :], n + len(take)
                if n == ROWS:
                    yield file(held)
                    held, n = [], 0
        if held:
            yield file(held)


class Ply(_Source):
    kind, read_with, write_with = "ply", PlyReader, PlyWriter

    def schema(self) -> str:
        return "path string, vid long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"


# OBJ


class ObjReader(_Reader):
    """Statements (part, line, n, keyword, words); a keyword that OBJ doesn't know fails unless ``unknown=ignore``."""

    suffix = ".obj"

    def rows(self, system, part):
        out, counts = [], {}
        with system.open_input_stream(part.file) as f:
            for line, text in enumerate(io.TextIOWrapper(f, encoding="utf-8")):
                words = re.sub("#.*", "", text).split()
                if not words:
                    continue
                if words[0] not in KEYWORDS:
                    if self.options.get("unknown") == "ignore":
                        continue
                    raise ValueError(f"unknown keyword in OBJ: {words[0]}")
                n = counts[words[0]] = counts.get(words[0], -1) + 1
                if self.keys is None or words[0] in self.keys:
                    out.append((part.file, line, n, words[0], words[1:]))
                if len(out) == 1 << 16:
                    yield self._table(out)
                    out = []
        if out:
            yield self._table(out)

    def _table(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"part": pa.string(), "line": pa.int64(), "n": pa.int64(), "keyword": pa.string(), "words": pa.list_(pa.string())}
        return self.batch({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items()) if c in self.columns})


class ObjWriter(_Writer):
    """Statements (part, keyword, words) in the order in which a task has them, rows of a part beside each other: a file a part."""

    def contents(self, batches):
        name, lines = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != name:
                    if lines:
                        yield f"{name}.obj", "".join(lines).encode()
                    name, lines = row["part"], []
                lines.append(" ".join([row["keyword"], *row["words"]]) + "\n")
        if lines:
            yield f"{name}.obj", "".join(lines).encode()


class Obj(_Source):
    kind, read_with, write_with = "obj", ObjReader, ObjWriter

    def schema(self) -> str:
        return "part string, line long, n long, keyword string, words array<string>"


# COLMAP

_TABLES = {
    "cameras": (colmap.CAMERAS, colmap._camera, ("id", "model", "width", "height", "params")),
    "images": (colmap.IMAGES, colmap._image, ("id", "qvec", "tvec", "camera_id", "name", "xys", "point3d_ids")),
    "points3D": (colmap.POINTS, colmap._point, ("id", "xyz", "rgb", "error", "image_ids", "point2d_idxs")),
}


class ColmapReader(_Reader):
    """Records of a binary model's ``table``: cameras, images or points3D."""

    suffix = ".bin"

    def files(self):
        return [f for f in super().files() if posixpath.basename(f).startswith(self.options.get("table", "points3D"))]

    def read(self, partition):
        if not partition.file:
            return
        _, one, names = _TABLES[self.options.get("table", "points3D")]
        at = [names.index(c) for c in self.columns]
        with opened(self.path)[0].open_input_file(partition.file) as f:
            cursor = colmap.Cursor(f.read())
        (n,) = cursor.take("Q")
        for _ in range(n):
            row = one(cursor)
            yield tuple([(v["x"], v["y"]) for v in row[i]] if names[i] == "xys" else row[i] for i in at)


class Colmap(_Source):
    kind, read_with = "colmap", ColmapReader

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "points3D")][0]


def register(spark: SparkSession) -> None:
    for source in (Npz, Ply, Obj, Colmap):
        spark.dataSource.register(source)
