"""Byte-level BPE over overlapping chunks, and back.

A text of one chunk is encoded at once. A longer one is cut into chunks that overlap, and chunks
are pre-tokenised in parallel, each from its own start, which may lie inside a pre-token. Where a
boundary found by a chunk is also found by the next one, both agree from there on, as a match
depends only on the text to its right; there the texts are stitched. The pieces between such
places are encoded in parallel. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import partitions_for, text_of

#: Code points of a chunk, and by how many it overlaps the next.
CHUNK, OVERLAP = 32768, 1024

_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_CHUNKS = "row long, doc_id long, chunk int, text string, head binary, tail binary"


@functools.lru_cache(maxsize=4)
def _matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode(path: str, text: str) -> np.ndarray:
    return bpe.encode(bpe.rank_encoding(path), text)


def decode(path: str, ids: np.ndarray) -> bytes:
    return bpe.rank_encoding(path).decode_bytes(ids.tolist())


def boundaries(text: str, pattern: str = PATTERN) -> list[int]:
    """Where pre-tokens start, and the text's end."""
    return [*(m.start() for m in _matcher(pattern).finditer(text)), len(text)]


def zones(text: str, chunk: int, overlap: int, pattern: str = PATTERN) -> tuple[list[int], list[int]]:
    """Boundaries that a chunk sees in its first ``overlap`` code points and in the overlap after it.

    Those within the last quarter of an overlap can depend on text that the chunk doesn't see, and
    are left out. A boundary counts if a non-space precedes it: then no pre-token to its left looks
    past it.
    """
    most = overlap * 3 // 4
    marks = [i for i in boundaries(text, pattern) if 0 < i < len(text) and not text[i - 1].isspace()]
    return [i for i in marks if i <= most], [i - chunk for i in marks if chunk < i <= chunk + most]


def stitch(parts: list[tuple[str, list[int], list[int]]], chunk: int, pattern: str = PATTERN) -> list[str]:
    """Cuts a text, given as overlapping (text, head, tail) chunks, into pieces that encode by themselves.

    Where the overlap of two chunks has no common boundary (one pre-token fills it), chunks are joined,
    and boundaries are found anew each time that what is joined has doubled. So the result is always
    exact, and the work is in proportion to the text.
    """
    pieces: list[str] = []
    joined, at, tail = [parts[0][0]], 0, parts[0][2]
    width = chunk  # code points that are joined before the next chunk's start
    due = 2 * chunk
    for text, head, next_tail in parts[1:]:
        common = min(set(head) & set(tail), default=None)
        if common is not None and width + common > at:
            pieces.append("".join(joined)[at : width + common])
            joined, at, tail, width, due = [text], common, next_tail, chunk, 2 * chunk
            continue
        joined[-1] = joined[-1][:chunk]
        joined.append(text)
        width, tail = width + chunk, []
        if width >= due:
            whole = "".join(joined)
            seen = len(whole) - width
            marks = [i + at - width for i in boundaries(whole[at:], pattern)]
            tail = [i for i in marks if 0 < i <= seen * 3 // 4 and not whole[width + i - 1].isspace()]
            due = 2 * width
    pieces.append("".join(joined)[at:])
    return pieces


def digest(path: str, parts: list[np.ndarray]) -> tuple[int, str, str]:
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in parts:
        if len(ids):
            ids_hash.update((" " if n else "").encode() + " ".join(map(str, ids.tolist())).encode())
            text_hash.update(decode(path, ids))
            n += len(ids)
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(path, [encode(path, x.as_py())]) for x in batch["text"]]
            columns = zip(*found, strict=True) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for doc_id, part, value in zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist(), batch["text"], strict=True):
                text, row = value.as_py(), (part << 36) + n
                starts = range(0, len(text), chunk)
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(starts), pa.int64()), "doc_id": pa.array([doc_id] * len(starts), pa.int64()), "chunk": pa.array(range(len(starts)), pa.int32()), "text": pa.array([text[a : a + chunk + overlap] for a in starts], pa.string())})
                n += 1

    return run


def _pre_tokenise(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zones(x.as_py(), chunk, overlap) for x in batch["text"]]
            packed = [pa.array([np.array(z[side], dtype="<i4").tobytes() for z in found], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *packed], [*batch.schema.names, "head", "tail"])

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that follow each other with the same ``row``."""
    held: list[dict] = []
    for batch in batches:
        for x in batch.to_pylist():
            if held and held[0]["row"] != x["row"]:
                yield held
                held = []
            held.append(x)
    if held:
        yield held


def _stitched(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_row(batches):
            pieces = stitch([(x["text"], np.frombuffer(x["head"], "<i4").tolist(), np.frombuffer(x["tail"], "<i4").tolist()) for x in rows], chunk)
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["row"]] * n, pa.int64()), pa.array([rows[0]["doc_id"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string())], ["row", "doc_id", "piece", "text"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([encode(path, x.as_py()).tobytes() for x in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["piece"], ids], ["row", "doc_id", "piece", "ids"])

    return run


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_row(batches):
            n, a, b = digest(path, [np.frombuffer(x["ids"], "<u4") for x in rows])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})

    return run


def encode_long(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs(doc_id, text)`` to (row, doc_id, piece, ids): little-endian ids of each stitched piece."""
    n = partitions_for(docs, 4 << 20, docs.sparkSession.sparkContext.defaultParallelism)
    chunks = docs.withColumn("part", F.spark_partition_id()).mapInArrow(_cut(chunk, overlap), "row long, doc_id long, chunk int, text string").repartition(n).mapInArrow(_pre_tokenise(chunk, overlap), _CHUNKS)
    pieces = chunks.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(_stitched(chunk), "row long, doc_id long, piece int, text string")
    return pieces.repartition(n).mapInArrow(_encoded(path), "row long, doc_id long, piece int, ids binary")


def round_trip(docs: DataFrame, ranks: str | None = None, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encodes ``docs(doc_id, text)``, decodes the ids, and returns doc_id, n_tokens and both SHA-256.

    A null or empty text has no ids; its hashes are those of the empty string. Null and repeated
    doc_ids stay, a row each. Texts of over ``chunk`` code points go through overlapping chunks; an
    empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    path = ranks or bpe.default_ranks()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    short = rows.filter(F.length("text") <= chunk).mapInArrow(_short(path), _DIGESTS)
    ids = encode_long(rows.filter(F.length("text") > chunk), path, chunk, overlap)
    n = partitions_for(docs, 16 << 20, docs.sparkSession.sparkContext.defaultParallelism)
    long = ids.repartition(n, "row").sortWithinPartitions("row", "piece").mapInArrow(_digested(path), _DIGESTS)
    return short.unionByName(long)
