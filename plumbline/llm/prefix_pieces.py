"""SentencePiece BPE through a table of prefixes, and back.

Of each prefix of a segment the encoding has one last token. A sequence of tokens is the encoding of
its text if and only if each two neighbours are the encoding of theirs: the first merge across a
border in the whole text would also be made in the pair alone. So the last token of a prefix is the
one piece that ends there, as an automaton finds them, and is compatible with the last token of the
prefix before it. Only its length is stored, one byte a character; the ids are then recovered from
the end backwards. A character that no compatible longer piece ends with is a token of its own.

Where no piece holds two characters next to each other, no merge can cross: texts are cut into
words before their marks, and words into segments there. Ids of short words and segments, and
whether a pair is compatible, are kept in tables of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of

#: The character that stands for a space.
MARK = "▁"

#: Entries of a generation of words and of pairs at most; characters of a word that is kept.
KEPT, PAIRS, SHORT = 1 << 19, 1 << 19, 48

#: Tokens are numbers below this: places of pieces, then code points of single characters that are none.
_TOKENS = 1 << 22

_RUNS = re.compile(f"({MARK}{{2,}})")

_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class _Memo(dict):
    """Values of a function by argument. When full, it becomes the old generation, whose entries come back when asked for; so its size is bounded, and it never changes a result."""

    def __init__(self, function, most: int, keep=lambda key: True):
        super().__init__()
        self.function, self.most, self.keep, self.old = function, most, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
            if not self.keep(key):
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Codes(dict):
    """A token's number, of any other character that of its code point."""

    def __missing__(self, character: str) -> int:
        return len(self) + ord(character)


class Pieces:
    """The pieces of a BPE model: ranks, automaton, compatible pairs and ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, trainer = model.normalizer_spec, model.trainer_spec
        kinds = proto.ModelProto.SentencePiece
        odd = {kinds.USER_DEFINED, kinds.UNUSED} & {p.type for p in model.pieces}
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or trainer.treat_whitespace_as_suffix or odd:
            raise ValueError(f"{path}: only BPE models with byte fallback, without normalisation and without user-defined pieces are supported")
        self.prefix = MARK if normal.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        long = [p for p in self.score if len(p) > 1]
        self.widest = max(map(len, long), default=1)
        self.names = list(self.ids)
        self.code = _Codes((p, k) for k, p in enumerate(self.names))
        self.automaton = ahocorasick.Automaton()
        for p in long:
            if self.merged(p) == [p]:  # others are never made
                self.automaton.add_word(p, (len(p), self.code[p]))
        self.automaton.make_automaton()
        self.neighbours = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        self.apart = not any(pair[1] == MARK != pair[0] for pair in self.neighbours)
        self.id_of = [*self.ids.values()]
        self.compatible = _Memo(self._compatible, PAIRS)
        self.segment_ids = _Memo(self._segment_ids, KEPT, lambda s: len(s) <= SHORT)
        self.word_ids = _Memo(lambda word: self._cut_ids(MARK + word), KEPT, lambda s: len(s) <= SHORT)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text, merge by merge: the highest score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-s, i) for i, pair in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if (s := self.score.get(pair)) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def token(self, code: int) -> str:
        return self.names[code] if code < len(self.names) else chr(code - len(self.names))

    def _compatible(self, pair: int) -> bool:
        a, b = map(self.token, divmod(pair, _TOKENS))
        return self.merged(a + b) == [a, b]

    def last_tokens(self, segment: str) -> tuple[Sequence[int], list[int]]:
        """For each prefix the length of its last token, and for each character the token that ends with it."""
        n = len(segment)
        lengths = bytearray(b"\1") * (n + 1) if self.widest < 256 else array("I", [1]) * (n + 1)
        codes, compatible, found = [*map(self.code.__getitem__, segment)], self.compatible, -1
        for last, (size, code) in self.automaton.iter(segment):
            if last == found:
                continue
            start = last + 1 - size
            if not start or compatible[codes[start - 1] * _TOKENS + code]:
                lengths[last + 1], codes[last], found = size, code, last
        return lengths, codes

    def _segment_ids(self, segment: str) -> list[int]:
        lengths, codes = self.last_tokens(segment)
        end, out, id_of, known = len(segment), [], self.id_of, len(self.id_of)
        while end:
            code = codes[end - 1]
            if code < known:
                out.append(id_of[code])
            else:
                out += [self.bytes[b] for b in reversed(self.token(code).encode())]
            end -= lengths[end]
        out.reverse()
        return out

    def _cut_ids(self, text: str) -> list[int]:
        neighbours = self.neighbours
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in neighbours]
        if not cuts:
            return self._segment_ids(text)
        parts = [text[a:b] for a, b in pairwise([0, *cuts, len(text)])]
        return [*chain.from_iterable(self.word_ids[p[1:]] if self.apart and p[0] == MARK != p[1:2] and len(p) > 1 else self.segment_ids[p] for p in parts)]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", MARK)
        if not self.apart:
            return self._cut_ids(text)
        out: list[int] = []
        runs = ["", *_RUNS.split(text)]  # a run of marks, then what follows it, in turn
        for run, rest in zip(runs[::2], runs[1::2], strict=True):
            first, *words = rest.split(MARK)
            out += self._cut_ids(run + first) if run or first else []
            out += chain.from_iterable(map(self.word_ids.__getitem__, words))
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(path: str, text: str) -> list[int]:
    return pieces(path).encode(text)


def decode(path: str, ids: list[int]) -> str:
    return _library(path).decode(ids) if ids else ""


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = pa.array([encode(path, t.as_py()) for t in part["text"]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    return run


def _digests(path: str):
    def row(text: str) -> tuple[int, str, str]:
        ids = encode(path, text)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(path, ids).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(row(t.as_py()) for t in batch["text"]), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text, as the sentencepiece library gives them.

    A null text is an empty one and has no ids; a null doc_id and repeated rows stay rows. Texts of
    any length are encoded in time and memory that grow with their length alone; characters outside
    the vocabulary become the ids of their bytes. There are no ties to settle: each prefix has one
    last token. An empty table gives no rows; other columns, of whatever names, are not read.
    """
    return _texts(docs).mapInArrow(_encoder(model or default_model()), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of ``encode_documents``' rows; null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(path, ids.as_py() or []) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of each text's ids and of the text they decode to; rows as in ``encode_documents``."""
    return _texts(docs).mapInArrow(_digests(model or default_model()), _DIGESTS)
