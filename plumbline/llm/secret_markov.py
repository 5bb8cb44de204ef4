"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers.

The patterns' matches are always reported. Beyond them, a token (a run of the alphabet, of any
length) is a secret if a first-order Markov model of random strings explains it better than one of
ordinary identifiers, by a log-likelihood ratio that reaches a bound.

Both models are trained from labelled samples: the patterns label the corpus, what they found being
random and every other token ordinary, and beside it there are strings drawn from a seeded generator
and identifiers made from a word list. One document in HELD_OUT, by its text's checksum, sets the
bound of a model trained on the others; the model that is used then counts all documents.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import plainly_named, text_of, text_slices

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more of AKIA[A-Z0-9]+
_HEX = re.compile(r"[0-9a-f]{24,}")  # so long ones of [0-9a-f]+

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
_INDEX = np.full(256, -1, dtype=np.int16)
_INDEX[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIZE)

#: One document in so many is held out; the least bound (a prior of one secret in 10,000 tokens); what a share of false finds costs against one of missed secrets; steps of a bound.
HELD_OUT, PRIOR, COST, STEPS = 8, math.log(10_000), 1000.0, 240

#: Labelled words of ordinary identifiers.
_WORDS = (
    "account action address array author background batch border browser buffer button cache callback channel client color column command comment component config connection container content context controller "
    "counter create current data database default delete delta description document element email enable error event export factory field file filter first format function global group handler header height "
    "image import index info input instance internal item label language last layout length level library limit list load local location manager margin maximum message method minimum model module name "
    "network number object offset option order output package padding page param parent parser path pattern payload platform player point position prefix process profile project property provider public query "
    "random range reader record reference register request response result route sample scale schema screen script search section select server service session setting shape size source stack start state status "
    "storage stream string style suffix system table target task template text theme thread title total transform type update upload user util validate value variable version view width window worker writer"
).split()


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of transitions, ``ratio[previous + 1, symbol]``; row 0 holds first symbols."""

    ratio: np.ndarray
    bound: float = PRIOR

    def score(self, token: str) -> float:
        at = _INDEX[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[np.append(0, at[:-1] + 1), at].sum())

    def is_random(self, token: str) -> bool:
        return self.score(token) >= self.bound


def transitions(tokens: Iterator[str]) -> np.ndarray:
    counts = np.zeros((SIZE + 1, SIZE), dtype=np.int64)
    for token in tokens:
        at = _INDEX[np.frombuffer(token.encode("ascii", "ignore"), np.uint8)]
        at = at[at >= 0]
        if len(at):
            np.add.at(counts, (np.append(0, at[:-1] + 1), at), 1)
    return counts


def built_in_tokens(seed: int = 7, each: int = 400) -> tuple[list[str], list[str]]:
    """Labelled random strings and labelled identifiers; the same for every input."""
    rng = np.random.Generator(np.random.PCG64(seed))
    digits, lower, upper = ALPHABET[52:62], ALPHABET[26:52], ALPHABET[:26]
    random = []
    for letters in (upper + lower + digits + "+/", upper + lower + digits, upper + lower + digits + "_-", lower + digits, upper + digits, digits + "abcdef"):
        random += ["".join(rng.choice(list(letters), 40)) for _ in range(each)]
    ordinary = []
    for _ in range(6 * each):
        words = [str(w) for w in rng.choice(_WORDS, 3)]
        style = rng.integers(0, 5)
        ordinary.append(["_".join(words), "-".join(words), words[0] + words[1].title() + words[2].title(), "_".join(words).upper(), "/".join(words)][style] + (str(rng.integers(0, 2100)) if rng.random() < 0.3 else ""))
    return random, ordinary


def built_in_samples() -> tuple[np.ndarray, np.ndarray]:
    """Transition counts of both built-in samples."""
    random, ordinary = built_in_tokens()
    return transitions(iter(random)), transitions(iter(ordinary))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, code points, end exclusive; each kind leftmost and without overlap."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def token_scores(data: np.ndarray, limits: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans and scores of all tokens of texts that lie one after another."""
    symbol = _INDEX[data]
    inside = symbol >= 0
    cuts = limits[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before = np.empty_like(symbol)
    before[:1] = -1
    before[1:] = symbol[:-1]
    before[cuts] = -1
    last = inside.copy()
    last[:-1] &= symbol[1:] < 0
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(inside & (before < 0)), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1)
    np.cumsum(np.where(inside, ratio[before + 1, np.maximum(symbol, 0)], 0.0), out=total[1:])
    return starts, ends, total[ends] - total[starts]


def apart(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans``, which are in order and disjoint, that overlap no base span; one sweep."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((x, y) for _, x, y in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for a, b in spans:
        i = bisect.bisect_right(ends, a)
        if i == len(starts) or b <= starts[i]:
            out.append((a, b))
    return out


def spans_of(column: pa.Array, model: Model) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Each text with its base spans and the random tokens that overlap none of them."""
    for i, j, data, limits in text_slices(column):
        starts, ends, scores = token_scores(data, limits, model.ratio)
        hit = np.flatnonzero(scores >= model.bound - 1e-6)
        row = np.searchsorted(limits, starts[hit], side="right") - 1
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if len(hit) else None
        cuts = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            text = column[i + k].as_py() or ""
            base = base_spans(text)
            own = [(int(points[starts[h]] - points[limits[k]]), int(points[ends[h]] - points[limits[k]])) for h in hit[cuts[k] : cuts[k + 1]]]
            own = [(a, b) for a, b in own if model.is_random(text[a:b])]
            yield text, in_order([*base, *(("random", a, b) for a, b in apart(own, base))])


def all_spans(text: str, model: Model) -> list[tuple[str, int, int]]:
    """The base spans, and random tokens that overlap none of them."""
    return next(spans_of(pa.array([text], pa.string()), model), (text, []))[1]


def _labelled(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts with, for each byte, 0 outside base spans, 1 in a value that a pattern found and 2 in the rest of a span."""
    for i, j, data, limits in text_slices(column):
        role = np.zeros(len(data), dtype=np.int8)
        for k in range(j - i):
            text = column[i + k].as_py() or ""
            plain = len(text) == limits[k + 1] - limits[k]
            at = lambda n: int(limits[k]) + (n if plain else len(text[:n].encode()))  # noqa: B023, E731
            for m in _ASSIGN.finditer(text):
                if m.end() - m.start(2) >= 6:
                    role[at(m.start()) : at(m.start(2))] = 2
                    role[at(m.start(2)) : at(m.end())] = 1
            for pattern in (_ACCESS, _HEX):
                for m in pattern.finditer(text):
                    role[at(m.start()) : at(m.end())] = 1
        yield data, limits, role


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions within tokens, by role and by whether the text is held out; a change of role starts a token."""
    size = (SIZE + 1) * SIZE
    counts = np.zeros((4, size), dtype=np.int64)  # random, ordinary, and both of held-out texts
    for batch in batches:
        held, done = batch["held"].to_numpy(zero_copy_only=False).astype(np.int64), 0
        for data, limits, role in _labelled(batch["text"]):
            symbol = _INDEX[data].astype(np.int64)
            before = np.append(-1, symbol[:-1])[: len(symbol)]
            before[np.flatnonzero(np.diff(role)) + 1] = -1
            before[limits[:-1][limits[:-1] < len(data)]] = -1
            apart_ = np.repeat(held[done : done + len(limits) - 1], np.diff(limits))
            done += len(limits) - 1
            able = (symbol >= 0) & (role < 2)
            kind = 2 * apart_ + 1 - role
            counts += np.bincount((kind * size + (before + 1) * SIZE + symbol)[able], minlength=4 * size).reshape(4, size)
    yield _cells(counts)


def _cells(counts: np.ndarray) -> pa.RecordBatch:
    """A row for each cell that isn't empty."""
    at = np.flatnonzero(counts.sum(axis=0))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(c[at], pa.int64()) for c in counts)], ["cell", *(f"n{k}" for k in range(len(counts)))])


def steps_of(scores: np.ndarray) -> np.ndarray:
    """The number of the last bound that a score reaches: bounds are whole numbers from 1 on, 0 none."""
    return np.clip(np.floor(scores), 0, STEPS).astype(np.int64)


def _held_out(model: Model, alike: float):
    """Counts of held-out tokens by step. Unlabelled ones that score like random strings, ``alike`` a character, tell nothing of ordinary ones and aren't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STEPS + 1), dtype=np.int64)
        for batch in batches:
            for data, limits, role in _labelled(batch["text"]):
                edges = np.union1d(limits, np.flatnonzero(np.diff(role)) + 1)
                starts, ends, scores = token_scores(data, edges, model.ratio)
                for kind, able in ((1, True), (0, scores < alike * (ends - starts))):
                    counts[1 - kind] += np.bincount(steps_of(scores[(role[starts] == kind) & able]), minlength=STEPS + 1)
        yield _cells(counts)

    return run


def bound_of(random: np.ndarray, ordinary: np.ndarray) -> float:
    """The bound, PRIOR at least, at which missed secrets and COST times false finds, as shares of held-out tokens, are least."""
    missed = np.append(0, np.cumsum(random)[:-1]) / max(1, random.sum())
    false = np.cumsum(ordinary[::-1])[::-1] / max(1, ordinary.sum())
    least = math.ceil(PRIOR)
    return float(least + np.argmin((missed + COST * false)[least:]))


#: The corpus's share in a model.
CORPUS = 10 / 11


def train(docs: DataFrame, smoothing: float = 0.5, text: str = "text", prior: float = 1000.0) -> Model:
    """Both models and the bound, from all documents and the built-in samples.

    What reaches the driver is a count for each transition of the alphabet, SIZE * (SIZE + 1) rows
    at most, and one for each step of a bound. A model is a fixed mixture of two: CORPUS parts that
    of the corpus's own transitions as they are counted, with ``prior`` built-in ones after each
    symbol, so that a few tokens of a small corpus don't vouch for themselves, and the rest that of
    the built-in ones.
    """
    held = F.pmod(F.crc32("text"), F.lit(HELD_OUT)) == 0
    texts = docs.select(text_of(docs, text).alias("text")).withColumn("held", held)

    def summed(part: DataFrame, f, n: int, size: int) -> np.ndarray:
        found, names = np.zeros((n, size)), [f"n{k}" for k in range(n)]
        for cell, *sums in part.mapInArrow(f, "cell long, " + ", ".join(f"{c} long" for c in names)).groupBy("cell").agg(*map(F.sum, names)).collect():
            found[:, cell] = sums
        return found.reshape(n, *([-1, SIZE] if f is _count else [size]))

    built_in = built_in_samples()

    def ratio(counts: np.ndarray) -> np.ndarray:
        log = []
        for own, sample in zip(counts, built_in, strict=True):
            base = (sample + smoothing) / (sample + smoothing).sum(axis=1, keepdims=True)
            corpus = (own + prior * base) / (own.sum(axis=1, keepdims=True) + prior)
            log.append(np.log(CORPUS * corpus + (1 - CORPUS) * base))
        return log[0] - log[1]

    counts = summed(texts, _count, 4, (SIZE + 1) * SIZE)
    model = Model(ratio(counts[:2]))
    tokens = built_in_tokens(seed=8, each=100)
    scores = [np.array([model.score(x) for x in own]) for own in tokens]
    alike = float(np.quantile(scores[0] / np.array([len(x) for x in tokens[0]]), 0.1))
    seen = summed(texts.filter("held").select("text"), _held_out(model, alike), 2, STEPS + 1)
    for k, own in enumerate(scores):
        seen[k] += np.bincount(steps_of(own), minlength=STEPS + 1)
    return Model(ratio(counts[:2] + counts[2:]), bound_of(*seen))


def _scan(model: Model, redacted: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            spans: list[list[dict]] = []
            masked: list[str] = []
            for text, own in spans_of(batch["text"], model):
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                if redacted:
                    masked.append(redact(text, own))
            added = [pa.array(spans, kind), *[pa.array(masked, pa.string())] * redacted]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *added], [*kept, "spans", *["redacted"] * redacted])

    return run


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """Masks the spans; of an assignment only the value."""
    out, at = [], 0
    for kind, a, b in spans:
        if kind == "assign":
            a = _ASSIGN.match(text, a).start(2)
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanned(docs: DataFrame, model: Model | None, text: str, redacted: bool) -> DataFrame:
    """Columns c0, c1, ... of ``docs`` and the added ones."""
    model = model or train(docs, text=text)
    plain = plainly_named(docs)
    rows = plain.select("*", text_of(plain, f"c{docs.columns.index(text)}").alias("text"))
    added = "spans array<struct<kind: string, start: bigint, end: bigint>>" + ", redacted string" * redacted
    return rows.mapInArrow(_scan(model, redacted), T.StructType([*rows.drop("text").schema.fields, *T.StructType.fromDDL(added).fields]))


def scan(docs: DataFrame, model: Model | None = None, *, text: str = "text", redacted: bool = False) -> DataFrame:
    """Adds ``spans`` (array of kind, start, end; in order) and, if asked for, the ``redacted`` text to ``docs``.

    A null text is empty and has no spans; its redacted text is empty. A token of any length is
    judged, and a text of any length read once. Tokens of equal score share a verdict; one at the
    bound is a secret. Every row stays, repeated ones and those with null ids too; columns named like
    an added one are replaced. The scan is one pass without a shuffle; the model is trained on
    ``docs`` if none is given.
    """
    new = ("spans", "redacted") if redacted else ("spans",)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in new]
    return _scanned(docs, model, text, redacted).select(*kept, *new)


def masked(docs: DataFrame, model: Model | None = None, *, text: str = "text") -> DataFrame:
    """``docs`` in its own columns, whatever their names, the secrets of its texts masked."""
    at = docs.columns.index(text)
    return _scanned(docs, model, text, True).select(*(F.col("redacted" if i == at else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scanned(doc_id, spans)``."""
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
