"""Quality classifier by co-training on two views of a document.

One view is its text (hashed words and shape), the other its metadata (language, source, length).
A logistic model of each view is fitted on labelled documents. Over some rounds each judges all
unlabelled documents and gives its most confident verdicts to the other as pseudo-labels, in the
proportion of the classes. Labelled documents kept apart calibrate both views (Platt scaling) and
weigh them; the combined model scores every document.

Features are computed once and stored; each round is a pass over all of them. Fitting uses bounded,
documented samples, those of least hash: at most LABELLED labelled documents, and of the confident
share of all unlabelled ones at most POOL pseudo-labelled documents a view.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hash_words, shared_folder, stored, text_of, text_slices, word_spans

#: Bounds of the samples that are fitted on, and buckets of hashed words.
LABELLED, POOL, WORDS = 6000, 4000, 2048
#: Rounds of exchange, and steps of a probability that are told apart there.
ROUNDS, BINS = 4, 10000
SHAPE, META = 8, 256

_SYMBOL = np.zeros(256, dtype=np.float64)
_SYMBOL[list(b"#*$%&|<>@^~{}[]\\=_+")] = 1
_UPPER = np.zeros(256, dtype=np.float64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_DIGIT = np.zeros(256, dtype=np.float64)
_DIGIT[ord("0") : ord("9") + 1] = 1


def text_features(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed words, as (row, word, value) with unit norm, and a dense matrix of shape ratios."""
    starts, ends, first = word_spans(data, limits)
    n = np.diff(first)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    h = hash_words(data, starts, ends)
    cells, counts = np.unique(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    at, word = cells // WORDS, cells % WORDS
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(at, counts, rows))
    total = lambda table: np.diff(np.append(0, np.cumsum(table[data]))[limits]) if len(data) else np.zeros(rows)
    pairs = np.unique(np.stack([row, h.view(np.int64)]), axis=1)[0] if len(h) else row
    distinct = np.bincount(pairs, minlength=rows)
    words = np.maximum(n, 1)
    length = np.bincount(row, ends - starts, rows)
    again = np.zeros(rows)
    if len(h) > 1:
        again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    size = np.maximum(np.diff(limits), 1)
    shape = np.stack([np.ones(rows), np.minimum(total(_SYMBOL) / words, 3), total(_UPPER) / size * 5, total(_DIGIT) / size * 5, np.minimum(length / words / 10, 3), distinct / words, again / words, np.log1p(n) / 10], axis=1)
    return at, word, value / norm[at], shape


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """For each row the hashed cells of its metadata, META columns at most; absent values have cells of their own."""

    def cell(kind: str, value) -> int:
        return xxhash.xxh64_intdigest(f"{kind}={value}") % (META - 1) + 1

    out = []
    for a, b, n in zip(lang, source, n_chars, strict=True):
        band = None if n is None or n < 0 else int(n).bit_length()
        out.append([0, cell("lang", a), cell("source", b), cell("length", band), cell("lang,length", (a, band))])
    return np.array(out, dtype=np.int64).reshape(-1, 5)


@dataclass
class Logistic:
    """A logistic model with L2 penalty, fitted by accelerated gradient steps."""

    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 120, start: np.ndarray | None = None) -> Logistic:
        weight, y = weight.astype(x.dtype), y.astype(x.dtype)
        w, velocity = np.zeros(x.shape[1], x.dtype) if start is None else start.astype(x.dtype), np.zeros(x.shape[1], x.dtype)
        rate = 1.0 / (0.25 * power_norm(x, weight) + penalty)
        for step in range(steps):
            at = w + velocity * x.dtype.type(step / (step + 3))
            gradient = x.T @ (weight * (sigmoid(x @ at) - y)) + penalty * at
            following = at - x.dtype.type(rate) * gradient
            velocity, w = following - w, following
        return Logistic(w)


def power_norm(x: np.ndarray, weight: np.ndarray, steps: int = 12) -> float:
    """The largest eigenvalue of x' W x, by power iteration, with a margin."""
    v = np.ones(x.shape[1], x.dtype)
    value = 1.0
    for _ in range(steps):
        v = x.T @ (weight * (x @ v))
        value = float(np.linalg.norm(v)) or 1.0
        v = v / x.dtype.type(value)
    return 1.2 * value


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Classifier:
    """Weights of both views, calibrated: (slope, shift) for each, then the weights of both and a shift."""

    words: np.ndarray
    shape: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    combined: tuple[float, float, float]
    threshold: float
    #: Shares of held-out labelled documents that the text view, the metadata view and both judge right, the larger class's share, and rows given by each view in each round.
    report: dict = field(default_factory=dict)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both, from raw scores."""
        a, b = text * self.text_scale[0] + self.text_scale[1], meta * self.meta_scale[0] + self.meta_scale[1]
        return sigmoid(a), sigmoid(b), sigmoid(self.combined[0] * a + self.combined[1] * b + self.combined[2])


def _dense_meta(cells: np.ndarray) -> np.ndarray:
    out = np.zeros((len(cells), META))
    np.put_along_axis(out, cells, 1.0, axis=1)
    return out


def _fit_view(x: np.ndarray, y: np.ndarray, n_train: int, before: Logistic | None = None) -> Logistic:
    """Fits labelled rows, of which there are n_train, and after them pseudo-labelled ones of less weight, from the model before on."""
    classes = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    return Logistic.fit(x, y, classes * np.where(np.arange(len(y)) < n_train, 1.0, 0.3), penalty=0.3, steps=60 if before else 120, start=before.weights if before else None)


#: For turn, both models and the share of kept ones: rows that each view gives to the other, as (text, meta, verdicts).
Exchange = Callable[[int, list[Logistic], float], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def fit_views(text: np.ndarray, meta: np.ndarray, label: np.ndarray, exchange: Exchange, *, rounds: int = ROUNDS, held_out: float = 0.25) -> Classifier:
    """Co-trains on rows with ``label`` 0 or 1; ``exchange`` judges the unlabelled documents of each round.

    text: WORDS + SHAPE columns. Without rows of both classes every document scores 0.5 and is kept.
    """
    if len(label) < 8 or len(np.unique(label)) < 2:
        nothing = (np.zeros(WORDS), np.zeros(SHAPE), np.zeros(META))
        return Classifier(*nothing, (0.0, 0.0), (0.0, 0.0), (0.0, 0.0, 0.0), 0.5)
    apart = np.flatnonzero(np.arange(len(label)) % round(1 / held_out) == 0)
    train = np.setdiff1d(np.arange(len(label)), apart)
    share = label[train].mean()
    views = (text, meta)
    rows, verdicts = [[view[train]] for view in views], [[label[train].astype(float)] for _ in views]
    models: list[Logistic | None] = [None, None]
    handed = []
    for turn in range(rounds + 1):
        models = [_fit_view(np.concatenate(x), np.concatenate(y), len(train), m) for x, y, m in zip(rows, verdicts, models, strict=True)]
        if turn == rounds:
            break
        given = exchange(turn, models, share)
        handed.append([len(g[2]) for g in given])
        for k, g in enumerate(given):  # what view k is sure of goes to the other
            rows[1 - k].append(g[1 - k])
            verdicts[1 - k].append(g[2])
    y = label[apart].astype(float)
    raw = [(view[apart] @ model.weights).astype(float) for view, model in zip(views, models, strict=True)]
    calibrating = np.arange(len(y)) % 2 == 0 if len(np.unique(y[::2])) == 2 else np.ones(len(y), dtype=bool)

    def fitted(x: np.ndarray) -> Logistic:
        return Logistic.fit(x[calibrating], y[calibrating], np.ones(int(calibrating.sum())), penalty=1e-2, steps=2000)

    def platt(x: np.ndarray) -> tuple[float, float]:
        slope, shift = fitted(np.stack([x, np.ones(len(x))], axis=1)).weights
        return (max(0.0, float(slope)), float(shift))

    scales = [platt(x) for x in raw]
    calibrated = [x * a + b for x, (a, b) in zip(raw, scales, strict=True)]
    both = fitted(np.stack([*calibrated, np.ones(len(y))], axis=1)).weights
    w, m = (model.weights.astype(float) for model in models)
    half = np.arange(len(y)) % 2 == 1  # of the documents kept apart, these measure what the others calibrate
    found = Classifier(w[:WORDS], w[WORDS:], m, *scales, tuple(map(float, both)), 0.5)
    right = [float(np.mean((p[half] >= 0.5) == (y[half] > 0.5))) for p in found.score(*raw)] if half.any() else []
    report = dict(zip(("text", "meta", "both"), right, strict=False)) | {"larger_class": float(max(y.mean(), 1 - y.mean())), "given": handed}
    return replace(found, report=report)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed: list[tuple[bytes, bytes, bytes]] = []
        for _, _, data, limits in text_slices(batch["_text"]):
            at, word, value, shape = text_features(data, limits)
            cuts = np.searchsorted(at, np.arange(len(shape) + 1))
            packed += [(word[a:b].astype("<i2").tobytes(), value[a:b].astype("<f4").tobytes(), s.astype("<f4").tobytes()) for a, b, s in zip(cuts[:-1], cuts[1:], shape, strict=True)]
        meta = meta_features(*(batch[c].to_pylist() for c in ("lang", "source", "n_chars")))
        columns = list(zip(*packed, strict=True)) if packed else [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.binary()) for c in columns), pa.array([m.astype("<i4").tobytes() for m in meta], pa.binary())], ["doc_id", "words", "values_", "shape", "meta"])


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), text_of(docs).alias("_text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def _raw_scores(batch: pa.RecordBatch, words: np.ndarray, shape: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views' scores of rows of features."""
    n = batch.num_rows
    joined = lambda c, kind: np.frombuffer(b"".join(batch[c].to_pylist()), kind)
    sizes = pc.binary_length(batch["words"]).to_numpy() // 2
    text = np.bincount(np.repeat(np.arange(n), sizes), joined("values_", "<f4") * words[joined("words", "<i2")], n)
    return text + joined("shape", "<f4").reshape(n, SHAPE) @ shape, meta[joined("meta", "<i4").reshape(n, 5)].sum(axis=1)


def _judge(models: list[Logistic]):
    text, meta = (m.weights.astype(float) for m in models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _raw_scores(batch, text[:WORDS], text[WORDS:], meta)
            bins = [np.round(sigmoid(x) * BINS).astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, bins)], ["doc_id", "p0", "p1"])

    return run


def _dense(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and metadata columns and labels of features, in an order that doesn't depend on how they came."""
    n = found.num_rows
    order_of = sorted(range(n), key=lambda i: (found["label"][i].as_py(), xxhash.xxh64_intdigest(found["words"][i].as_py()), found["meta"][i].as_py()))
    text, y = np.zeros((n, WORDS + SHAPE), dtype=np.float32), np.zeros(n, dtype=np.int64)
    cells = np.zeros((n, 5), dtype=np.int64)
    for i, j in enumerate(order_of):
        words, values, shape, meta = (found[c][j].as_py() for c in ("words", "values_", "shape", "meta"))
        text[i, np.frombuffer(words, "<i2")] = np.frombuffer(values, "<f4")
        text[i, WORDS:] = np.frombuffer(shape, "<f4")
        y[i], cells[i] = found["label"][j].as_py(), np.frombuffer(meta, "<i4")
    return text, _dense_meta(cells).astype(np.float32), y


def _one_row_an_id(features: DataFrame, chosen: DataFrame) -> pa.Table:
    """Label and features of the documents ``chosen(doc_id, label)``; of an id with several rows the least one, so there are no more than ids."""
    row = F.struct("label", "words", "values_", "shape", "meta")
    return features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(row).alias("r")).select("r.*").toArrow()


def _exchange(features: DataFrame, known: DataFrame, folder: str, pool: int, each: float = 0.05, confident: float = 0.9) -> Exchange:
    """Judges all unlabelled documents in a pass over ``features`` and takes the surest share of all of them.

    Of those at most ``pool`` are given to each view over all rounds, the ones of least id hash.
    Scores are whole numbers of 1 / BINS, so what reaches the driver is a count for each of them.
    """
    kind = dict(features.dtypes)["doc_id"]
    before: list[DataFrame | None] = [None, None]

    def run(turn: int, models: list[Logistic], share: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        judged = features.filter("doc_id IS NOT NULL").select("doc_id", "words", "values_", "shape", "meta").mapInArrow(_judge(models), f"doc_id {kind}, p0 int, p1 int")
        judged = stored(judged.join(known, "doc_id", "left_anti").groupBy("doc_id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1")), folder, f"judged-{turn}")
        out = []
        for k, p in enumerate(("p0", "p1")):
            counts = np.zeros(BINS + 1, dtype=np.int64)
            for at, n in judged.groupBy(p).count().collect():
                counts[at] = n
            wanted, most = each * counts.sum(), pool / ROUNDS
            low = min(int(np.searchsorted(np.cumsum(counts), max(1, wanted * (1 - share)))), int(BINS * (1 - confident)))
            high = max(BINS - int(np.searchsorted(np.cumsum(counts[::-1]), max(1, wanted * share))), int(np.ceil(BINS * confident)))
            sides = ((F.col(p) <= low, 0, max(1, int(most * (1 - share)))), (F.col(p) >= high, 1, max(1, int(most * share))))
            fresh = judged if before[k] is None else judged.join(before[k], "doc_id", "left_anti")
            chosen = None
            for side, verdict, n in sides:
                part = fresh.filter(side).select("doc_id", F.lit(verdict).cast("long").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
                chosen = part if chosen is None else chosen.unionByName(part)
            chosen = stored(chosen, folder, f"given-{turn}-{k}")
            before[k] = chosen.select("doc_id") if before[k] is None else before[k].unionByName(chosen.select("doc_id"))
            out.append(_dense(_one_row_an_id(features, chosen)))
        return out

    return run


def fit(features: DataFrame, labels: DataFrame, folder: str, *, label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> Classifier:
    """Fits on at most ``labelled`` documents with a label, those of least id hash, and on verdicts exchanged over all others.

    A document that is labelled more than once has the least of its labels; null labels count as
    absent. ``pool`` bounds the pseudo-labelled documents that a view is fitted on, not those judged.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("long").alias("label"))
    ids = features.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(known, "doc_id")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    return fit_views(*_dense(_one_row_an_id(features, chosen)), _exchange(features, known.select("doc_id"), folder, pool))


def _score(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw_scores(batch, model.words, model.shape, model.meta)
            text, meta, both = (np.round(p, 6) for p in model.score(*raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, (text, meta, both)), pa.array(both >= model.threshold)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return run


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores every document: doc_id, text_score, meta_score, score (probabilities) and kept.

    Null texts are empty, null metadata have values of their own; null ids and repeated rows are
    scored like others, of several rows of a labelled id one is fitted on. Rows of equal features
    have equal scores; a score at the threshold is kept. Without labels of both classes every score
    is 0.5 and all are kept. An empty table gives no rows. A text of any length is one row of hashed
    words. Texts are read once; their features are kept in the shared folder. Other columns are not
    read.
    """
    kind, folder = dict(docs.dtypes)["doc_id"], shared_folder(docs.sparkSession)
    features = stored(_prepared(docs).mapInArrow(_features, f"doc_id {kind}, words binary, values_ binary, shape binary, meta binary"), folder, "features")
    model = fit(features, labels, folder, **options)
    return features.mapInArrow(_score(model), f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")
