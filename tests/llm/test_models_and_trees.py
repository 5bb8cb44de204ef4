"""SentencePiece by prefixes, dataset manifests and bounded clustering against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import dataset_manifest, hamerly, prefix_pieces

MODEL = prefix_pieces.default_model()

# SentencePiece


def library(text: str) -> list[int]:
    return prefix_pieces._library(MODEL).encode(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n▁aábcdethin'<0x>А中文😀\x00�#=") | st.characters(codec="utf-8"), max_size=60))
def test_ids_are_the_librarys(text):
    assert prefix_pieces.encode(MODEL, text) == library(text)


def test_pieces_put_together_at_random():
    r, names = random.Random(5), list(prefix_pieces.pieces(MODEL).ids)
    for _ in range(3000):
        text = "".join(r.choice(names) for _ in range(r.randint(1, 25)))
        assert prefix_pieces.encode(MODEL, text) == library(text)


@pytest.mark.parametrize("text", [" " * 300_001, "\n" * 200_000, "a" * 100_001, "ab" * 100_000, "中" * 50_000, "x" + " \n" * 100_000 + "y", "▁" * 1001, "\x00" * 500])
def test_very_long_runs(text):
    assert prefix_pieces.encode(MODEL, text) == library(text)


def test_each_prefix_has_the_last_token_of_its_own_encoding():
    own = prefix_pieces.pieces(MODEL)
    text = "▁unbelievablyinterestingcharacterisation"
    lengths, codes = own.last_tokens(text)
    for end in range(1, len(text) + 1):
        last = own.merged(text[:end])[-1]
        assert lengths[end] == len(last) and own.token(codes[end - 1]) == last


def test_memos_that_overflow_change_nothing():
    own = prefix_pieces.Pieces(MODEL)
    own.compatible.most = own.segment_ids.most = own.word_ids.most = 3
    text = "the quick brown fox jumps over the lazy dog, then naps; " * 20
    assert own.encode(text) == library(text)
    assert len(own.segment_ids) <= 3 and len(own.word_ids) <= 3 and len(own.compatible) <= 3


def test_documents_round_trip(spark):
    data = [(1, "some text"), (1, "some text"), (None, " two  spaces\n"), (2, None), (3, ""), (4, "\U00013000 naïve 日本"), (5, " ")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in data], "doc_id long, text string, `ids` string, `n.tokens` int")
    encoded = prefix_pieces.encode_documents(docs)
    want = Counter((i, tuple(library(t or ""))) for i, t in data)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    assert Counter(tuple(r) for r in prefix_pieces.decode_documents(encoded).collect()) == Counter((i, prefix_pieces._library(MODEL).decode(library(t or ""))) for i, t in data)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = Counter((i, len(k := library(t or "")), sha(",".join(map(str, k))), sha(prefix_pieces._library(MODEL).decode(k))) for i, t in data)
    assert Counter(tuple(r) for r in prefix_pieces.round_trip(docs).collect()) == digests
    assert prefix_pieces.round_trip(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert prefix_pieces.decode_documents(nothing).first()["text"] == ""


# manifests


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row: tuple) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(hashes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf what is left and right of it, level by level."""
    paths, at, nodes = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            paths[leaf].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        nodes, at = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], paths


def plain_audit(rows: list[tuple]) -> Counter:
    """rows: doc_id, source, lang, n_chars, text."""
    trees, out = defaultdict(list), Counter()
    for r in rows:
        changed = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        other = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4]
        trees[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), plain_leaf((*r[:4], other))))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = [plain_tree([x[2] for x in sorted(trees[s])]) for s in sources]
    root, above = plain_tree([b[0] for b in below])
    for s, (subroot, paths), over in zip(sources, below, above, strict=True):
        for (known, key, leaf, seen), path in zip(sorted(trees[s]), paths, strict=True):
            h = seen
            for left, right in path + over:
                h = sha(left, h, right)
            out[(key if known else None, leaf, subroot, root, sha(*(x for step in path + over for x in step)), h, h == root)] += 1
    return out


def manifest_rows() -> list[tuple]:
    r = random.Random(8)
    out = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(700)]
    out += [(1000 + i, f"site{i}", None, None, "A" * r.randint(0, 9)) for i in range(40)]
    out += [(2000 + i, "sixteen", "de", 1, "lower é") for i in range(16)] + [(2100 + i, "seventeen", "de", 1, "Up") for i in range(17)]
    out += [(None, "hot", None, None, None), (None, None, None, None, "X"), (3, None, "", 0, ""), (3, "hot", "en", 3, "Text 3"), (3, "hot", "fr", 3, "Other"), (5000, "Ä", "en", 1, "Z" * 100_000), (5001, "", "en", 1, None)]
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_equals_a_plain_one(spark):
    data = manifest_rows()
    docs = spark.createDataFrame([(*r, "a", 1) for r in data], FIELDS + ", leaf string, `tree.x` int").repartition(5)
    got = dataset_manifest.audit(docs).collect()
    assert Counter(tuple(r) for r in got) == plain_audit(data)
    assert 0 < sum(not r["verified"] for r in got) < len(data)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_around_a_full_run(spark, n):
    data = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert Counter(tuple(r) for r in dataset_manifest.audit(spark.createDataFrame(data, FIELDS)).collect()) == plain_audit(data)


def test_no_documents_have_no_manifest(spark):
    assert dataset_manifest.audit(spark.createDataFrame([], FIELDS)).count() == 0


def test_one_changed_value_changes_the_root(spark):
    data = manifest_rows()[:300]
    roots = set()
    for k in range(5):
        row = list(data[7])
        row[k] = {0: 9999, 1: "elsewhere", 2: None, 3: 1 << 40, 4: "Text 7 "}[k]
        found = dataset_manifest.proofs(dataset_manifest.leaves(spark.createDataFrame([*data[:7], tuple(row), *data[8:]], FIELDS)))
        roots |= {r["root"] for r in found.select("root").distinct().collect()}
    assert len(roots) == 5


# clustering


def plain_clusters(data: list[tuple], clusters: int = 16, rounds: int = 3) -> Counter:
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)[:clusters]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]  # noqa: B023
        if n < rounds:
            for c in range(len(centroids)):
                if members := [v for (_, v), k in zip(kept, own, strict=True) if k == c]:
                    centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    d = [far(v, centroids[c]) for (_, v), c in zip(kept, own, strict=True)]
    of = Counter()
    for c, x in zip(own, d, strict=True):
        of[c] += x
    return Counter((i, c, x, of[c], sum(d), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, x in zip(kept, own, d, strict=True))


def vectors(n: int, seed: int = 2) -> list[tuple]:
    r = np.random.default_rng(seed)
    middles = r.normal(0, 1, (12, 64))
    return [(i, [float(np.float32(x)) for x in middles[i % 12] + r.normal(0, 0.15, 64)]) for i in range(n)]


def test_clusters_equal_plain_rounds(spark):
    data = vectors(400)
    data += [(7, data[7][1]), (7, data[8][1]), (None, data[9][1]), (500, None), (501, [0.5] * 63), (502, [0.5] * 63 + [None]), (503, [float("nan")] * 64), (504, [0.5] * 63 + [float("-inf")]), (505, []), (506, [-0.001] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, cluster string").repartition(3)
    assert Counter(tuple(r) for r in hamerly.cluster(df).collect()) == plain_clusters(data)
    assert hamerly.cluster(df.limit(0)).count() == 0


def test_ties_and_equal_seeds(spark):
    r = random.Random(3)
    data = [(i, [float(r.choice([0, 1, 2])) if k < 3 else 0.0 for k in range(64)]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert Counter(tuple(x) for x in hamerly.cluster(df).collect()) == plain_clusters(data)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    data = vectors(n)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert Counter(tuple(x) for x in hamerly.cluster(df).collect()) == plain_clusters(data)


def test_bounds_spare_scans_and_hold(spark):
    df = spark.createDataFrame(vectors(600), "vec_id long, embedding array<float>")
    history: list = []
    state, centroids = hamerly.fit(df, history=history)
    assert history[0][1] == history[0][0] and all(h[1] < 0.7 * h[0] for h in history[2:])
    x = np.array([r["x"] for r in state.select("x", "cluster", "upper", "lower").collect()])
    rows = state.select("x", "cluster", "upper", "lower").collect()
    d = np.sqrt(((x[:, None, :] - centroids[None]) ** 2).sum(axis=2))
    for row, distances in zip(rows, d, strict=True):
        assert distances[row["cluster"]] <= row["upper"]
        assert np.delete(distances, row["cluster"]).min() >= row["lower"]


def test_bounds_hold_over_random_moves():
    r = np.random.default_rng(4)
    x = r.integers(-50, 50, (500, 5))
    centroids = r.integers(-50, 50, (7, 5))
    state = (np.full(500, -1), np.full(500, np.inf), np.zeros(500))
    drift = np.zeros(7)
    for _ in range(12):
        *state, _ = hamerly.assign(x, *state, centroids, drift)
        d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        new = centroids + r.integers(-3, 4, centroids.shape)
        drift, centroids = hamerly.moved_by(centroids, new), new


def test_large_components(spark):
    data = [(i, [float(v)] + [0.0] * 63) for i, v in enumerate([2**20, -(2**20), 2**20 - 1, 0, 5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert Counter(tuple(x) for x in hamerly.cluster(df, clusters=2).collect()) == plain_clusters(data, 2)
    with pytest.raises(Exception, match="must lie under"):
        hamerly.cluster(spark.createDataFrame([(1, [2.0**21] * 64)], "vec_id long, embedding array<double>")).collect()


def test_the_wide_columns_are_not_shuffled(spark):
    docs = spark.createDataFrame(manifest_rows()[:50], FIELDS)
    plan = dataset_manifest.leaves(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
