"""Tests of jobs that once were done in part."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline import queries as core
from plumbline.llm import bpe, cotraining, packing, secret_markov

from .conftest import DOCS, prose


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_the_pipeline_drops_what_is_alike_by_five_words(spark):
    r = random.Random(8)
    texts = []
    for i in range(40):
        words = prose(500 + i, 300).split()
        texts.append(" ".join(words))
        for edits in (4, 5, 6, 9, 14, 30):
            copy = words.copy()
            for at in r.sample(range(len(copy)), edits):
                copy[at] = "zz" + copy[at]
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if i // 7 == j // 7 and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert len(set(root)) > 120
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)
    left = {x["doc_id"] for x in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert left == set(root)


def test_packing_takes_the_ids_of_added_tokens(spark):
    texts = ["hi <|endoftext|> there", "<|endoftext|><|endoftext|>\n x", "a<|endoftext|", " <|endoftext|>"]
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert want[0] == [5303, 220, 50256, 612, 2]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_split_names_keeps_all_parts_and_digits(spark, tmp_path):
    spark.createDataFrame([(7, "a b", 1), (10000, "c d", 2), (100000, "e f", 3), (1234567, "g h", 4)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["frame"] for r in core.split_names(spark, str(tmp_path)).collect()}
    assert got == {i: f"{i:05d}" for i in (7, 10000, 100000, 1234567)}


def test_co_training_learns_words_that_few_unlabelled_documents_have(spark):
    """A source of which no document is labelled and none is among the unlabelled ones of least id hash."""
    ids = [x["id"] for x in spark.range(800).orderBy(F.xxhash64("id"), "id").collect()]
    data, labels = [], []
    for n, i in enumerate(ids):
        good = i % 2 == 0
        text = prose(i, 60)
        late = n >= 600
        source = ("new" if late else "site") if good else ("odd" if late else "spam")
        data.append((i, text if good else " ".join(w + "%%%" for w in text.split()), "en", source, 400))
        if n < 300:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(data, DOCS)
    got = {r["doc_id"]: r["meta_score"] for r in cotraining.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), pool=250).collect()}
    new, odd = (np.mean([got[d[0]] for d in data if d[3] == s]) for s in ("new", "odd"))
    assert new > odd + 0.05


def test_small_tables_are_packed_by_one_task(spark, tmp_path):
    spark.createDataFrame([(i, f"line {i}") for i in range(4)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    assert packing.pack_documents(spark.read.parquet(f"{tmp_path}/d")).select("sequence_id").distinct().count() == 1


def test_rare_ordinary_transitions_of_a_large_corpus_count(spark, monkeypatch):
    size = secret_markov.SIZE
    monkeypatch.setattr(secret_markov, "built_in_samples", lambda: np.full((2, size + 1, size), 1e-3))
    docs = spark.createDataFrame([("qu" * 500_000 + " " + "qx " * 3000,)], "text string")
    ratio = secret_markov.train(docs).ratio
    a, b = (secret_markov.ALPHABET.index(c) for c in "qx")
    # an ordinary transition of 0.6 % against one of 1 / SIZE in random strings, of which there are none
    assert abs(ratio[a + 1, b] - np.log((1 / size) / (3000 / 503_000))) < 0.3


def test_blocks_of_a_key_meet_as_the_whole_key_does(spark, monkeypatch):
    """A family in which the least text of a key is unlike most: found in blocks of any size."""
    from plumbline.llm import near_copies

    r = random.Random(12)
    base = prose(900, 200).split()
    texts = []
    for k in range(24):
        copy = base.copy()
        for at in r.sample(range(len(copy)), 3 + k % 6):
            copy[at] = f"zz{k % 4}{copy[at]}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    left = []
    for block in (2, 512):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        left.append({x["doc_id"] for x in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert left[0] == left[1] == set(root)
