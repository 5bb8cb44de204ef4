"""Runs of white space of a million characters and more, and how many sequences packing takes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import bpe, chunked_bpe, packing, quality_rules, secret_markov
from tests.llm.conftest import prose

PIECES = ["a", "Zé", "12", " ", "  ", "\n", "\t \n", "<|endoftext|>", "'s", "　", "\x1c", "!", " ", "   \n "]
RUNS = {"spaces": "word " * 100 + " " * 1_000_000 + "x", "newlines": "\n" * 2_000_000, "mixed": prose(1, 50) + " \n\t" * 400_000 + prose(2, 50) + "\n" * 900_000, "before an added token": " " * 900_000 + "<|endoftext|> \n"}


def library() -> Tokenizer:
    return Tokenizer.from_file(bpe.default_tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20), st.integers(2, 5))
def test_cut_runs_have_the_librarys_ids(parts, least):
    text = "".join(parts)
    assert bpe.encode(bpe.json_encoding(bpe.default_tokenizer()), text, special=True, least=least).tolist() == library().encode(text, add_special_tokens=False).ids
    ranks = bpe.rank_encoding(bpe.default_ranks())
    assert bpe.encode(ranks, text, least=least).tolist() == ranks.encode_ordinary(text)


@pytest.fixture(scope="module")
def long(spark):
    data = [(i, t) for i, t in enumerate(RUNS.values())] + [(9, "plain text")]
    return spark.createDataFrame(data, "doc_id long, text string").repartition(2), data


def test_packing_takes_very_long_runs(long):
    df, data = long
    want = Counter()
    for i, text in data:
        ids = np.array([*library().encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        ends = range(len(ids), 0, -1024)
        for piece, end in enumerate(reversed(ends)):
            part = ids[max(0, end - 1024) : end]
            want[(i, piece, max(0, end - 1024), len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack_documents(df).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(tuple(r) for r in got) == want


def test_chunks_take_very_long_runs(long):
    df, data = long
    got = {r["doc_id"]: r for r in chunked_bpe.round_trip(df).collect()}
    ranks = bpe.rank_encoding(bpe.default_ranks())
    for i, text in data:
        ids = bpe.encode(ranks, text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_rules_and_scans_take_very_long_texts(spark, long):
    df, data = long
    df = df.unionByName(spark.createDataFrame([(20, prose(5, 150_000)), (21, "a" * 1_000_000)], "doc_id long, text string"))
    rules = {r["doc_id"]: r["measures"] for r in quality_rules.apply_rules(df).collect()}
    assert rules[1]["n_words"] == 0 and rules[20]["n_words"] == 150_000 and rules[21]["word_chars"] == 1_000_000
    assert secret_markov.scan(df).count() == len(data) + 2


@pytest.mark.parametrize("bins", [packing.OPEN_BINS, 256])
def test_sequences_are_near_the_sum_of_lengths(spark, bins):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, prose(i, r.randint(3, 250))) for i in range(1200)], "doc_id long, text string").coalesce(1)
    found = packing.pack_documents(docs, open_bins=bins).select("sequence_id", "length", "offset").collect()
    least = -(-sum(r["length"] for r in found) // 1024)
    assert len({r["sequence_id"] for r in found}) <= least * 1.01 + 1
    at = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 1024
