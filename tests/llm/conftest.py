from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    """Ordinary, copied, nearly copied, empty, null, short, very long and repeated documents."""
    shared = prose(1, 60)
    texts = [
        prose(2, 120),
        prose(3, 80) + " " + shared + " " + prose(4, 50),
        prose(5, 90) + "\n" + shared + "\n" + prose(6, 40),
        prose(7, 200),
        prose(7, 200),
        prose(7, 199) + " zzz",
        "",
        None,
        " \n\t ",
        "one",
        "The of and. " * 80,
        prose(8, 70) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(9, 30),
        "déjà vu 漢字 𝒳 " + prose(10, 60),
        prose(11, 30_000),
    ]
    out = [(i, t, ["en", None][i % 2], f"src{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(texts)]
    out += [(None, prose(12, 100), None, None, None), (None, prose(12, 100), None, None, None), (3, texts[3], "en", "src0", 5), (20, prose(7, 200), "en", "src0", 5), (20, prose(7, 200), "en", "src0", 5)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


#: Names that the operators use inside.
CLASHES = ("bucket", "_text", "spans", "kept", "measures", "fp", "text_hash", "_text_hash", "_row", "doc", "id", "group", "n_words", "task", "part", "dotted.name")


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))
