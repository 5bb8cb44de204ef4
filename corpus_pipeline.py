"""Raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept. All but the last return the columns of documents, of
whatever names, with their values; only text and n_chars change. Null ids and repeated rows are rows
like others, a null text is an empty one, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import near_copies, packing, quality_rules, secret_markov, substring_dedup
from plumbline.llm.common import shared_folder, stored

#: No SQL: fingerprint components, Markov models and best-fit bins have none; the stages are tested against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """The same columns, n_chars as the changed text has it; a table without n_chars gets none."""
    length = F.length("text").cast("long")
    return docs.select(*((length if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all quality rules."""
    return quality_rules.only_kept(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest doc_id.

    Linked are texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return near_copies.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur elsewhere too; one may be left empty."""
    return _counted(substring_dedup.without_repeated(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return _counted(secret_markov.masked(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir; each stage but the last is written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, folder, f"stage-{k}")
    return docs
