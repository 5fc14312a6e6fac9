"""A training corpus from `documents`: language ID, exact dedup, near dedup,
mixing to target weights, packing. Each stage is written as Parquet and read
again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import bounded_batches, staged, table
from ledgerline.llm.curriculum import mixed_documents
from ledgerline.llm.exact_dedup import drop_copies
from ledgerline.llm.language_id import keep_languages
from ledgerline.llm.order_minhash import drop_near
from ledgerline.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter at all, or null) go."""
    bounded_batches(spark)
    return keep_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    bounded_batches(spark)
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language inference, order sketches and tokens are beyond SQL; tests compare
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
