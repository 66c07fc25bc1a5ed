"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, suffix-array dedup and best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, language, packing, simhash, suffixes
from tessera.llm.common import discard, stored, table, written
from tessera.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (no text, no letter, or a score below 0.25); lang becomes the predicted one."""
    return language.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of largest doc_id of every text."""
    return exact.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near copies."""
    return simhash.kept_rows(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of texts that stand in an earlier document already; n_chars follows the text."""
    out = suffixes.clean(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences of 4096."""
    return packing.pack(docs, vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # language profiles, fingerprints and packing have no SQL form; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        discard(spark, docs, start)  # what the stage read and what it wrote on the way
    return docs
