"""A corpus from raw documents to packed training sequences.

The stages run in order, each over all that the one before kept; every result is written as Parquet to
the cluster's shared folder and read again. A stage that filters returns the columns of ``documents``;
the last one returns the pieces and their places. An empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fonotrama.llm import common, langid, neardup, packing, quality, secretscan


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles of the languages that ``lang`` names; documents in none of them go."""
    return langid.keep_known(docs, langid.fit(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id."""
    return neardup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark; ``n_chars`` is counted anew."""
    masked = secretscan.redact(docs, secretscan.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]
#: SQL can't express the classifiers and signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.settle(docs)
    return docs
