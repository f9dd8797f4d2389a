"""A training-data pipeline over ``documents``: five stages, each on what the one before kept.

Every stage takes empty tables, null ids, rows that repeat and further columns, which it passes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, langid, mixing, secrets, simhash
from foliant.llm.common import discard, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known well enough, as they are; null texts and texts without a letter go."""
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike at 0.8 in five-word shingles; all texts without words are one group."""
    return simhash.one_of_each(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null texts stay, and all rows if there is no item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in the text replaced; null and empty texts stay as they are."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as they are, with ``copies``; equal rows come once with the copies of all."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_test_items),
    ("secret_scan", mask_secrets),
    ("mix_to_weights", mix_sources),
]

#: The stages train a model and sample: SQL can't express them. tests/llm/test_contracts.py holds each stage's rows against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
