"""A corpus pipeline over ``documents``: language, near-duplicates, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import stages
from quillgraph.session import cut

STAGES = [
    ("language_id", stages.known_language),
    ("near_duplicates", stages.one_of_each),
    ("decontamination", stages.without_leaks),
    ("personal_data", stages.without_personal_data),
    ("bpe", stages.as_tokens),
]

# Trained models, hashes of word windows and merges have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
