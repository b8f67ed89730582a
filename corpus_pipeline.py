"""The training-data pipeline: stages over ``documents``, each reading what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingmill.llm import decontam, ownership, pieces, simhash, toxicity
from listingmill.llm.common import table
from listingmill.session import materialize, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The classifier learns from the labelled rows of ``docs``."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-copies the document with the smallest id stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets that are no copied examples are masked in its text."""
    return ownership.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ``ids``, the text decoded from them and whether that is the text."""
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("sentencepiece", tokenize),
]
#: The stages hash, train and tokenize, which SQL cannot express; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), shared_dir(spark, f"stage-{name}"))
    return docs
