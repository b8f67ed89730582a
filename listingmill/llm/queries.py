"""The registered queries of this subpackage and, where SQL can express them, their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingmill.llm import centroids, decontam, hilbert, language_id, lexical, line_runs, ownership, pieces, planes, rules, simhash, substring, toxicity
from listingmill.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op4_bit_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.digest(spark, table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.digest(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sentencepiece,
        op3_simhash_near_dedup,
        op4_bit_plane_output,
        op5_substring_dedup,
        op6_hilbert_sharding,
        op7_toxicity,
        op8_secret_scan,
        op9_benchmark_decontamination,
        op10_quality_rules,
        op11_ranked_search,
        op12_line_dedup,
        op13_centroid_clustering,
    )
}
SQL = {
    "op8_secret_scan": ownership.SQL,
    "op5_substring_dedup": substring.SQL,
    "op9_benchmark_decontamination": decontam.SQL,
    "op10_quality_rules": rules.SQL,
    "op11_ranked_search": lexical.SQL,
    "op12_line_dedup": line_runs.SQL,
    "op13_centroid_clustering": centroids.SQL,
}
