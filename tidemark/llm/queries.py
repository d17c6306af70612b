"""The corpus operators as queries over the tables of one data folder, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, line_dedup, neardup, phrases, quality_classifier, quality_rules, runs, secrets, shards, token_rollup, weighted_sampling
from .common import scratch, table

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents"))


def op2_quality_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op3_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {name: public_tokenizers.path(f"{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    return token_rollup.maintain(spark, table(spark, sf_dir, "documents"), scratch(spark), versions, public_tokenizers.PATTERN)


def op6_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), neardup.plan(shingle=3, num=85, den=100))


def op7_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_pair_named_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def op13_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_quality_boosted_rules": op2_quality_boosted_rules,
    "op3_line_site_spread": op3_line_site_spread,
    "op4_kneser_ney_language": op4_kneser_ney_language,
    "op5_token_rollups": op5_token_rollups,
    "op6_hamming_near_duplicates": op6_hamming_near_duplicates,
    "op7_bpe_merge_replay": op7_bpe_merge_replay,
    "op8_quality_discriminant": op8_quality_discriminant,
    "op9_benchmark_windows": op9_benchmark_windows,
    "op10_secret_forest": op10_secret_forest,
    "op11_pair_named_phrases": op11_pair_named_phrases,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_weighted_fingerprints": op13_weighted_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_site_spread": line_dedup.REPORT_SQL,
    "op6_hamming_near_duplicates": neardup.LINK_SQL,
    "op9_benchmark_windows": decontaminate.REPORT_SQL,
    "op11_pair_named_phrases": phrases.COLLOCATIONS_SQL,
}
