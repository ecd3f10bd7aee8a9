"""The queries of this folder, one per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, packing, pii, quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_files, toxicity
from .common import table, tune


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(table(spark, sf_dir, "documents"), _vocabulary(token_files.VOCABULARY), literal=False)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary(packing.VOCABULARY), literal=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.query(table(spark, sf_dir, "documents"), _vocabulary(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.query(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.query(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_token_files, op3_pii, op4_suffix_dedup, op5_quality_rules, op6_secret_scan, op7_packing, op8_byte_bpe, op9_simhash_dedup, op10_exact_dedup, pipeline]

    def tuned(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: tuned(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.SQL}
