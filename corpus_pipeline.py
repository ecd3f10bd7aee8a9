"""A training corpus from raw documents: five stages, each written as Parquet and read again.

toxicity (toxic documents go), exact deduplication (one row of equal texts stays), SimHash
near-deduplication (one document of each group stays), pseudonyms for personal data, packing into
sequences of tokens.  All stages but the last return the columns of documents.

Cases.  Null and empty texts pass the classifier (they have no toxic word) and are copies of each other, so
one of them stays, and is packed as its end id.  Null ids lose against others; rows that repeat, also with
the same id, are copies like any.  An empty table gives no rows at any stage.  Further columns of documents
pass all stages but the last, whatever their names.  Texts of any length are read as a whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annotara.llm import exact_dedup, packing, pii, simhash_dedup, toxicity
from annotara.llm.common import stored, table, tune


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return simhash_dedup.near_dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pii.pseudonymise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), literal=False)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_dedup", near), ("pii", private), ("packing", packed)]

#: SQL can't express the classifier, the permutations or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
