"""A cleaning pipeline over ``documents``: each stage is one operator, written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``; the last returns token
counts and digests. ``run`` writes between stages to the cluster's shared scratch folder.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logcase.llm import bpe_chunks, decontaminate, line_dedup, near_dup, quality_rules
from logcase.llm.common import configure, table
from logcase.llm.registered import VOCABULARY
from logcase.plans.sizing import materialize


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality_rules.clean_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return line_dedup.clean_documents(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return near_dup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return bpe_chunks.token_counts(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-pair encoding", encoding_stage),
]

#: Byte-pair encoding has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
