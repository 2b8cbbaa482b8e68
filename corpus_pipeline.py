"""A corpus pipeline over `documents`: filter, deduplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
result is written to the shared folder and read again as the next stage's docs. All but the
last return the columns of `documents`. Rows with nulls, empty or very long texts, repeated
rows, extra columns and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldwise.llm import bpe, decontam, exact_dedup, quality, simhash
from foldwise.llm.common import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts (score of at least 0.3)."""
    return quality.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), accept=0.3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest doc_id."""
    return simhash.keep_first(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("quality", quality_filter), ("exact_dedup", exact_duplicates), ("simhash_dedup", near_duplicates),
          ("decontamination", decontamination), ("byte_bpe", tokenisation)]

#: A fitted ranking and BPE merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
