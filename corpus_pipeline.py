"""The training-data pipeline: five operators, each on all that the one before it kept.

Language ID and quality drop documents, SimHash keeps one document of each near-duplicate group,
substring dedup cuts repeated passages out of the texts, packing lays the rest out in sequences.
Every stage is written as Parquet to the shared folder and read again before the next one starts,
so a lost executor costs at most one stage's running tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bestfit_packing, language_id, quality_fm, queries, simhash_pivot, substring_cover
from lectern.llm.common import Scratch, read_table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined (texts without a letter go)."""
    return language_id.keep_known(docs, queries.language_model(docs))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the operator's threshold."""
    return quality_fm.keep_good(docs, queries.quality_model(spark, docs, sf_dir))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 3 or fewer bits (3-word shingles)."""
    return simhash_pivot.drop_near_duplicates(docs, shingle=3, k=3)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that also start in a document with a smaller id."""
    return substring_cover.remove_repeats(docs, window=50)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens."""
    return bestfit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", stage_language), ("quality", stage_quality), ("near_duplicates", stage_near_duplicates),
          ("substrings", stage_substrings), ("packing", stage_packing)]

#: Trained models and a public tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch(name, stage(spark, docs, sf_dir))
    return docs
