"""A training corpus from documents: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callweave.llm.bpe import read_ranks, token_digests
from callweave.llm.common import remove_folder, written
from callweave.llm.lang_id import filter_languages
from callweave.llm.mixing import take_documents
from callweave.llm.quality_rules import filter_quality
from callweave.llm.simhash import drop_near_duplicates

RANKS = "byte_bpe_multi_50k.tiktoken"


def from_files(docs: DataFrame) -> bool:
    """Stages read their rows from Parquet files; tests also hand over rows of their own."""
    return bool(docs.inputFiles())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_languages(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, from_files=from_files(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_documents(docs, weights=[3, 1, 2], share=1.5, max_repeats=2, from_files=from_files(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows come from Parquet files as the stage before left them, in the same order at each reading.
    return token_digests(docs, read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, stable=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.

    What a stage keeps is written to the shared checkpoint folder and read again, so that no
    stage runs twice and a lost executor costs its own tasks only. A table goes when the next one
    is written; the last stage reads its input lazily, which stays with the session's checkpoints.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, folder = written(stage(spark, docs, sf_dir), name)
        if before:
            remove_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
