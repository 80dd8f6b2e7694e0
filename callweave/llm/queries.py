"""Queries opN_<name> over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks, token_digests
from .common import table
from .lang_id import predict_languages
from .license_scan import scan_licenses
from .lm_scoring import score_by_labels
from .mixing import mix_counts
from .oracles import ORACLES
from .prefix_trie import prefix_trie
from .quality_mil import score_quality
from .quality_rules import quality_verdicts
from .rotated_codes import nearest_vectors
from .simhash import near_duplicates
from .spelling import spelling_variants
from .spherical import near_vectors
from .url_filter import judge_urls

#: The rules that op1 applies.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, as the SQL has them."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 6) for c in columns})


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_by_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rounded(scored, "loss_target", "loss_background", "loss_difference")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mix_counts(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, max_repeats=2), "target")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scan_licenses(table(spark, sf_dir, "documents")), "dice")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, stable=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_embedding_near_dedup, op3_quality_classifier, op4_lm_scoring, op5_source_mix, op6_simhash_near_dedup, op7_language_id, op8_quality_rules, op9_license_scan, op10_byte_bpe, op11_spelling_variants, op12_prefix_trie, op13_nearest_neighbours)}
