"""The queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import ann, contamination, exact, license, negatives, packing, variants
from caseloom.llm.bpe import bpe_round_trip
from caseloom.llm.hmm import language_scores
from caseloom.llm.jaccard import jaccard_groups
from caseloom.llm.quality import quality_scores
from caseloom.llm.suffix import remove_repeats
from caseloom.llm.toxic import toxicity_scores

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: the vocabulary of byte_bpe_50k.json as ranks
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), MULTI_RANKS)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), RANKS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(variants.vocabulary(_table(spark, sf_dir, "documents")))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_ngram_jaccard_join, op3_byte_bpe, op4_nearest_neighbours, op5_license_scan,
        op6_quality_classifier, op7_suffix_array_dedup, op8_toxicity, op9_lm_scoring, op10_packing,
        op11_spelling_variants, op12_benchmark_decontamination, op13_hard_negatives,
    )
}

SQL: dict[str, str] = {
    "op1_exact_dedup": exact.SQL,
    "op4_nearest_neighbours": ann.SQL,
    "op5_license_scan": license.oracle_sql(),
    "op11_spelling_variants": variants.SQL,
    "op12_benchmark_decontamination": contamination.SQL,
    "op13_hard_negatives": negatives.SQL,
}
