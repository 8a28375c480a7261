"""The driver-facing queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_recipes, common, decontaminate, hpylm, langid, packing, simhash, suffix_dedup, url_filter, wavelet, weak_labels


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return chunk_recipes.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def op5_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(common.read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(common.read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(common.read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.judge(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_pitman_yor, op2_url_filter, op3_chunk_recipes, op4_hierarchical_packing, op5_column_suffix_dedup, op6_wavelet_matrix, op7_weak_supervision, op8_qgram_decontamination, op9_simhash_pigeonhole, op10_language_id)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_chunk_recipes": chunk_recipes.ORACLE_SQL, "op5_column_suffix_dedup": suffix_dedup.ORACLE_SQL}
