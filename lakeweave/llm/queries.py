"""The registered queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, language_id, license_scan, mixing, near_dedup, quality, sharding, token_output, url_filter
from .oracle import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, threshold=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.training_order(_table(spark, sf_dir, "documents"), tokenizer=tokenizer())


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern of the production tokenizer; the file is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), *tokenizer()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_near_dedup, op3_url_filter, op4_nearest, op5_training_order, op6_byte_bpe, op7_language_id, op8_quality_rules, op9_license_scan, op10_external_shuffle)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
