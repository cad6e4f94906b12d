"""A training corpus from documents: quality rules, language ID, near-dedup, mixing, byte-level BPE.

Each stage takes what its predecessor kept, as written to Parquet and read again. All stages take texts whole, give an
empty table for an empty one, and carry columns of any name (the last one ignores them); what holds for nulls, ties and
repeated rows is stated by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import bpe, language_id, mixing, near_dedup, quality
from lakeweave.llm.queries import tokenizer
from lakeweave.llm.store import keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the suffix-array limits keep. Null, empty and short texts go; repeated rows are judged alike."""
    return quality.quality_filter(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the documents themselves teach.

    Null texts, texts without a letter and cosines below the threshold go; of equal cosines the first language counts;
    without any labelled row all go; repeated rows are judged alike.
    """
    return language_id.language_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets at a similarity of 0.8 or more: that of the smallest key.

    Rows without words (null or empty texts) all stay; of repeated rows one stays; null keys come after all others.
    """
    return near_dedup.near_filter(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: null sources are a source, rows without words are not taken, rows of one key go together."""
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and of the bytes decoded from them. A null text counts as empty; repeated rows are coded each."""
    coded = bpe.encode_decode(docs, *tokenizer())
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Suffix arrays, prototypes and merges are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
