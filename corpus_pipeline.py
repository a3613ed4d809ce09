"""The training-data pipeline over documents: score, deduplicate, strip repeats, redact, pack.

Defined results, stage by stage, beside what the operators' docstrings state: a null, empty or wordless text is rejected by the
first stage; rows with a null id are never taken for near-duplicates and pass all stages; rows that repeat an id and its
text are one after the second stage; a text that loses all its bytes stays as an empty text; ties (equal texts) keep the smallest
id; other columns, whatever their names, pass all stages but the last; no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common, packing, pii, quality, simhash, suffix


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filtered(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return simhash.representatives(docs, words=5, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 200 bytes that is also elsewhere goes from all its places."""
    return recounted(suffix.without(docs, length=200))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return recounted(pii.without(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 1,024."""
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("suffix_array", suffix_stage), ("pii", pii_stage), ("packing", packing_stage),
]
#: Learned scores, sketches and suffix orders are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        made = common.written(stage(spark, docs, sf_dir))
        common.dropped(docs)
        docs = made
    return docs
