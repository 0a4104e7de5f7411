"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next one's ``docs``, so a
lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafold.llm import bpe, decontaminate, line_quality, near_duplicates, secrets
from stratafold.llm.catalog import table, tokenizer_path
from stratafold.session import shared_dir


def _recounted(docs: DataFrame, names: list[str]) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it."""
    counted = docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in names else docs
    return counted.select(*names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; template lines leave the texts of the others."""
    return _recounted(line_quality.clean_documents(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark contaminates go; the others are unchanged."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    return _recounted(secrets.redact(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, their number, and the digest of the decoded text."""
    return bpe.encode_decode(docs, tokenizer_path(), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("bpe", tokens),
]
#: Trained models, hashed sketches and byte-pair merges cannot be written as SQL; the tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
