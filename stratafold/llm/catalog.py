"""Registered queries: each operator over the whole of its table, digests derived from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafold.llm import (
    alignment, bpe, decontaminate, language_id, licenses, line_quality, main_text, near_duplicates, secrets, signature_join, toxicity,
    warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.train(documents))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), wanted)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_verdicts(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    wanted = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.read_records(spark, archive).select(*wanted)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", named, "contaminated")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.similar_rows(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Query]:
    named = [
        op1_language_id, op2_bpe, op3_main_text, op4_line_quality, op5_warc, op6_decontaminate, op7_near_duplicates, op8_secrets, op9_licenses,
        op10_toxicity, op11_whitening, op12_alignment, op13_signature_join,
    ]
    return {query.__name__: query for query in named}
