"""Content-addressed WARC archive.

Three tables: payload bytes, stored once per SHA-256; exact record headers, one row per record,
which name their payload by digest; nothing else. A full record is header, payload and the two
closing line ends, put together by a join on the digest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratafold.operators.lookup import lookup_join
from stratafold.session import shared_dir

#: Payloads of fewer bytes never make a revisit record.
LEAST_REVISIT_BYTES = 1000
_END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """The folders of one archive."""

    headers: str
    payloads: str

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.read.parquet(self.headers), spark.read.parquet(self.payloads)


def _header(kind: Column, page_id: Column, url: Column, length: Column, sha1: Column, refers: Column) -> Column:
    """The exact header text of a record, with the empty line that ends it.

    The URI is percent-encoded where it holds spaces or control characters, so that no url can
    forge a header line.
    """
    number = F.coalesce(page_id.cast("string"), F.lit("none"))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END))


def write_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    """Archive every row of ``pages`` (``page_id``, ``url``, ``html``) and return where.

    A missing html is an empty payload, a missing url an empty URI. Of equal payloads of at least
    ``LEAST_REVISIT_BYTES`` the record with the largest page_id is the response and the others
    revisit it; a repeated row with that page_id is a response again, a missing page_id revisits.
    If no equal payload has a page_id, all are responses. Other columns are not read.

    Payloads: partial aggregation by digest keeps one copy per task before the shuffle, so copies
    held by a third of all rows travel once per task. Headers: the response of a digest is looked
    up only for digests that occur twice or more, by a broadcast of measured size or a shuffle join
    that splits hot digests.
    """
    spark = pages.sparkSession
    base = f"{folder or shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive = Archive(f"{base}/headers", f"{base}/payloads")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    hashed = rows.select(
        "page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )
    narrow = spark_table(hashed, f"{base}/narrow")
    large = F.col("payload_bytes") >= LEAST_REVISIT_BYTES
    copies = narrow.where(large).groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    shared = copies.where("n > 1 AND response_id IS NOT NULL").select("sha256", "response_id")
    shared = spark_table(shared, f"{base}/shared")
    found = lookup_join(narrow, shared, {"sha256": F.col("sha256")}, population=narrow, spread="page_id")
    is_revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    headers = found.withColumn("refers_to", F.when(is_revisit, F.col("response_id"))).select(
        "page_id", "url", "sha256",
        _header(
            F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), F.col("page_id"), F.col("url"),
            F.col("payload_bytes"), F.col("sha1"), F.col("refers_to"),
        ).alias("header"),
    )
    headers.write.option("compression", "zstd").parquet(archive.headers)
    bodies = rows.select(F.sha2("payload", 256).alias("sha256"), "payload")
    once = bodies.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def spark_table(df: DataFrame, path: str) -> DataFrame:
    """Write once, read often: later plans start from files."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def verified_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads with length and SHA-1 taken anew from the stored bytes, and whether they still have
    the digest they are filed under."""
    return payloads.select(
        "sha256", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), (F.sha2("payload", 256) == F.col("sha256")).alias("intact"),
    )


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per archived record, joined from headers and payloads.

    ``record`` is the whole WARC record in bytes; the other columns are parsed back from the header
    text or taken from the stored payload. A damaged payload, or one that disagrees with its header,
    raises an error. Only the columns that are used travel: without ``record`` and ``payload`` the
    join moves digests and lengths.
    """
    headers, payloads = archive.read(spark)
    checked = verified_payloads(payloads)
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1)
    digest = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1)
    parsed = headers.select(
        "page_id", "url", "sha256", "header", field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("bigint").alias("refers_to"),
        digest.alias("stated_digest"), field("Content-Length").cast("bigint").alias("stated_bytes"),
    )
    joined = parsed.join(checked, "sha256", "left")
    good = (
        F.col("intact") & (F.col("stated_digest") == F.col("payload_digest"))
        & (F.col("stated_bytes") == F.col("payload_bytes"))
    )
    proven = F.when(F.coalesce(good, F.lit(False)), F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("damaged or missing payload "), F.col("sha256"))).cast("bigint")
    )
    end = F.encode(F.lit(_END + _END), "UTF-8")
    return joined.select(
        "page_id", "url", "header", "payload", proven.alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to", F.concat(F.encode("header", "UTF-8"), "payload", end).alias("record"),
    )
