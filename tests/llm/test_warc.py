import hashlib

import pytest

from stratafold.llm.warc import read_records, write_archive

PAGES = "page_id long, url string, html string, header string, payload string, sha256 string, n int"


def archived(spark, rows):
    pages = spark.createDataFrame([(*row, "x", "x", "x", 1) for row in rows], PAGES)
    archive = write_archive(pages)
    return archive, read_records(spark, archive)


def test_records_are_rebuilt_byte_by_byte(spark):
    big, odd = "é\r\n\r\nWARC/1.1\r\n" * 200, "x" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://b c\r\nX: y", odd), (5, "u", odd), (6, "u", None), (7, "u", "")]
    archive, records = archived(spark, rows)
    found = {r.page_id: r for r in records.collect()}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = found[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head + b"\r\n\r\n" == r.header.encode() and rest == payload + b"\r\n\r\n"
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(payload)
    assert {p: (r.record_type, r.refers_to) for p, r in found.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert archive.read(spark)[1].count() == 3  # one per distinct payload


def test_repeated_rows_and_missing_ids(spark):
    big = "y" * 2000
    _, records = archived(spark, [(5, "u", big), (5, "u", big), (None, "u", big), (None, "v", "z" * 1500), (None, "v", "z" * 1500)])
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in records.collect())
    assert found == [("5", 2000, "response", "None")] * 2 + [("None", 1500, "response", "None")] * 2 + [("None", 2000, "revisit", "5")]


def test_damage_is_found(spark):
    archive, _ = archived(spark, [(1, "u", "a" * 1200)])
    from pyspark.sql import functions as F

    broken = archive.payloads + "-broken"
    spark.read.parquet(archive.payloads).withColumn("payload", F.encode(F.lit("b" * 1200), "UTF-8")).write.parquet(broken)
    with pytest.raises(Exception, match="damaged"):
        read_records(spark, type(archive)(archive.headers, broken)).collect()


def test_empty_table(spark):
    assert archived(spark, [])[1].collect() == []
