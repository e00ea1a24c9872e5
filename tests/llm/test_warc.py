"""WARC tables and files: round trips, digests, revisits, oversized payloads."""

import base64
import hashlib

from pyspark.sql import functions as F

from veilspark.llm import common, queries, warc

SF = "/root/testdata/sf0.001"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, html in rows:
        d = digest(html)
        first[d] = min((x for x in (first.get(d), i) if x is not None), default=None)
    out = []
    for i, html in rows:
        of = first[digest(html)]
        out.append((i, len((html or "").encode()), digest(html), "response" if i == of else "revisit", None if i == of else of))
    return sorted(out, key=str)


def test_query(spark):
    rows = [(r.page_id, r.html) for r in common.read(spark, SF, "pages").collect()]
    got = queries.op7_warc(spark, SF).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert all(r.intact for r in got)


def test_odd_pages_and_files(spark, tmp_path):
    big = "é" * 50_001 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a b/\r\n", "x"), (3, None, "x"), (3, "u", "x"), (9, "u", "x"), (9, "u", "x"), (None, "u", "x"), (None, "u", "alone"), (7, "u", None), (8, "u", ""), (1, "u", big), (2, "u", big), (4, "u", "y" * 200_000), (6, "u", "\r\n\r\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, seq int").repartition(3)
    table = warc.write_records(df, chunk_bytes=1000)
    got = warc.read_records(table).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected([(i, h) for i, _, h in rows])
    assert all(r.intact for r in got) and table.agg(F.max("chunk")).first()[0] >= 100
    assert table.agg(F.max(F.length("data"))).first()[0] < 2500
    assert next(r.url for r in got if r.page_id == 5) == "http://a%20b/%0D%0A"
    paths = warc.export_files(table, str(tmp_path / "files"))
    from_files = [x for p in paths for x in warc.scan_file(p)]
    assert sorted(map(str, from_files)) == sorted(str(tuple(r)) for r in got)
    assert warc.read_records(warc.write_records(df.limit(0))).collect() == []


def test_damage_is_seen(spark):
    df = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "short")], "page_id long, url string, html string")
    table = warc.write_records(df, chunk_bytes=1000)
    bad = table.withColumn("data", F.when((F.col("chunk") == 2), F.lit(b"y" * 1000)).otherwise(F.col("data")))
    assert {r.page_id: r.intact for r in warc.read_records(bad).collect()} == {1: False, 2: True}


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_records(warc.write_records(df, min_revisit_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
