"""Sources, sinks and streams, each stream against its batch twin."""

import pytest
from pyspark.sql import functions as F

from veilspark.plans import pipeline
from veilspark.sources import io
from veilspark.streaming import stream


def test_csv_encodings_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("text_id,text\n1,été\n".encode())
    (tmp_path / "b.csv").write_bytes("text_id,text\n2,été\n".encode("latin1"))
    got = io.read_csv(spark, str(tmp_path), "text_id int, text string", required=("text",))
    assert sorted((r.text_id, r.text) for r in got.collect()) == [(1, "été"), (2, "été")]
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path), "text_id int", required=("text",))


def test_json_texts_and_documents(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text('[{"a": 1, "e": "[{\\"type\\": \\"T\\", \\"text\\": \\"x\\"}]"}, {"a": 2, "e": "bad"}]')
    df = io.read_json(spark, str(tmp_path / "j"), "a int, e string")
    assert [(r.a, len(r.e)) for r in df.select("a", io.entity_list(F.col("e")).alias("e")).orderBy("a").collect()] == [(1, 1), (2, 0)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.txt").write_text("a\nb")
    (tmp_path / "t/doc.pdf").write_bytes(b"p1|p2")
    assert {r.text for r in io.read_texts(spark, str(tmp_path / "t")).collect()} == {"a\nb", "p1|p2"}
    pages = io.read_documents(spark, str(tmp_path / "t/doc.pdf"), lambda c: c.decode().split("|"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(0, "p1"), (1, "p2")]
    with pytest.raises(Exception, match="not a .pdf"):
        io.read_documents(spark, str(tmp_path / "t"), lambda c: []).collect()
    rows = io.requests(spark, [{"text": "a"}, {"texts": ["b", "c"], "language": "fr"}]).collect()
    assert [(r.text, r.language) for r in rows] == [("a", "en"), ("b", "fr"), ("c", "fr")]
    spark.conf.set("spark.veilspark.policy", "iou")
    assert io.settings(spark)["policy"] == "iou"
    spark.conf.unset("spark.veilspark.policy")


def test_sinks(spark, docs, tmp_path):
    out = pipeline.analyze(docs, "simple")
    io.write_results(out.select("doc_id", "entities"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == docs.count()
    e = pipeline.entities(docs, "simple")
    io.write_entities(e, str(tmp_path / "e"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "e")).count() == e.count() > 0
    io.write_redacted(out, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w/text")).count() == docs.count()
    audit = io.audit_rows(out, user=F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), at=F.lit("2024-01-01").cast("timestamp"))
    for _ in range(2):
        io.append(audit, str(tmp_path / "a"), "user_id")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2 * out.where("has_pii and doc_id % 2 = 0").count() > 0
    io.save_index(docs.select("doc_id", "text").limit(3), str(tmp_path / "i"))
    assert io.load_index(spark, str(tmp_path / "i")).count() == 3
    assert "<table>" in io.html_report(e.groupBy("type").count(), e.select("text"))


def test_stream_is_batch(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").repartition(3).write.parquet(str(tmp_path / "in"))
    s = stream.read_files(spark, str(tmp_path / "in"), "doc_id long, text string, lang string")
    stream.run_once(stream.redact(s, "modular").select("doc_id", "masked_text"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = pipeline.analyze(docs, "modular").select("doc_id", "masked_text")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.count() == docs.count()


def test_windows_sessions_and_unique_texts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.read_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string")
    for k, f in enumerate((lambda d: stream.windowed_counts(d, "event_type"), lambda d: stream.sessions(d, "user_id"))):
        stream.run_once(f(s), str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}"))
        got, want = spark.read.parquet(str(tmp_path / f"o{k}")), f(events)
        assert got.exceptAll(want).count() == 0  # what lies within the watermark's delay of the end is still open
        assert got.count() > 0.9 * want.count()
    rows = [(1, "mail a@b.org", "2024-01-01 00:00:00"), (2, "mail a@b.org", "2024-01-01 00:01:00"), (3, "x", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.lit("en").alias("lang"), F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "u"))
    u = stream.read_files(spark, str(tmp_path / "u"), "doc_id long, text string, lang string, ts timestamp")
    stream.run_once(stream.redact_unique(u, "simple", time="ts").select("doc_id", "masked_text"), str(tmp_path / "uo"), str(tmp_path / "uc"))
    assert sorted(r.masked_text for r in spark.read.parquet(str(tmp_path / "uo")).collect()) == ["mail [EMAIL]", "x"]


def test_metrics_are_named_by_their_time(spark, tmp_path):
    from datetime import datetime

    from veilspark.sources import io

    at = datetime(2024, 5, 6, 7, 8, 9)
    path = io.write_metrics(spark.sql("select 'a' as type, 1 as n"), str(tmp_path), "report", at)
    assert path.endswith("/report_20240506_070809.csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("a", "1")]
