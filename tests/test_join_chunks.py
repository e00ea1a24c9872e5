"""Chunks joined again, against plain Python."""

import random

from pyspark.sql import functions as F

from veilspark.functions import text as tx


def joined(rows):
    out = {}
    for k, n, t in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        out.setdefault(k, []).append(t)
    return {k: " ".join(t for t in ts if t is not None) for k, ts in out.items()}


def test_runs_give_what_single_chunks_give(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        for _ in range(1 + (k % 5 == 0)):  # some keys come twice, their chunks lie among each other
            start = rng.randrange(3)
            rows += [(k, start + i, rng.choice(["a", "bb", "", "c d", " ", "é", "zz"])) for i in range(rng.randrange(1, 30))]
    rows += [(50, 0, None), (50, 1, "x"), (50, 2, None), (51, 0, None), (-1, 7, "")]
    for seed in (None, 1):
        if seed:
            rng.shuffle(rows)
        for parts in (1, 5):
            df = spark.createDataFrame(rows, "doc_id long, chunk int, text string").repartition(parts) if seed else spark.createDataFrame(rows, "doc_id long, chunk int, text string").coalesce(parts)
            assert {r.doc_id: r.text for r in tx.join_chunks(df).collect()} == joined(rows)
            assert {r.doc_id: r.text for r in tx.join_chunks(df.withColumn("chunk", F.col("chunk") * 0.5)).collect()} == joined(rows)
    assert tx.join_chunks(df.where("false")).collect() == []


def test_chunks_that_lie_together_are_one_row_before_the_shuffle(spark):
    df = spark.createDataFrame([("a b c d e f",), ("g h",)], "t string").coalesce(1).select(F.col("t").alias("doc_id"), F.posexplode(F.split("t", " ")).alias("n", "t"))
    assert sorted((r.n, r.m, r.t) for r in tx._runs(df.select("doc_id", F.col("n").cast("long"), "t"), "doc_id").collect()) == [(0, 2, "g h"), (0, 6, "a b c d e f")]
