"""Table functions, aggregates of a caller, keyed tables and kept results."""

import statistics
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from veilspark.functions import tables
from veilspark.functions.rules import PROFILES, Profile, Rule
from veilspark.operators import aggregates
from veilspark.operators.scan import scan
from veilspark.plans import pipeline
from veilspark.sources import keyed


@pytest.mark.parametrize("name", ["light", "modular", "chunked"])
def test_table_function_is_the_scan(spark, docs, name):
    rules = PROFILES[name]
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "fr"), (-3, "a@b.org 4111 1111 1111 1111", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    names = ("ord", "type", "text", "start", "end", "score", "method")
    got = tables.rows(both, rules).select("doc_id", *(F.col(f"find_{n}").alias(n) for n in names))
    want = both.select("doc_id", F.explode(scan(F.col("text"), F.col("lang"), rules)).alias("s")).select("doc_id", *(f"s.{n}" for n in names))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("doc_id = -3").count() > 0
    assert got.where("doc_id in (-1, -2)").count() == 0


def test_registered_function(spark):
    tables.register(spark, "digits_of", Profile("d", (Rule("N", r"\d+"), Rule("FR", r"\d{3}", langs=("fr",))), "all"))
    got = spark.sql("select f.type, f.text, f.start from (values ('a 12 345', 'fr'), (null, 'fr')) t(x, l), lateral digits_of(x, l) f").collect()
    assert [tuple(r) for r in got] == [("N", "12", 2), ("N", "345", 5), ("FR", "345", 5)]
    with pytest.raises(ValueError, match="validators"):
        tables.register(spark, "bad", PROFILES["modular"])


def spread(column):
    """A caller's own: variance by merging counts, means and squares."""

    @dataclass(frozen=True)
    class Spread:
        column: str
        schema: str = "variance double"

        def zero(self):
            return 0, 0.0, 0.0

        def add(self, state, rows):
            x = rows[self.column].dropna()
            return self.merge(state, (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()))) if len(x) else state

        def merge(self, a, b):
            n = a[0] + b[0]
            if not n:
                return a
            d = b[1] - a[1]
            return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n

        def result(self, state):
            return (state[2] / (state[0] - 1) if state[0] > 1 else None,)

    return Spread(column)


def test_aggregates_are_the_built_in_ones(spark):
    rows = [(k % 5 if k % 7 else None, float(k * k % 31) if k % 4 else None) for k in range(400)] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = {r.g: r for r in aggregates.summarized(df, ["g"], aggregates.Summary("v"), spread("v"), groups=2).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_samp("v").alias("var")).collect()}
    assert set(got) == set(want) and None in got
    for g, r in got.items():
        w = want[g]
        assert (r.v_n, r.v_min, r.v_max) == (w.n, w.lo, w.hi) and r.v_sum == pytest.approx(w.s or 0.0)
        assert (r.variance is None) == (w["var"] is None) and (w["var"] is None or r.variance == pytest.approx(w["var"]))
    assert got[99].v_mean is None and got[0].variance == pytest.approx(statistics.variance([v for k, v in rows if k == 0 and v is not None]))
    assert aggregates.summarized(df.limit(0), ["g"], aggregates.Summary("v")).collect() == []


def test_upsert(spark, tmp_path):
    path, shape = f"file://{tmp_path}/t", "k long, v string, version long"
    table = lambda: {r.k: (r.v, r.version) for r in keyed.read_keyed(spark, path).collect()}
    keyed.upsert(spark.createDataFrame([(k, f"a{k}", 1) for k in range(50)], shape), path, ["k"], buckets=8)
    keyed.upsert(spark.createDataFrame([(3, "b", 2), (3, "c", 1), (70, "new", 1)], shape), path, ["k"], buckets=8)
    want = {k: (f"a{k}", 1) for k in range(50)} | {3: ("b", 2), 70: ("new", 1)}
    assert table() == want
    for rows, error in (([(3, "x", 2)], "stale"), ([(4, "x", 3)], "stale"), ([(None, "x", 1)], "null"), ([(9, "x", None)], "null")):
        with pytest.raises(ValueError, match=error):
            keyed.upsert(spark.createDataFrame(rows, shape), path, ["k"], buckets=8)
    broken = spark.createDataFrame([(k, "z", 2) for k in range(10)], shape).where("k <> 3").withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        keyed.upsert(broken, path, ["k"], buckets=8)
    assert table() == want
    keyed.upsert(spark.createDataFrame([], shape), path, ["k"], buckets=8)
    assert table() == want


def test_kept_results(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    df = spark.createDataFrame([(1, "a.b@x.org", "en"), (2, "a.b@x.org", "en"), (3, None, "en"), (4, "", None), (5, "c@d.org", "fr")], "doc_id int, text string, lang string")
    seen, analyze = [], pipeline.analyze
    monkeypatch.setattr(keyed.pipeline, "analyze", lambda d, *a, **k: seen.append(d.count()) or analyze(d, *a, **k))
    rules = Profile("m", tuple(r for r in PROFILES["light"].rules if r.type == "EMAIL"), "greedy_first", "tag")
    rows = lambda out: sorted((r.doc_id, r.masked_text, len(r.entities)) for r in out.collect())
    want = sorted((r.doc_id, r.masked_text, len(r.entities)) for r in analyze(df, rules).collect())
    assert rows(keyed.analyzed_once(df.where("doc_id < 4"), path, rules)) == want[:3] and seen == [1, 1]
    assert rows(keyed.analyzed_once(df, path, rules)) == want and seen[2:] == [2, 1]
    assert rows(keyed.analyzed_once(df, path, rules)) == want and seen[4:] == [0, 1]
    keyed.analyzed_once(df, path, Profile("m", rules.rules, "greedy_first", "stars")).collect()
    assert seen[6:] == [3, 1]
    assert rows(keyed.analyzed_once(df.limit(0), f"{path}2", rules)) == []
