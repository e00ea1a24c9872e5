"""Overlap policies against plain Python, evaluation, reports and vectors."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import evaluate, report, resolve, retrieve


def over(a, b):
    i = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return i / (a[1] - a[0] + b[1] - b[0] - i)


def plain(name, spans):
    """spans: (start, end, score, order), sorted by (start, -score, order)."""
    if name == "score_first_sweep":
        spans = sorted(spans, key=lambda s: (-s[2], s[0], s[3]))
    kept = []
    for s in spans:
        if not kept:
            kept.append(s)
            continue
        c = kept[-1]
        if name == "greedy_first":
            if s[0] >= c[1]:
                kept.append(s)
        elif name == "touching_sweep":
            if s[0] > c[1]:
                kept.append(s)
            elif s[2] > c[2]:
                kept[-1] = s
        elif name == "interval_union":
            if s[0] <= c[1]:
                best = s if s[2] > c[2] else c
                kept[-1] = (min(c[0], s[0]), max(c[1], s[1]), best[2], best[3])
            else:
                kept.append(s)
        elif name == "iou":
            near = [i for i, k in enumerate(kept) if over(k, s) >= 0.5]
            if not near:
                kept.append(s)
            elif worse := [i for i in near if kept[i][2] < s[2]]:
                kept[worse[0]] = s
        elif s[0] >= c[1]:
            kept.append(s)
        elif name == "sweep_replace" and s[2] > c[2]:
            kept[-1] = s
        elif name == "score_first_sweep" and s[2] > c[2] + 0.1:
            kept[-1] = s
        elif name == "sweep_margin" and (s[2] > c[2] + 0.1 or (s[1] - s[0] > c[1] - c[0] and s[2] >= c[2])):
            kept[-1] = s
    return sorted((s[:2] + s[3:]) for s in kept)


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        spans = []
        for order in range(rng.randrange(0, 9)):
            a = rng.randrange(0, 30)
            spans.append((a, a + rng.randrange(1, 9), rng.choice([0.5, 0.7, 0.85, 0.9]), order))
        rows.append((k, sorted(spans, key=lambda s: (s[0], -s[2], s[3]))))
    table = [(k, [(a, -s, o, b, "T", "x" * (b - a), s, "m") for a, b, s, o in spans]) for k, spans in rows]
    return dict(rows), spark.createDataFrame(table, f"k int, s {resolve.SPANS}").repartition(4).cache()


@pytest.mark.parametrize("name", [p for p in resolve.POLICIES if p != "all"])
def test_policies(cases, name):
    want, df = cases
    for r in df.select("k", resolve.resolve(F.col("s"), name).alias("s")).collect():
        assert sorted((s.start, s.end, s.ord) for s in r.s) == plain(name, want[r.k]), (r.k, want[r.k])


def spans_of(spark, text, *spans):
    rows = [(a, -s, k, b, t, text[a:b], s, m) for k, (a, b, t, s, m) in enumerate(spans)]
    return spark.createDataFrame([(text, rows)], f"t string, s {resolve.SPANS}")


def test_span_cleaners(spark):
    df = spans_of(spark, "Dr Ann Lee, Paris", (3, 6, "PERSON", 0.7, "a"), (7, 11, "PERSON", 0.9, "b"), (12, 17, "LOCATION", 0.5, "a"))
    got = df.select(resolve.merge_adjacent(F.col("s"), F.col("t")).alias("s")).first().s
    assert [(s.text, s.score, s.method) for s in got] == [("Ann Lee,", 0.9, "a+b"), ("Paris", 0.5, "a")]
    trimmed = df.select(resolve.trim_bounds(F.col("s")).alias("s")).first().s
    assert [s.text for s in trimmed] == ["Ann", "Lee", "Paris"] and trimmed[1].end == 10
    quoted = spans_of(spark, " «'Paris.»; (x)", (0, 12, "X", 1.0, "m"), (12, 15, "X", 1.0, "m"), (9, 11, "X", 1.0, "m")).select(resolve.trim_bounds(F.col("s")).alias("s")).first().s
    assert sorted((s.text, s.start, s.end) for s in quoted) == [("Paris", 3, 8), ("x", 13, 14)]
    low = spans_of(spark, "12 in the 123 people", (0, 2, "CARDINAL", 1.0, "m"), (0, 2, "PHONE_NUMBER", 1.0, "m"), (3, 9, "X", 1.0, "m"), (6, 9, "X", 1.0, "m"), (10, 13, "ID", 1.0, "m"), (10, 20, "CARDINAL", 1.0, "m"), (3, 9, "LOW", 0.1, "m"))
    assert sorted((s.type, s.text) for s in low.select(resolve.post_filter(F.col("s"), F.lit("en"), 0.5).alias("s")).first().s) == [("CARDINAL", "123 people"), ("ID", "123"), ("X", "in the")]
    inside = spans_of(spark, "abcdef gh", (1, 3, "X", 1.0, "m"), (7, 9, "X", 1.0, "m"), (0, 6, "X", 1.0, "m"))
    assert [s.text for s in inside.select(resolve.whole_words(F.col("s"), F.col("t")).alias("s")).first().s] == ["gh", "abcdef"]
    many = spans_of(spark, "ab ab ab cd", (0, 2, "X", 0.5, "m"), (3, 5, "X", 0.9, "m"), (6, 8, "X", 0.9, "m"), (9, 11, "X", 0.5, "m"))
    assert [s.start for s in many.select(resolve.best_of_repeats(F.col("s")).alias("s")).first().s] == [3, 9]
    assert [s.text for s in spans_of(spark, "the 12 Boston", (0, 3, "X", 1.0, "m"), (4, 6, "X", 1.0, "m"), (7, 13, "X", 1.0, "m")).select(resolve.post_filter(F.col("s"), F.lit("en")).alias("s")).first().s] == ["Boston"]
    fixed = spans_of(spark, "tok_1\nrest 9 lives", (0, 10, "X", 1.0, "m"), (11, 18, "ORGANIZATION", 1.0, "m")).select(resolve.rewrite_types(F.col("s")).alias("s")).first().s
    assert [(s.type, s.text, s.end) for s in fixed] == [("PAYMENT_TOKEN", "tok_1", 5)]
    lines = spans_of(spark, "Email\nAnn Lee\nx", (0, 15, "PERSON", 1.0, "m"), (6, 13, "X", 1.0, "m")).select(resolve.rewrite_types(F.col("s")).alias("s")).first().s
    assert [(s.type, s.text, s.start, s.end) for s in lines] == [("PERSON", "Ann Lee", 0, 7)]
    both = spans_of(spark, "ab cd ab ef", (0, 2, "X", 1.0, "m")).withColumnRenamed("s", "a").crossJoin(spans_of(spark, "ab cd ab cd", (0, 2, "X", 1.0, "n"), (3, 5, "X", 1.0, "n"), (9, 11, "X", 1.0, "n")).select("s"))
    assert [(s.text, s.start, s.method) for s in both.select(resolve.add_unseen(F.col("a"), F.col("s")).alias("s")).first().s] == [("ab", 0, "m"), ("cd", 3, "n")]


def test_set_forms(spark):
    e = spark.createDataFrame([(1, 0, 5, "A_X", "a", 0.5), (1, 3, 8, "A_Y", "b", 0.9), (1, 8, 9, "B", "c", 0.1), (1, 20, 22, "B", "d", 0.2), (1, 20, 22, "B", "d", 0.7), (2, 0, 1, "B", "e", 0.3)], "doc_id int, start int, end int, type string, text string, score double")
    got = sorted((r.doc_id, r.start, r.end, tuple(r.kinds)) for r in resolve.regions(e).collect())
    assert got == [(1, 0, 9, ("A_X", "A_Y", "B")), (1, 20, 22, ("B",)), (2, 0, 1, ("B",))]
    assert sorted((r.doc_id, r.text, r.score) for r in resolve.best_in_island(e).collect()) == [(1, "b", 0.9), (1, "c", 0.1), (1, "d", 0.7), (2, "e", 0.3)]
    kinds = spark.sql("select * from values (0,5,1,2),(1,2,0,5),(0,3,2,5),(0,2,2,4) as t(a,b,c,d)").select(resolve.overlap_kind(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["CONTAINS", "CONTAINED", "PARTIAL", "NONE"]


def test_evaluation(spark):
    names = "doc_id int, start int, end int, type string, text string, score double"
    pred = spark.createDataFrame([(1, 0, 2, "A", "ab", 0.8), (1, 0, 2, "A", "ab", 0.6), (1, 5, 7, "B", "xy", 0.9), (2, 0, 1, "A", "q", 1.0)], names)
    truth = spark.createDataFrame([(1, 0, 2, "A", "ab", 1.0), (2, 0, 1, "A", "q", 1.0), (2, 4, 5, "C", "z", 1.0)], names)
    m = {r.type: r for r in evaluate.by_type(evaluate.outcomes(pred, truth)).collect()}
    assert (m["A"].tp, m["A"].fp, m["A"].fn, m["A"].support) == (2, 1, 0, 2) and round(m["A"].f1, 3) == 0.8
    assert (m["B"].precision, m["C"].recall, m["C"].fn) == (0.0, 0.0, 1)
    a = evaluate.averages(evaluate.by_type(evaluate.outcomes(pred, truth))).first()
    assert round(a.micro_precision, 3) == 0.5 and round(a.micro_recall, 3) == 0.667 and round(a.macro_recall, 3) == 0.333
    assert evaluate.matched(pred, truth).count() == 2
    assert {r.type: round(r.mae, 2) for r in evaluate.score_error(pred, truth).collect()} == {"A": 0.2}
    assert evaluate.agreement(pred, truth).first().asDict() == {"both": 2, "only_a": 1, "only_b": 1, "precision": pytest.approx(2 / 3), "recall": pytest.approx(2 / 3), "f1": pytest.approx(2 / 3)}
    masked = spark.createDataFrame([(1, "ab here"), (2, "none")], "doc_id int, masked_text string")
    assert {r.doc_id: (r.leaks, r.entities) for r in evaluate.leaks(masked, truth).collect()} == {1: (1, 1), 2: (0, 2)}
    empty = evaluate.averages(evaluate.by_type(evaluate.outcomes(pred.limit(0), truth.limit(0)))).first()
    assert empty.macro_f1 == 0 and empty.micro_f1 == 0
    t = spark.createDataFrame([(1, "en", 2.0), (2, "fr", 0.0)], "k int, lang string, s double")
    assert sorted(r.speed_up for r in evaluate.speed_up(t, t, ["k", "lang"], "s").collect()) == [0.0, 1.0]
    left = spark.createDataFrame([(k * 3, f"l{k}") for k in range(50)], "a int, l string")
    right = spark.createDataFrame([(k * 5, f"r{k}") for k in range(50)], "b int, r string")
    both = evaluate.zipped(left, right, "a", "b").collect()
    assert len(both) == 50 and all(r.l[1:] == r.r[1:] and int(r.l[1:]) + 1 == r.position for r in both)


def test_reports(spark):
    e = spark.createDataFrame([(1, "EMAIL", "en", "regex", 0.9), (1, "EMAIL", "en", "regex", 0.4), (1, "SSN", "en", "ner", 0.9), (2, "OTHER", "fr", "regex", 0.9)], "doc_id int, type string, lang string, method string, score double")
    d = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    r = {x.doc_id: x for x in report.risk(d, e).collect()}
    assert (r[1].risk_level, r[1].n_entities, r[1].recommendations[-2:]) == ("CRITICAL", 3, ["Found 2 EMAIL(s).", "Found 1 SSN(s)."])
    assert r[2].risk_level == "MEDIUM" and r[3].recommendations == ["No PII detected in the document."]
    assert {x.method: (x.total, x.filtered, x.types) for x in report.by_method(e).collect()} == {"regex": (3, 2, ["EMAIL", "OTHER"]), "ner": (1, 1, ["SSN"])}
    assert report.metrics_cube(e).count() == 3 + 3 + 2
    got = spark.sql("select map('EMAIL', 1) as m, 1 as n union all select map('X', 6), 6 union all select map('X', 1), 1 union all select map('SSN', 1), 1").select(report.service_risk(F.col("m"), F.col("n")).alias("r"))
    assert [x.r for x in got.collect()] == ["MEDIUM", "HIGH", "LOW", "HIGH"]
    results = spark.sql("select array(1,2) as entities, true as success, 0.5D as seconds union all select array(), false, 1.5D")
    assert report.batch_summary(results).first().asDict() == {"total_processed": 2, "total_pii_found": 2, "success_count": 1, "error_count": 1, "total_processing_time": 2.0, "average_time_per_text": 1.0}
    assert report.batch_summary(results.limit(0)).first().average_time_per_text == 0.0
    assert report.sample(d, 2, "doc_id").collect() == report.sample(d.repartition(3), 2, "doc_id").collect()
    p = {x.column: x for x in report.column_profile(e).collect()}
    assert p["type"].distinct_about == 3 and p["score"].nulls == 0 and p["score"].rows == 4
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b"), (1, 2, "user", "c")], "conv_id int, turn int, role string, text string")
    assert [x.context for x in report.prior_turns(t, 1).orderBy("turn").collect()] == ["", "user: a", "bot: b"]
    assert report.latest(t, "conv_id", "turn").first().text == "c"
    assert [x.n for x in t.limit(1).select(report.density(F.lit(2), F.lit(4)).alias("n")).collect()] == [0.5]


@pytest.mark.parametrize("metric,block", [("l2", 1000), ("cosine", 7)])
def test_nearest(spark, metric, block):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 8)), np.zeros((1, 8)), np.ones((2, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = retrieve.nearest(df.where("vec_id < 20"), df, 4, metric=metric, block=block).orderBy("query_id", "rank").collect()
    y = x.astype(float)
    for q in range(20):
        if metric == "l2":
            d = ((y - y[q]) ** 2).sum(1)
        else:
            n = np.linalg.norm(y, axis=1) * np.linalg.norm(y[q])
            d = 1 - np.divide(y @ y[q], n, out=np.zeros(len(y)), where=n > 0)
        want = sorted(range(len(y)), key=lambda i: (round(d[i], 9), i))[:4]
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4] and {r.vec_id for r in mine} == set(want)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(63)], "vec_id long, text string")
    assert all(r.context.startswith(f"t{r.query_id}\n\n") for r in retrieve.context(retrieve.nearest(df.where("vec_id < 3"), df, 2), texts).collect())
    with pytest.raises(ValueError):
        retrieve.nearest(df, df, metric="none")
    same = spark.sql("select 'Smith' as a, 'smith j' as b union all select 'abcd', 'wxyz'").select(retrieve.fuzzy_equal(F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in same.collect()] == [True, False]
    assert df.limit(1).select(retrieve.similar_enough(F.col("embedding"), F.col("embedding")).alias("v")).first().v
