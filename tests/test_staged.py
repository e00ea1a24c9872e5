"""Positions, interval joins, merged entities and JSON against plain Python; defined results of odd rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import jsontext, positions, score
from veilspark.functions.rules import PROFILES, Profile, Rule
from veilspark.operators import intervals, merge, pivots, resolve
from veilspark.plans import pipeline


def kept_places(text, clean):
    """Original place of each character of a text from which characters were dropped: the first that fits, in order."""
    places, at = [], 0
    for c in clean:
        at = text.index(c, at)
        places.append(at)
        at += 1
    return places


def test_maps_are_the_character_mapping(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c*#_[]é漢\t") for _ in range(rng.randrange(60))) for _ in range(80)] + ["*" * 30, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("c", positions.cleaned(F.col("t"), positions.MARKDOWN))
    n = F.length("c.text")
    got = df.select("k", "c.text", "c.maps", F.transform(F.sequence(F.lit(0), n), lambda p: positions.original(F.col("c.maps"), p)).alias("p")).collect()
    for r in got:
        assert r.text == "".join(c for c in texts[r.k] if c not in "*#_[]")
        assert r.p == [*kept_places(texts[r.k], r.text), len(texts[r.k])]
        edits = sum(texts[r.k].count(c) for c in "*#_[]")
        assert len(r.maps[0].at) <= edits + 2


def test_steps_and_interpolation(spark):
    def back(text, steps, *places):
        df = spark.createDataFrame([(text,)], "t string").withColumn("c", positions.cleaned(F.col("t"), steps))
        r = df.select("c.text", F.array(*(positions.original(F.col("c.maps"), F.lit(p)) for p in places)).alias("p")).first()
        return r.text, r.p

    assert back("a\r\nb \t c​d", positions.LINES, 0, 1, 2, 3, 4, 5, 6, 9) == ("a\nb cd", [0, 1, 3, 4, 7, 9, 10, 13])
    assert back("x&amp;y", (("&amp;", "AND"),), 0, 1, 2, 3, 4) == ("xANDy", [0, 1, 2, 4, 6])
    assert back("", positions.BLANKS, 0, 2) == ("", [0, 2])
    assert back("  two  words ", positions.BLANKS, 0, 3, 4) == ("two words", [2, 5, 7])
    odd = spark.createDataFrame([(None,)], "t string").select(positions.cleaned(F.col("t"), positions.LINES).alias("c")).first().c
    assert odd.text is None and odd.maps is None


def test_spans_come_back(spark):
    rules = Profile("n", (Rule("N", r"\d{4}"),), "all")
    rows = [(1, "no **12\t*34** here 5678", "en"), (2, None, "en"), (3, "", "en"), (4, ("#" * 50 + "1") * 4 + " " + "x" * 50_000 + "9999", "en")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: [(e.start, e.end, e.text) for e in r.entities] for r in pipeline.detect_cleaned(df, ((r"[*#\t]", ""),), rules).collect()}
    assert got == {1: [(5, 11, "12\t*34"), (19, 23, "5678")], 2: [], 3: [], 4: [(50, 204, rows[3][1][50:204]), (50_205, 50_209, "9999")]}
    chunks = pipeline.entities_by_chunk(df, rules, size=20).where("doc_id = 4 or doc_id = 1").collect()
    assert all(rows[r.doc_id - 1][1][r.start : r.end] == r.text for r in chunks) and {r.text for r in chunks} == {"5678", "9999"}


def spans_table(spark, seed, docs=12, most=40, length=300):
    rng = random.Random(seed)
    kinds = ["PERSON", "PERSON", "FIRST_NAME", "NAME_X", "LOCATION", "HOME_ADDRESS", "PHONE_NUMBER", "FR_PHONE", "US_PHONE", "TITLE", "ORGANIZATION", "DATE", "AR_NAME"]
    rows = []
    for d in range(docs):
        for _ in range(rng.randrange(most)):
            a = rng.randrange(length)
            z = min(length, a + rng.choice([1, 2, 3, 5, 9, 200] if rng.random() < 0.1 else [1, 2, 3, 5, 9]))
            rows.append((d, a, z, rng.choice(kinds), f"{a}-{z}", rng.choice([0.2, 0.5, 0.75, 0.9]), rng.choice(["a", "b", "c"])))
    return rows, spark.createDataFrame(rows, "doc_id int, start int, end int, type string, text string, score double, method string")


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_join_is_the_plain_join(spark, width):
    rows, df = spans_table(spark, width)
    half = F.col("type") < "H"
    got = intervals.overlapping(df.where(half), df.where(~half), width=width).collect()
    want = sorted((a, b) for a in rows for b in rows if a[3] < "H" <= b[3] and a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    pack = lambda r, p: (r.doc_id, *(r[f"{p}_{c}"] for c in ("start", "end", "type", "text", "score", "method")))
    assert sorted((pack(r, "a"), pack(r, "b")) for r in got) == want
    kind = resolve.overlap_kind(*(F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")))
    counts = {r.doc_id: r.n for r in intervals.pair_counts(df.where(half), df.where(~half), kind, width=width).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    sizes = {d: (sum(r[0] == d and r[3] < "H" for r in rows), sum(r[0] == d and r[3] >= "H" for r in rows)) for d in {r[0] for r in rows}}
    assert counts == {d: a * b for d, (a, b) in sizes.items() if a * b}


def test_interval_join_of_one_long_document(spark):
    a = spark.range(100_000).selectExpr("1 as doc_id", "int(id * 10) as start", "int(id * 10 + 6) as end")
    b = spark.range(100_000).selectExpr("1 as doc_id", "int(id * 10 + 4) as start", "int(id * 10 + 12) as end")
    r = resolve.overlapping_pairs(a, b).agg(F.count("*").alias("n"), F.countDistinct("a_start").alias("k")).first()
    assert (r.n, r.k) == (199_999, 100_000)
    odd = spark.createDataFrame([(1, None, 3), (1, 3, 3), (1, 5, 2), (None, 0, 9), (1, 0, 4), (1, 0, 4)], "doc_id int, start int, end int")
    assert intervals.overlapping(odd, odd).count() == 4 and intervals.overlapping(odd.limit(0), odd).count() == 0


def plain_merge(spans):
    """The levels over one document's spans (start, end, type, text, score, method), one after another."""
    once = {}
    for a, z, t, x, s, m in spans:
        key = (a, z, t, x)
        if key not in once or (-s, m) < (-once[key][0], once[key][1]):
            once[key] = (s, m)
    order = sorted((a, z, t, x, s, m) for (a, z, t, x), (s, m) in once.items())
    groups, reach = [], None
    for s in order:
        if reach is None or s[0] >= reach:
            groups.append([])
        groups[-1].append(s)
        reach = max(reach or 0, s[1])
    out = []
    for group in groups:
        by_base = {}
        for s in group:
            by_base.setdefault(s[2].split("_")[0], []).append(s)
        for base, ss in by_base.items():
            if len(group) > 1 and len(ss) > 1 and (base == "PERSON" or "NAME" in base):
                methods = sorted({s[5] for s in ss})
                out.append((min(s[0] for s in ss), ss[-1][1] if ss[-1][0] == max(s[0] for s in ss) else None, "PERSON", min(1.0, max(s[4] for s in ss) + len(methods) * 0.1 + min(0.1, len(ss) * 0.05)), "+".join(methods)))
                continue
            part = []
            for s in [*ss, None]:
                if part and (s is None or s[0] >= max(p[1] for p in part)):
                    best = min(part, key=lambda p: (-p[4], p[0], p[1], p[2]))
                    out.append((part[0][0], max(p[1] for p in part), best[2], best[4], "+".join(sorted({p[5] for p in part}))))
                    part = []
                part.append(s)
    out.sort()
    done = []
    for s in out:
        c = done[-1] if done else None
        place = lambda t: t == "LOCATION" or "ADDRESS" in t
        if c and (
            (abs(s[0] - c[1]) <= 3 and ((c[2] == s[2] and s[2] in ("PERSON", "AR_NAME", "ORGANIZATION", "DATE")) or (place(c[2]) and place(s[2]))))
            or (c[2] == s[2] == "PHONE_NUMBER")
            or (c[2].endswith("_PHONE") and s[2].endswith("_PHONE"))
            or (c[2] == "TITLE" and s[2] == "PERSON")
        ):
            done[-1] = (c[0], s[1], c[2], max(c[3], s[3]), f"{c[4]}+{s[4]}")
        else:
            done.append(s)
    return done


def test_merge_is_the_sequential_merge(spark):
    rows, df = spans_table(spark, 3, docs=40, most=60)
    got = {}
    for r in merge.merged(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.type, round(r.score, 9), r.method))
    want = {d: plain_merge([r[1:] for r in rows if r[0] == d]) for d in {r[0] for r in rows}}
    assert {d: sorted(s) for d, s in got.items()} == {d: sorted((a, z, t, round(s, 9), m) for a, z, t, s, m in spans) for d, spans in want.items()}


def test_merge_of_names_and_odd_rows(spark):
    text = "Dr. Jean Paul Sartre, Paris"
    rows = [(1, 4, 13, "PERSON", "Jean Paul", 0.7, "x"), (1, 9, 20, "PERSON", "Paul Sartre", 0.6, "y"), (1, 0, 3, "TITLE", "Dr.", 0.5, "x"), (1, 22, 27, "LOCATION", "Paris", None, "x"), (1, 5, 5, "DATE", "", 0.5, "x"), (2, None, 3, "DATE", "a", 0.5, "x")]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, type string, text string, score double, method string")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    got = sorted((r.start, r.end, r.type, round(r.score, 6), r.method, r.text) for r in merge.merged(df, docs).collect())
    assert got == [(0, 20, "TITLE", 1.0, "x+x+y", text[:20]), (22, 27, "LOCATION", 0.0, "x", "Paris")]
    assert merge.merged(df.limit(0)).collect() == []


def test_json_of_any_shape(spark):
    mail = "ann.lee@mail.org"
    shapes = [
        '{"b": "to ' + mail + '", "a": [1.50, true, null, {"' + mail + '": "x\\u00e9\\n' + mail + '"}], "c": 1e400}',
        f'["{mail}", [["{mail}"]], "\\"quoted\\" {mail}"]',
        f'"{mail}"',
        "{}",
        "17",
        f"{{not json {mail}",
        f'{{"k": "{mail}", "k": 2}}',
        None,
        "",
        '{"big": "' + "y\\n" * 40_000 + mail + '"}',
    ]
    rules = Profile("m", tuple(r for r in PROFILES["light"].rules if r.type == "EMAIL"), "greedy_first")
    df = spark.createDataFrame(list(enumerate(shapes)), "k int, j string")
    got = [r.j for r in pipeline.redact_json(df, "j", rules, masks="tag").orderBy("k").collect()]
    assert got[0] == shapes[0].replace('"to ' + mail, '"to [EMAIL]').replace('"x\\u00e9\\n' + mail, '"xé\\n[EMAIL]')
    assert json.loads(got[1]) == ["[EMAIL]", [["[EMAIL]"]], '"quoted" [EMAIL]'] and got[2] == '"[EMAIL]"' and got[3:5] == ["{}", "17"]
    assert got[5] == "{not json [EMAIL]" and got[6] == '{"k": "[EMAIL]", "k": 2}' and got[7] is None and got[8] == ""
    assert got[9].endswith('y\\n[EMAIL]"}') and len(got[9]) == len(shapes[9]) - len(mail) + 7
    leaves = sorted((r.k, r.path, r.value) for r in jsontext.strings(df.where("k < 9"), "k", "j").collect())
    assert leaves == [(0, "$.a[3]." + mail, "xé\n" + mail), (0, "$.b", "to " + mail), (1, "$[0]", mail), (1, "$[1][0][0]", mail), (1, "$[2]", f'"quoted" {mail}'), (2, "$", mail)]


@pytest.mark.parametrize("clustered", [True, False])
def test_pivots_are_exact(spark, clustered, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * (20 if clustered else 0)
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6))).astype(np.float32)
    x[40:60] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    odd = spark.createDataFrame([(2000, None), (None, [0.0] * 6), (2001, [1.0])], "vec_id long, embedding array<float>")
    chosen = pivots.build(df.unionByName(odd), str(tmp_path), pivots=8, size=32)
    index, again = pivots.load(spark, str(tmp_path))
    assert np.array_equal(chosen, again) and index.agg(F.sum("n")).first()[0] == 900
    got = {}
    for r in pivots.search(df.where("vec_id % 9 = 0").unionByName(odd), index, again, 4, size=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance, r.computed))
    assert set(got) == set(range(0, 900, 9))
    y = x.astype(float)
    for q, rows in got.items():
        d = ((y - y[q]) ** 2).sum(1)
        assert [r[1] for r in sorted(rows)] == sorted(range(900), key=lambda i: (d[i], i))[:4]
    share = np.mean([rows[0][3] for rows in got.values()]) / 900
    assert share < 0.4 if clustered else share <= 1


def test_pivots_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], "vec_id long, embedding array<float>")
    chosen = pivots.choose(df, "vec_id", "embedding")
    index = pivots.written(pivots.blocks(df, chosen, "vec_id", "embedding", 2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in pivots.search(df, index, chosen, 5).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 25), (2, 1, 1, 0), (2, 2, 2, 0), (2, 3, 3, 25), (3, 1, 3, 0), (3, 2, 1, 25), (3, 3, 2, 25)]
    none = pivots.choose(df.limit(0), "vec_id", "embedding")
    assert pivots.search(df, pivots.blocks(df.limit(0), none, "vec_id", "embedding", 2), none).count() == 0
    assert pivots.search(df.limit(0), index, chosen).count() == 0


def test_agreement_meets_by_place_and_text(spark):
    rows, df = spans_table(spark, 9, docs=6)
    df = df.withColumn("method", F.when(F.col("method") == "a", "huggingface").when(F.col("method") == "b", "presidio").otherwise("spacy"))
    got = {(r.doc_id, r.start, r.end, r.type, r.method): round(r.agreement, 6) for r in score.agreement(df).collect()}
    weight = {"a": ("huggingface", 0.9), "b": ("presidio", 0.8), "c": ("spacy", 0.7)}
    for d, a, z, t, x, _, m in rows:
        met = {r[6] for r in rows if r[0] == d and (r[4] == x or (a <= r[2] and r[1] <= z))}
        assert got[d, a, z, t, weight[m][0]] == round(sum(weight[o][1] for o in met) / len(met), 6)
    assert df.count() == score.agreement(df).count()
