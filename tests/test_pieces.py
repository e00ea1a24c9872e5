"""Python functions over Arrow batches take some texts at a time, and give what they give of each text alone."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.functions import bidi, jsontext, pieces, positions
from veilspark.functions.rules import Profile, Rule
from veilspark.operators import scan
from veilspark.plans import pipeline

TEXTS = ["سلام (x) 12", None, "", "plain", "لا" * 300, "a\nسلام", None]


def test_pieces_are_bounded_and_whole():
    texts = pa.array(TEXTS)
    for size in (1, 16, 1 << 18):
        got = list(pieces.pieces(texts, size))
        assert [i for at, n in got for i in range(at, at + n)] == list(range(len(TEXTS)))
        assert all(n == 1 or sum(len((t or "").encode()) for t in TEXTS[at : at + n]) <= size for at, n in got)
    assert list(pieces.pieces(texts.slice(7))) == [] and list(pieces.pieces(texts.slice(3, 2), 1)) == [(0, 1), (1, 1)]


def test_display_forms_hold_places_as_arrow(spark):
    got = bidi.some(TEXTS)
    assert got.field("first").type == got.field("last").type == pa.list_(pa.int32())
    for t, r in zip(TEXTS, got.to_pylist(), strict=True):
        assert (r["text"], r["first"], r["last"]) == (bidi.display(t) if t is not None else (None, None, None))
    rows = [(k, t) for k, t in enumerate(TEXTS * 40)]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1).withColumn("d", bidi.displayed(F.col("t")))
    shown = {r.k: r.d and (r.d.text, r.d["first"], r.d["last"]) for r in df.collect()}
    assert shown == {k: bidi.display(t) if t and ("س" in t or "ل" in t) else None for k, t in rows}


def test_scan_cleaning_and_json_are_those_of_each_text():
    rules = (Rule("WORD", r"[a-z]+", 0.5, "w"), Rule("PART", r"x(\d)?", 0.7, "p", group=1))
    ready = [(k, r, re.compile(r.pattern)) for k, r in enumerate(rules)]
    got = scan.found(TEXTS, ["en"] * len(TEXTS), ready).to_pylist()
    assert got == [scan.found([t], ["en"], ready).to_pylist()[0] for t in TEXTS]
    assert [(s["start"], s["end"], s["type"], s["neg_score"]) for s in got[3]] == [(0, 5, "WORD", -0.5)]
    steps = [(re.compile("[ا(]"), ""), (re.compile(" +"), " ")]
    for t, r in zip(TEXTS, positions.some(TEXTS, steps).to_pylist(), strict=True):
        first, one = positions.one_step(t, *steps[0]) if t is not None else (None, None)
        last, two = positions.one_step(first, *steps[1]) if t is not None else (None, None)
        assert (r["text"], r["maps"]) == (last, [one, two] if t is not None else None)
    assert jsontext._cut('{"a": "b\\n", "c": [1, "d"]}') == (['{"a": ', ', "c": [1, ', "]}"], ['"b\\n"', '"d"'], ["b\n", "d"])


def test_second_scans_are_those_of_each_text(spark):
    rows = [(k, f"سلام {k} a{k}@b.org") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("lang", F.lit("ar"))
    rules = Profile("r", (Rule("EMAIL", r"[a-z0-9]+@[a-z]+\.[a-z]+", needs="@"),), "greedy_first")
    got = {r.doc_id: [(e.start, e.end, e.text) for e in r.entities] for r in pipeline.detect_displayed(df.coalesce(1), rules).collect()}
    assert got == {k: [(t.index("a"), len(t), t[t.index("a") :])] for k, t in rows}
