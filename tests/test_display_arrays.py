"""Display forms of many lines at once: the work in Python does not grow with the texts, and what it gives is that of each line."""

import random
import sys

from pyspark.sql import functions as F

import __spark_entry__
from veilspark.functions import bidi

TEXT = "سلام (محمد) 12-34\nplain a.b@x.org ٣٤٪ لا\n\nשלום 5% [x]"


def calls(work):
    seen = 0

    def count(frame, event, arg):
        nonlocal seen
        seen += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return seen


def test_calls_do_not_grow_with_the_text():
    shown, first, _ = bidi.display(TEXT)  # makes the tables
    few, many = calls(lambda: bidi.display(TEXT)), calls(lambda: bidi.display(TEXT * 50))
    assert many <= 1.5 * few


def test_lines_of_many_texts_are_javas(spark):
    rng, java = random.Random(5), spark._jvm.java.text.Bidi
    letters = "ab אבגד 12٣٤ +-.,:/%$ !\t\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(150)]

    def turned(line):
        if not set(line) & set("אבגד"):
            return None
        levels = java(line, java.DIRECTION_DEFAULT_LEFT_TO_RIGHT)
        order = list(range(len(line)))
        level = [levels.getLevelAt(i) for i in order]
        for n in (2, 1):
            i = 0
            while i < len(order):
                j = i
                while j < len(order) and level[order[j]] >= n:
                    j += 1
                order[i:j] = order[i:j][::-1]
                i = max(j, i + 1)
        return "".join(line[i] for i in order)

    for text, shown in zip(texts, bidi.some(texts).to_pylist(), strict=True):
        assert [text[i] for i in shown["first"]] == list(shown["text"]) and shown["first"] == shown["last"]
        for line, got in zip(text.split("\n"), shown["text"].split("\n"), strict=True):
            assert turned(line) in (None, got)


def test_display_forms_are_undone(spark):
    texts = [None, "", "plain", "سلام", TEXT, "مُحَمَّد لا لأ لآ لإ", "ـسـ 😀 سلام 𐤀", "َسلام"]
    marks = str.maketrans("", "", "ًٌٍَُِّْ")
    df = spark.createDataFrame(list(enumerate(texts * 30)), "k int, t string").coalesce(1).withColumn("shown", bidi.displayed(F.col("t")))
    got = df.withColumn("undone", bidi.undone(F.coalesce("shown.text", "t"), F.col("shown.first"))).collect()
    apart = str.maketrans("", "", "()[]")  # mirrored, as which they stay
    for r in got:
        assert (r.shown is None) == (r.t is None or r.t in ("", "plain")) and (r.undone is None) == (r.t is None)
        assert r.undone is None or r.undone.translate(apart) == r.t.translate(marks).translate(apart)
    assert len(got) == len(texts) * 30


def test_forms_are_put_back_without_a_sort(spark):
    plan = __spark_entry__.queries()["display_forms_undone"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and plan.count("ArrowEvalPython") == 2


def test_display_pass_makes_the_forms_once(spark):
    plan = __spark_entry__.queries()["display_pass_entities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
