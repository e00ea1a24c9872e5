"""Display forms against Java's implementation of the bidirectional algorithm, shapes by name, and the second scan."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspark.functions import bidi
from veilspark.functions.rules import Profile, Rule
from veilspark.plans import pipeline

AR_FULL = "اسمي محمد أحمد، هاتفي 0512345678 وبريدي mohammed.ahmed@example.sa وجوازي A1234567"
AR_DIGITS = "رقم الهاتف ٠٥١٢٣٤٥٦٧٨ للتواصل"
AR_TITLE = "السيد خالد (الرياض) قال: 100% صحيح"


def test_levels_are_javas(spark):
    rng, java = random.Random(4), spark._jvm.java.text.Bidi
    letters = "ab אב ابل 12٣٤ +-.,:/%$ !\t"
    for _ in range(400):
        line = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))
        if not set(line) & set("אבال"):  # Java does not resolve lines that run one way
            continue
        want = java(line, java.DIRECTION_DEFAULT_LEFT_TO_RIGHT)
        assert bidi.levels(list(line)) == [want.getLevelAt(i) for i in range(len(line))], repr(line)


def test_shapes_of_words():
    def names(text):
        return [unicodedata.name(c).removeprefix("ARABIC ").removesuffix(" FORM") for c in bidi.shaped(text)[0]]

    assert names("محمد") == ["LETTER MEEM INITIAL", "LETTER HAH MEDIAL", "LETTER MEEM MEDIAL", "LETTER DAL FINAL"]
    assert names("دار") == ["LETTER DAL ISOLATED", "LETTER ALEF ISOLATED", "LETTER REH ISOLATED"]
    assert names("سلام") == ["LETTER SEEN INITIAL", "LIGATURE LAM WITH ALEF FINAL", "LETTER MEEM ISOLATED"]
    assert names("لا") == ["LIGATURE LAM WITH ALEF ISOLATED"] and names("ء") == ["LETTER HAMZA ISOLATED"]
    assert bidi.shaped("مُحَ")[1:] == ([0, 2], [1, 3])


@pytest.mark.parametrize("text", [AR_FULL, AR_DIGITS, AR_TITLE, "he said سلام.\nb (أحمد)", "سلام\n\nلا"])
def test_ranges_cover_the_source(text):
    shown, first, last = bidi.display(text)
    ranges = sorted(zip(first, last, strict=True))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text) - 1 and all(b[0] == a[1] + 1 for a, b in zip(ranges, ranges[1:], strict=False))
    for c, a, z in zip(shown, first, last, strict=True):
        bare = re.sub("[ً-ْ]", "", text[a : z + 1])
        assert unicodedata.normalize("NFKC", c) in (unicodedata.normalize("NFKC", bare), bidi.MIRRORED.get(bare))
    assert [len(x) for x in shown.split("\n")] != [] and shown.count("\n") == text.count("\n")


RULES = Profile("r", (Rule("EMAIL", r"[a-z.]+@[a-z.]+\.[a-z]{2}", needs="@"), Rule("PHONE_NUMBER", r"\d{10}"), Rule("PASSPORT", r"\b[A-Z]\d{7}\b"), Rule("TURNED", "ﺪﻤﺤﻣ")), "greedy_first")


def rows(spark, *texts):
    return spark.createDataFrame([(i, t, "ar") for i, t in enumerate(texts)], "doc_id int, text string, lang string")


def test_second_scan_of_fixtures(spark):
    df = rows(spark, AR_FULL, AR_DIGITS, AR_TITLE)
    got = {r.doc_id: [(e.type, e.text, e.start, e.end) for e in r.entities] for r in pipeline.detect_displayed(df, RULES).collect()}
    place = lambda t, x: (x, t.index(x), t.index(x) + len(x))
    assert got[0] == [("TURNED", *place(AR_FULL, "محمد")), ("PHONE_NUMBER", *place(AR_FULL, "0512345678")), ("EMAIL", *place(AR_FULL, "mohammed.ahmed@example.sa")), ("PASSPORT", *place(AR_FULL, "A1234567"))]
    assert got[1] == [("PHONE_NUMBER", *place(AR_DIGITS, "٠٥١٢٣٤٥٦٧٨"))] and got[2] == []


def test_second_scan_changes_nothing_else(spark):
    texts = [None, "", "plain a.b@x.org 0123456789", "سلام", "a.b@x.org سلام", "١٢٣", "x" * 30_000 + " سلام 0123456789"]
    df = rows(spark, *texts)
    plain = {r.doc_id: r.entities for r in pipeline.detect(df, RULES).collect()}
    shown = pipeline.detect_displayed(df, RULES).withColumn("masked", pipeline.redacted(F.col("text"), F.col("entities"), "tag")).collect()
    for r in shown:
        assert [(e.type, e.start, e.end) for e in r.entities] == [(e.type, e.start, e.end) for e in plain[r.doc_id]]
        assert r.masked == texts[r.doc_id] if not r.entities else r.masked != texts[r.doc_id]
    assert {r.doc_id for r in df.where(bidi.displayed(F.col("text")).isNotNull()).collect()} == {3, 4, 5, 6}
    assert pipeline.detect_displayed(df.limit(0), RULES).count() == 0
