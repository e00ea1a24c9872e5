"""Toxicity: the formula of the learner, scores by a plain sum, held-out accuracy, defined results of odd rows."""

import math
import re
import zlib
from functools import partial

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from veilspark.llm import common, queries, toxicity

SF = "/root/testdata/sf0.01"


def plain_features(text):
    words, out, full = re.findall(r"\w+", (text or "").lower()), set(), 2**64 - 1
    for k, w in enumerate(words):
        h = xxh64_intdigest(w, 3)
        out.add((h * 0x9E3779B97F4A7C15 & full) >> 32)
        out |= {xxh64_intdigest(w[:n], n) >> 32 for n in (4, 5, 6) if len(w) >= n}
        for step, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
            if k + step < len(words):
                out.add(((h * odd + xxh64_intdigest(words[k + step], 3)) * 0x9E3779B97F4A7C15 & full) >> 32)
    return out


def test_query_is_a_plain_sum(spark):
    labels = common.read(spark, SF, "labels").where(common.fold(common.F.col("doc_id"), 5) != 0)
    docs = common.read(spark, SF, "documents")
    w = toxicity.fit(docs, labels)
    table = dict(zip(w.numbers.tolist(), w.values.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op13_toxicity(spark, SF).collect()
    assert len(rows) == len(texts) and 0 < len(table) < 20_000 and 0.0 not in table.values()
    for r in rows:
        want = 1 / (1 + math.exp(-(w.bias + math.fsum(table.get(f, 0.0) for f in plain_features(texts[r.doc_id])))))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out(spark):
    labels = {r.doc_id: r.toxic for r in common.read(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in queries.op13_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([p for p, y in held if y == 1]) > 0.85 and np.mean([p for p, y in held if y == 0]) < 0.01


def test_learner_follows_the_formula():
    docs, y = [np.array([3, 5], np.uint32), np.array([5], np.uint32), np.array([], np.uint32)], np.array([1.0, 0.0, 1.0])
    w = toxicity.train_ftrl(docs, y, alpha=0.5, beta=1.0, l1=0.3, l2=0.1, rounds=2)
    z, n, bound = np.zeros(3), np.zeros(3), np.array([0.3, 0.3, 0.0])  # features 3, 5, bias
    weigh = lambda: np.where(np.abs(z) <= bound, 0, (np.sign(z) * bound - z) / ((1 + np.sqrt(n)) / 0.5 + 0.1))
    for x, t in [(np.array([1, 1, 1]), 1.0), (np.array([0, 1, 1]), 0.0), (np.array([0, 0, 1]), 1.0)] * 2:
        v = weigh()
        g = (1 / (1 + math.exp(-v @ x)) - t) * x
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5
        z, n = z + g - s * v, n + g * g
    want = dict(zip((3, 5), weigh()[:2], strict=True))
    assert {k: pytest.approx(v) for k, v in want.items() if v} == dict(zip(w.numbers.tolist(), w.values.tolist(), strict=True))
    assert w.bias == pytest.approx(weigh()[2])


def test_rare_features_change_nothing():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60).astype(float)
    common_ = [np.flatnonzero(rng.random(9) < 0.2 + 0.6 * t).astype(np.uint32) for t in y]
    rare = [np.append(d, np.uint32(100 + k // 2)) for k, d in enumerate(common_)]
    a, b = (toxicity.train_ftrl(d, y, l1=6.0, rounds=3) for d in (common_, rare))
    assert len(a.numbers) and np.array_equal(a.numbers, b.numbers) and np.array_equal(a.values, b.values) and a.bias == b.bias
    assert len(toxicity.train_ftrl([np.array([], np.uint32)], np.array([1.0])).numbers) == 0


def test_new_forms_and_long_texts_are_caught(spark):
    calm = "the plain river runs past old stone walls in summer " * 3
    docs = [(k, calm + (f"blorg{chr(97 + k % 20)}x " if k % 2 else "") + f"end{k}") for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    w = toxicity.fit(df, labels)
    test = spark.createDataFrame([(1, calm * 2000 + "blorgunseen"), (2, calm * 2000), (3, "blorgunseen")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(test, w).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] < 0.5


def test_odd_rows(spark):
    odd = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "word " * 30_000), (6, "é"), (6, "é"), (7, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, 9, 2.0) for i, t in odd], "doc_id long, text string, label int, score double").repartition(2)
    fit = partial(toxicity.fit, df)
    assert fit(spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.5}
    w = fit(spark.createDataFrame([(5, 1), (4, 0), (4, 1), (None, 1), (1, 0), (6, 3), (7, None)], "doc_id long, toxic int"))
    got = toxicity.score(df, w).collect()
    assert len(got) == len(odd) and all(0 < r.score < 1 and r.label == 9 for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 1, 2, 3)}) == 1
    assert toxicity.score(df.limit(0), w).collect() == []
    small = toxicity.fit(df, spark.createDataFrame([(5, 1), (4, 0), (7, 1)], "doc_id long, toxic int"), sample_rows=1)
    assert small is None or small.bias != 0
