"""Thresholds that learn: against a plain fold, in later batches of a scan, after a restart, and forgotten by a timer."""

import random
import shutil

from pyspark.sql import functions as F

from veilspark.functions.rules import Profile, Rule
from veilspark.streaming import adaptive, stream

SCHEMA = "method string, type string, ts int, false_positive boolean"
RULES = Profile("two", (Rule("EMAIL", r"[a-z]+@[a-z]+", 0.65, "loose"), Rule("EMAIL", r"[a-z]+@b", 0.9, "strict"), Rule("NUMBER", r"[0-9]+", 0.55, "loose")), "all")


def give(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def learn(spark, path, **options):
    adaptive.learn(stream.read_files(spark, f"{path}/in", SCHEMA, files_per_batch=1), f"{path}/learnt", f"{path}/c", **options)
    return {(r.method, r.type): (round(r.threshold, 6), r.false_positives, r.total) for r in adaptive.current(spark, f"{path}/learnt").collect()}


def plain(rows, start=0.5, rate=0.1, cap=0.95):
    """One find at a time, in order."""
    out = {}
    for method, kind, _, bad in rows:
        threshold, wrong, total = out.get((method, kind), (start, 0, 0))
        wrong, total = wrong + bool(bad), total + 1
        out[method, kind] = (min(cap, threshold + rate) if bad and wrong / total > 0.1 else threshold, wrong, total)
    return {k: (round(t, 6), w, n) for k, (t, w, n) in out.items()}


def test_as_a_plain_fold(spark, tmp_path):
    rng, rows = random.Random(4), []
    for part in range(3):  # files in turn, each out of order within
        more = [(rng.choice(["a", "b", None]), rng.choice(["X", "Y"]), part * 1000 + k, rng.choice([True, *[False] * 12, None])) for k in range(120)]
        rows += more
        give(spark, rng.sample(more, len(more)), tmp_path / "in")
        learn(spark, tmp_path)  # each call goes on from the state
    assert learn(spark, tmp_path) == plain(rows) and len(plain(rows)) == 6
    assert any(0.5 < t < 0.95 for t, _, _ in plain(rows).values())


def test_only_wrong_finds_raise_it(spark, tmp_path):
    give(spark, [("a", "X", k, k % 2 == 0) for k in range(6)] + [("b", "X", k, False) for k in range(6)] + [("c", "X", k, True) for k in range(9)], tmp_path / "in")
    assert learn(spark, tmp_path) == {("a", "X"): (0.8, 3, 6), ("b", "X"): (0.5, 0, 6), ("c", "X"): (0.95, 9, 9)}


def test_later_batches_use_what_was_learnt(spark, tmp_path):
    def scan():
        texts = stream.read_files(spark, f"{tmp_path}/texts", "id int, text string, lang string", files_per_batch=1)
        adaptive.detect(texts, f"{tmp_path}/learnt", f"{tmp_path}/out", f"{tmp_path}/scan", RULES)
        rows = adaptive.results(spark, f"{tmp_path}/out").select("id", F.explode_outer("entities").alias("e")).select("id", "e.method", "e.type", "e.text").collect()
        return sorted((r.id, r.method or "", r.text or "") for r in rows)

    def texts(k):
        give(spark, [(k, "x@a y@b 12", "en"), (k + 1, None, "en"), (k + 2, "", None)], tmp_path / "texts", "id int, text string, lang string")

    texts(0)
    first = scan()  # no table yet: the start's threshold
    assert first == [(0, "loose", "12"), (0, "loose", "x@a"), (0, "loose", "y@b"), (0, "strict", "y@b"), (1, "", ""), (2, "", "")]
    give(spark, [("loose", "EMAIL", k, True) for k in range(2)] + [("strict", "EMAIL", 1, True), ("other", "NUMBER", 1, True)], tmp_path / "in")
    learn(spark, tmp_path)
    texts(10)
    second = scan()  # loose e-mails, 0.65, are below 0.7; the strict rule's and numbers are not
    assert second == sorted([*first, (10, "loose", "12"), (10, "strict", "y@b"), (11, "", ""), (12, "", "")])
    # the last batch again, as after a failure before its commit, when more has been learnt
    give(spark, [("strict", "EMAIL", k, True) for k in range(9)], tmp_path / "in")
    learn(spark, tmp_path)
    (tmp_path / "scan/commits/1").unlink()
    (tmp_path / "scan/commits/.1.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out/results/batch=1")
    assert scan() == second
    texts(20)
    assert scan() == sorted([*second, (20, "loose", "12"), (21, "", ""), (22, "", "")])


def test_a_key_at_rest_is_forgotten(spark, tmp_path):
    import time

    give(spark, [("a", "X", 1, True)], tmp_path / "in")
    assert learn(spark, tmp_path, rest=2.0)["a", "X"] == (0.6, 1, 1)
    time.sleep(2.5)
    give(spark, [("b", "X", 1, False)], tmp_path / "in")
    assert learn(spark, tmp_path, rest=2.0) == {("a", "X"): (0.5, 0, 0), ("b", "X"): (0.5, 0, 1)}
