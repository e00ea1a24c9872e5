"""Folds over the spans of long texts against plain Python."""

import random

from pyspark.sql import functions as F

from veilspark.functions import mask
from veilspark.operators import resolve
from veilspark.operators.scan import SPANS
from veilspark.plans import pipeline
from veilspark.plans.queries import QUERIES


def spans(found):
    return sorted((a, -s, k, z, "T", "x", s, "m") for k, (a, z, s) in enumerate(found))


def test_spans_that_end_are_not_compared_and_the_result_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        at = [rng.randrange(60) for _ in range(rng.randrange(30))]
        rows.append((i, spans([(a, a + rng.randrange(12), rng.choice((0.3, 0.5, 0.8))) for a in at])))

    def plain(found, least):
        kept = []
        for s in found:
            def iou(k, s=s):
                both = max(0, min(k[3], s[3]) - max(k[0], s[0]))
                whole = k[3] - k[0] + s[3] - s[0] - both
                return both / whole if whole > 0 else 0.0
            alike = [n for n, k in enumerate(kept) if iou(k) >= least]
            worse = [n for n in alike if kept[n][6] < s[6]]
            if not alike:
                kept.append(s)
            elif worse:
                kept[worse[0]] = s
        return sorted(kept)

    df = spark.createDataFrame(rows, f"i int, s {SPANS}")
    for least in (0.5, 0.1, 0.0):
        for r in df.select("s", resolve.by_iou(F.col("s"), least).alias("kept")).collect():
            assert [tuple(k) for k in r.kept] == plain([tuple(k) for k in r.s], least)


def test_parts_are_cut_from_blocks(spark):
    size = 1 << pipeline.BLOCK_BITS
    text = "".join(random.Random(5).choices("abcdeéش𝒳 ", k=3 * size))  # ends at the end of a block
    found = spans([(0, 3, 0.5), (size - 2, size, 0.5), (size, size + 4, 0.5), (size + 2, size + 9, 0.5), (2 * size - 1, 2 * size + 1, 0.5), (3 * size - 1, 3 * size, 0.5)])
    df = spark.createDataFrame([(text, found), ("", []), (None, [])], f"t string, s {SPANS}")
    for kind in ("tag", "spaced_tag"):
        got = [r[0] for r in df.select(pipeline.redacted(F.col("t"), F.col("s"), kind)).collect()]
        want, pos = "", 0
        for s in found:
            before = text[s[0] - 1] if s[0] else ""
            covered = s[5] if s[0] >= pos else text[pos : s[3]]
            one = spark.range(1).select(mask.MASKS[kind](F.lit("T"), F.lit(covered), F.lit(before))).first()[0]
            want, pos = want + text[pos : s[0]] + one, max(pos, s[3])
        assert got == [want + text[pos:], "", None]


def test_dense_profiles_scan_in_one_arrow_call(spark):
    plan = QUERIES["profile_chunked"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
