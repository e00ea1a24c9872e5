"""Forest and threshold of the quality rules come from all labelled rows."""

import copy

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import common, quality_rules

SF = "/root/testdata/sf0.01"


def test_long_texts_are_learnt_from(spark):
    rows = [(k, " ".join(f"w{i * (k + 3) % 49_999}" for i in range(30_000))) for k in range(6)]
    assert all(len(t) > 1 << 17 for _, t in rows)
    labels = spark.createDataFrame([(k, int(k < 4)) for k, _ in rows], "doc_id long, quality int")
    assert quality_rules.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels) is not None


def test_threshold_is_that_of_all_labelled_rows(spark):
    docs, labels = common.read(spark, SF, "documents").select("doc_id", "text"), common.read(spark, SF, "labels")
    counted = quality_rules.statistics(docs)
    forest = quality_rules.learn(counted, labels)
    rows = counted.join(labels, "doc_id").select("quality", *quality_rules.COUNTS).toPandas()
    x, junk = rows[list(quality_rules.COUNTS)].to_numpy(np.int64), rows["quality"].to_numpy() == 0
    ok = ~quality_rules.base_failed(x)
    plain = copy.copy(forest)
    for weight in (10.0, 0.1):
        plain.threshold = 1.0
        plain.calibrate(quality_rules.features(x[ok]), junk[ok], weight)
        scores = spark.createDataFrame([(float(s), bool(j)) for s, j in zip(forest.score(quality_rules.features(x[ok])), junk[ok], strict=True)], "score double, junk boolean")
        assert abs(quality_rules.least_error(scores, weight) - plain.threshold) < 1e-12
    assert quality_rules.least_error(scores.where("junk"), 1.0) == 1.0


def test_each_tree_draws_from_all_rows(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), *(F.col("id").alias(c) for c in quality_rules.COUNTS))
    got = quality_rules.drawn(rows, 3_000, 20, 256).toPandas()
    assert (got.groupby("tree").n_words.nunique() == 256).all() and got.tree.nunique() == 20
    assert got.n_words.nunique() > 0.75 * 3_000  # 1 - (1 - 256 / 3000) ** 20 = 0.83
