"""Nearest neighbours by products of blocks against all pairs."""

import numpy as np
import pytest

from veilspark.operators import retrieve


def dot(a, b):
    """Term by term, as a fold adds; Python's sum() makes up for rounding."""
    out = 0.0
    for s, t in zip(a.tolist(), b.tolist(), strict=True):
        out += s * t
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocks_are_exact_and_odd_rows_come_last(spark, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[40:60] = x[3]  # copies: ties go to the smaller key
    x[60:70] = x[50] + 1e-7 * rng.normal(size=(10, 6))  # nearer than the rounding of a product may show
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (92, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    got = retrieve.nearest(df.where("vec_id % 5 = 0"), df, 4, metric=metric, block=7).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    for q in range(0, 91, 5):
        if q == 90:
            assert by[q] == [(0, None), (1, None), (2, None), (3, None)]
            continue
        want = []
        for i, v in enumerate(x):
            norm = dot(x[q], x[q]) ** 0.5 * dot(v, v) ** 0.5
            want.append((dot(x[q] - v, x[q] - v) if metric == "l2" else 1 - (dot(x[q], v) / norm if norm > 0 else 0.0), i))
        assert by[q] == [(i, d) for d, i in sorted(want)[:4]]


def test_few_vectors_give_as_many_ranks(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [3.0]), (None, [2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in retrieve.nearest(df.where("vec_id = 0"), df, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 0, 0.0), (0, 2, None, 1.0), (0, 3, 20, 4.0)]
    assert retrieve.nearest(df.limit(0), df).collect() == [] and retrieve.nearest(df, df.limit(0)).collect() == []
    assert retrieve.nearest(df, df, 1).count() == 3


def test_rows_of_one_partition_are_dealt_over_the_tasks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id int, embedding array<double>").coalesce(1)
    assert retrieve.blocks(df, "vec_id", "embedding", 8).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_bound_of_earlier_blocks_leaves_only_what_is_within_it(metric):
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(5, 8)), rng.normal(size=(300, 8))
    every = np.array([retrieve.exact(np.repeat(one[None], len(x), 0), x, metric) for one in q])
    bound = np.sort(every, axis=1)[:, 1]  # the second nearest: of the block's four nearest only two can matter
    at, j = retrieve.candidates(q, x, 4, metric, bound)
    assert sorted(zip(at.tolist(), j.tolist(), strict=True)) == sorted(zip(*(v.tolist() for v in np.nonzero(every <= bound[:, None])), strict=True))
    assert len(retrieve.candidates(q, x, 4, metric, np.full(5, np.inf))[0]) == 20


def test_pairs_of_pivot_blocks_keep_ties_and_count_what_lies_within_the_bound(spark):
    from veilspark.operators import pivots

    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6))
    x[50:90] = x[3]  # more copies than are asked for: the smaller keys win
    x[90:99] = x[3] + 1e-9 * rng.normal(size=(9, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    chosen = pivots.choose(df, "vec_id", "embedding", 4)
    index = pivots.blocks(df, chosen, "vec_id", "embedding", 64)
    got = pivots.search(df.where("vec_id % 3 = 0"), index, chosen, 4, size=16).collect()
    assert len(got) == 4 * 67 and all(4 <= r.computed <= 200 for r in got)
    for q in range(0, 200, 3):
        d = ((x - x[q]) ** 2).sum(1)
        assert [(r.vec_id, r.distance) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(j, d[j]) for j in np.lexsort((np.arange(200), d))[:4]]
