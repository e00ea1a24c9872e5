"""Vectors: exact nearest neighbours and document context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors and corpus vectors of a block, and pairs that are measured at a time.
BLOCK, CORPUS_BLOCK, STEP = 1_024, 4_096, 1 << 16
#: Blocks of queries whose best a task holds at a time, and what stands for a null key, which comes last of equals.
HELD, NO_KEY = 256, 2**63 - 1
#: Over the rounding of a product of matrices, relative to the squared lengths.
SLACK = 1e-9


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def blocks(table: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(ids, width, raw): runs of `size` rows at most of vectors of one length, as doubles. Vectors that are null or hold a null
    have width -1 and no bytes; a null key is NO_KEY."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                widths = part.column("width").to_numpy()
                for w in np.unique(widths):
                    same = part.filter(pa.array(widths == w))
                    flat = same.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([same.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([w], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["ids", "width", "raw"])

    whole = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull())
    none = F.array().cast("array<double>")
    # a table in one row group is read by one task: its rows are dealt over all of them
    rows = table.repartition(table.sparkSession.sparkContext.defaultParallelism).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.when(whole, F.size(vector)).otherwise(-1).alias("width"), F.when(whole, F.col(vector).cast("array<double>")).otherwise(none).alias("v"))
    return rows.mapInArrow(pack, "ids array<long>, width int, raw binary")


def in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, term by term from the first, as a fold adds them."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of `q` to the same rows of `x`."""
    if metric == "l2":
        return in_order((q - x) * (q - x))
    norm = np.sqrt(in_order(q * q)) * np.sqrt(in_order(x * x))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.where(norm > 0, in_order(q * x) / norm, np.where(np.isnan(norm), np.nan, 0.0))


def candidates(q: np.ndarray, x: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of x) of all pairs that can be among a query's k nearest, ties included.

    A product of matrices gives distances up to rounding; what lies within that of the k-th one stays. `bound`: the distance of
    each query's k-th nearest of earlier blocks; where all have one, the block's own k-th is only looked for if much stays.
    """
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    near = q @ x.T
    if metric == "l2":
        near *= -2
        near += qq[:, None]
        near += xx
        slack = SLACK * (qq + xx.max())
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            near *= -np.where(qq > 0, 1 / np.sqrt(qq), 0.0)[:, None]
            near *= np.where(xx > 0, 1 / np.sqrt(xx), 0.0)
        slack = np.full(len(q), SLACK)
    if len(x) <= k or not (np.isfinite(qq).all() and np.isfinite(xx).all()):
        return np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    if bound is not None and np.isfinite(bound).all():
        kth = bound if metric == "l2" else bound - 1
        open_ = near <= (kth + slack)[:, None]
        if np.count_nonzero(open_) <= STEP:
            return np.nonzero(open_)
        kth = np.minimum(kth, np.partition(near, k - 1, axis=1)[:, k - 1])
    else:
        kth = np.partition(near, k - 1, axis=1)[:, k - 1]
    return np.nonzero(near <= (kth + slack)[:, None])


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 5, *, key: str = "vec_id", vector: str = "embedding", metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """The k nearest corpus rows of each query: (query_id, rank, key, distance), exact; ties go to the smaller key.

    Blocks of queries meet blocks of the corpus, each pair as one product of matrices; what can be among the k nearest is
    measured term by term. A task keeps its own k best of a block of queries before anything is shuffled. Rows are dealt evenly
    over the tasks first, however the files hold them. Distances that are
    not defined, of vectors that are null, hold a null or differ in length, are null and come last. Keys are whole numbers.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"no metric {metric!r}")

    def matrix(raw: bytes, n: int, width: int) -> np.ndarray:
        return np.frombuffer(raw).reshape(n, max(0, width))

    def best(at: np.ndarray, ids: np.ndarray, d: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, d, unknown, at))
        _, first, n = np.unique(at[order], return_index=True, return_counts=True)
        order = order[np.arange(len(at)) - np.repeat(first, n) < k]
        return at[order], ids[order], d[order], unknown[order]

    def bound(n: int, so_far: tuple[np.ndarray, ...]) -> np.ndarray:
        at, _, d, unknown = so_far
        last, out = np.flatnonzero(np.bincount(at, minlength=n) == k), np.full(n, np.inf)
        ends = np.searchsorted(at, last, "right") - 1
        out[last] = np.where(unknown[ends] | np.isnan(d[ends]), np.inf, d[ends])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, tuple[np.ndarray, ...]]] = {}  # blocks of queries: their ids, and the best so far

        def out() -> Iterator[pa.RecordBatch]:
            for asked, (at, ids, d, unknown) in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids), pa.array(d, mask=unknown)], ["query_id", "id", "distance"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                asked, ids = (r[c].values.to_numpy() for c in ("q_ids", "ids"))
                name, q_width, width = (r[c].as_py() for c in ("q_block", "q_width", "width"))
                if q_width == width >= 0:
                    q, x = matrix(r["q_raw"].as_py(), len(asked), width), matrix(r["raw"].as_py(), len(ids), width)
                    at, j = candidates(q, x, k, metric, bound(len(q), held[name][1]) if name in held else None)
                    d = np.concatenate([np.zeros(0), *(exact(q[at[s : s + STEP]], x[j[s : s + STEP]], metric) for s in range(0, len(at), STEP))])
                else:  # nothing is known of these but their keys
                    j = np.argsort(ids, kind="stable")[:k]
                    at, j = np.repeat(np.arange(len(asked)), len(j)), np.tile(j, len(asked))
                    d = np.full(len(at), np.nan)
                new = (at, ids[j], d, np.full(len(at), not q_width == width >= 0))
                if name in held:
                    new = tuple(np.concatenate(both) for both in zip(held[name][1], new, strict=True))
                held[name] = (asked, best(*new))
                if len(held) > HELD:
                    yield from out()
        yield from out()

    q = blocks(queries, key, vector, block).withColumn("block", F.xxhash64("ids", "width", "raw"))
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "width", "raw")))
    found = q.crossJoin(blocks(corpus, key, vector, CORPUS_BLOCK)).mapInArrow(run, "query_id long, id long, distance double")
    order = (F.col("distance").asc_nulls_last(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    own = lambda c, kind: F.when(F.col(c) != NO_KEY, F.col(c)).cast(kind)
    return ranked.select(own("query_id", queries.schema[key].dataType).alias("query_id"), "rank", own("id", corpus.schema[key].dataType).alias(key), "distance")


def context(found: DataFrame, chunks: DataFrame, key: str = "vec_id", text: str = "text") -> DataFrame:
    """The texts of each query's neighbours, nearest first, joined by blank lines."""
    both = found.join(chunks.select(key, text), key)
    return both.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text]), "\n\n").alias("context"))


def similar_enough(a: Column, b: Column, least: float = 0.8) -> Column:
    """The merge test of word vectors."""
    return cosine(a, b) >= least


def fuzzy_equal(a: Column, b: Column, least: float = 80.0) -> Column:
    """One string in the other, or an edit-distance ratio over `least` (0 to 100)."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return x.contains(y) | y.contains(x) | (F.when(longest > 0, 100 * (1 - F.levenshtein(x, y) / longest)).otherwise(100.0) > least)
