"""Exact nearest neighbours by pivots: distances to a few chosen vectors rule out most of the table.

`build` chooses pivots, deals the vectors to cells by their nearest pivot and writes blocks: runs of a cell in order of the
distance to its pivot, with the least and greatest distance to every pivot. By the triangle inequality a query's distance to
a vector is no less than the difference of their distances to any pivot. `search` first meets each block of queries with the
blocks that can be nearest, which bounds the distance of each query's k-th neighbour, and then with those alone that can hold
one within the bound; within a block, vectors whose own bound is over it are left out before distances are computed.

Pivots are far from each other: the first is the sample's mean's furthest vector, each next the furthest from those before.
The sample they are chosen from is bounded; every vector is indexed and nothing is approximate.

Defined results: rows with a null key or vector, or of another length than the first pivot, are neither indexed nor asked
for. Fewer than k vectors give as many ranks. Ties go to the smaller key. An empty index or query table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pivots, vectors of the sample they are chosen from, vectors of a block, queries of a block.
PIVOTS, SAMPLE, BLOCK, QUERIES = 16, 2_000, 512, 256
#: Blocks that a block of queries meets first.
FIRST = 2
#: Slack for rounding in bounds: relative and absolute.
SLACK, LEAST = 1e-6, 1e-9
#: Over the rounding of a product of matrices, relative to the squared lengths.
ROUNDING = 1e-9
BLOCKS = "block long, cell int, ids array<long>, n int, vectors binary, far binary, low array<double>, high array<double>"


def checkpoint_dir(spark: SparkSession) -> None:
    """Sets the folder that spark.checkpoint.dir names for checkpoints; a temporary one only where that is unset and the master local."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilspark-"))


def written(df: DataFrame) -> DataFrame:
    """`df` from a checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def choose(table: DataFrame, key: str, vector: str, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots [p, d] from `sample` vectors, those with the least hashes of their keys."""
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(5), F.col(key)), key).select(vector).limit(sample).collect()
    if not rows:
        return np.empty((0, 0))
    size = len(rows[0][0])
    x = np.array([r[0] for r in rows if len(r[0]) == size], float)
    chosen = [int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances [len(a), len(b)], each by its differences."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = ((b - row) ** 2).sum(1)
    return out


def blocks(table: DataFrame, chosen: np.ndarray, key: str, vector: str, size: int) -> DataFrame:
    """BLOCKS of `table`: a cell's vectors in order of their distance to its pivot, `size` to a block at most."""
    width = chosen.shape[1] if len(chosen) else 0
    rows = table.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            far = np.sqrt(distances(x, chosen))
            cell = far.argmin(1)
            raw = [pa.array([r.tobytes() for r in t], pa.binary()) for t in (x, far)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell]), *raw], ["id", "cell", "near", "x", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            far = np.frombuffer(b"".join(r[3] for r in held)).reshape(len(held), -1)
            one = [[number], [held[0][1]], [[r[0] for r in held]], [len(held)], [b"".join(r[2] for r in held)], [far.tobytes()], [far.min(0).tolist()], [far.max(0).tolist()]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds, strict=True)], ["block", "cell", "ids", "n", "vectors", "far", "low", "high"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "cell", "x", "far")), strict=True):
                if held and (len(held) == size or held[0][1] != row[1]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    if not width:
        return table.sparkSession.createDataFrame([], BLOCKS)
    placed = rows.mapInArrow(place, "id long, cell int, near double, x binary, far binary")
    # ranges of (cell, distance) split a cell over many partitions, so a crowded one is no task of its own
    dealt = placed.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id")
    return dealt.mapInArrow(cut, BLOCKS)


def build(table: DataFrame, path: str, *, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, size: int = BLOCK) -> np.ndarray:
    """Writes the index of `table` under `path` and gives its pivots, which are written too."""
    spark, chosen = table.sparkSession, choose(table, key, vector, pivots)
    blocks(table, chosen, key, vector, size).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(chosen)], "pivot int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    return chosen


def load(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    """(blocks, pivots) of an index."""
    rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    return spark.read.parquet(f"{path}/blocks"), np.array([r.vector for r in rows], float)


def met(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, d, computed) of pairs of blocks (q_*, x_*): each query's k nearest of the block within its bound.

    computed: on a query's first row of a pair, how many distances were computed for it; rows without an id only count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                q, x = (np.frombuffer(r[f"{s}_vectors"]).reshape(r[f"{s}_n"], -1) for s in "qx")
                qf, xf = (np.frombuffer(r[f"{s}_far"]).reshape(r[f"{s}_n"], -1) for s in "qx")
                ids, bound = np.array(r["x_ids"]), np.array(r["bound"] or [np.inf] * len(q))
                out: list[tuple] = []
                # a product of matrices gives distances up to rounding: only what can be among the k nearest is measured by differences
                xx = (x * x).sum(1)
                rough = xx - 2 * (q @ x.T)
                slack = ROUNDING * ((q * q).sum(1) + xx.max())
                gap = np.zeros((len(q), len(x)))  # the widest difference of their distances to a pivot
                for p, far in enumerate(np.ascontiguousarray(xf.T)):
                    np.maximum(gap, np.abs(qf[:, p, None] - far), out=gap)
                for i, one in enumerate(q):
                    open_ = np.flatnonzero(gap[i] <= bound[i] * (1 + SLACK) + LEAST) if np.isfinite(bound[i]) else np.arange(len(x))
                    n = len(open_)
                    if n > k and np.isfinite(slack[i]):
                        some = rough[i, open_]
                        open_ = open_[some <= np.partition(some, k - 1)[k - 1] + slack[i]]
                    d = ((x[open_] - one) ** 2).sum(1)
                    best = np.lexsort((ids[open_], d))[:k]
                    out += [(r["q_ids"][i], int(ids[open_[j]]), float(d[j]), 0) for j in best]
                    out.append((r["q_ids"][i], None, None, n))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "id", "d", "computed"])

    return pairs.mapInArrow(run, "query_id long, id long, d double, computed long")


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("d", "id")
    return found.where("id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: DataFrame, pivots: np.ndarray, k: int = 5, *, key: str = "vec_id", vector: str = "embedding", size: int = QUERIES) -> DataFrame:
    """(query_id, rank, key, distance, computed): the k nearest of the index by squared distance, and how many distances each query took."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "n", "vectors", "far", "low", "high")))

    asked, held = side(written(blocks(queries, pivots, key, vector, size)), "q"), side(index, "x")
    # how near a vector of one block can be to one of the other: the widest gap of their ranges to a pivot
    apart = F.zip_with(F.arrays_zip("q_low", "q_high"), F.arrays_zip("x_low", "x_high"), lambda q, x: F.greatest(q["q_low"] - x["x_high"], x["x_low"] - q["q_high"], F.lit(0.0)))
    # blocks, not vectors, are set against each other: a stated query set against all rows
    pairs = asked.select("q_block", "q_low", "q_high").join(held.select("x_block", "x_low", "x_high")).select("q_block", "x_block", F.array_max(apart).alias("gap"))
    first = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("q_block").orderBy("gap", "x_block")))
    first = written(first.where(F.col("turn") <= FIRST).select("q_block", "x_block"))
    begun = written(met(asked.join(first, "q_block").join(held, "x_block").withColumn("bound", F.lit(None).cast("array<double>")), k))
    # a query with fewer than k so far has no bound
    kth = top(begun, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.sqrt(F.max("d"))).alias("kth"))
    every = asked.select("q_block", F.posexplode("q_ids").alias("at", "query_id")).join(kth, "query_id", "left")
    bounds = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("kth", F.lit(float("inf"))).alias("r")))), lambda x: x["r"])
    limits = every.groupBy("q_block").agg(bounds.alias("bound"))
    near = F.col("gap") <= F.array_max("bound") * (1 + SLACK) + LEAST
    rest = pairs.join(first, ["q_block", "x_block"], "left_anti").join(limits, "q_block").where(near)
    found = met(asked.join(rest.select("q_block", "x_block", "bound"), "q_block").join(held, "x_block"), k).unionByName(begun)
    found = written(found)
    took = found.groupBy("query_id").agg(F.sum("computed").alias("computed"))
    return top(found.drop("computed"), k).join(took, "query_id").select("query_id", "rank", F.col("id").alias(key), F.col("d").alias("distance"), "computed")
