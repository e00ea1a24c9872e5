"""What the operators of this subpackage share: tables, the shared folder, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java and RE2 agree on this class: words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local, as in tests on one machine, a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone before the interpreter ends
            return


atexit.register(_sweep)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; deleted when the application ends."""
    path = f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where the tables of `materialize` lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that `materialize` gave and that nothing reads any more."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)):
            drop_path(table.sparkSession, path)
            _written.remove((table.sparkSession, path))


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each of `names` one that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Spark's setting for the bytes of an Arrow batch, and its default.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of a batch that are worked on at a time, besides those of a single longer row.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows of SLICE_BYTES or so each: what a function makes of them is bounded alike."""
    n, at = batch.num_rows, 0
    if batch.nbytes <= 2 * SLICE_BYTES or n == 1:
        yield batch
        return
    sizes = sum(_row_bytes(c) for c in batch.columns)
    ends = np.cumsum(sizes)
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _row_bytes(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        if column.null_count == len(column):
            return np.zeros(len(column), np.int64)
        return np.diff(np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]).astype(np.int64)
    return np.full(len(column), column.nbytes // max(1, len(column)), np.int64)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with state: `make` runs once per task and returns the function for its batches, which come in slices.

    What another operator has kept in the worker goes first. Where the session leaves the bytes of an Arrow batch at
    Spark's default, they are set to those of two slices: JVM and worker each hold a few batches for every running task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(make)
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                yield each(part)
        _trim()

    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, str(2 * SLICE_BYTES))
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def replaced(batch: pa.RecordBatch, drop: list[str], **added: pa.Array) -> pa.RecordBatch:
    """The batch without the columns `drop`, with the columns `added` at its end."""
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added.values()], [*names, *added])


#: What a worker process keeps between tasks: one cache or model, with its key.
_kept: dict[object, object] = {}
_asked = False


def begun(make: Callable[[], object]) -> object:
    """make()'s value at the start of a task; if it keeps nothing, what the worker has kept goes."""
    global _asked
    _asked = False
    each = make()
    if not _asked:
        _let_go()
    return each


def _trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _let_go() -> None:
    if _kept:
        _kept.clear()
        gc.unfreeze()
        gc.collect()
        _trim()


def keep(key: object, make: Callable[[], object]) -> object:
    """make()'s value, made once for each worker process and key. Another key takes its place, as does a task of
    `arrow_map` that keeps nothing: workers that Spark uses again for other operators do not hold on to their caches."""
    global _asked
    _asked = True
    if key not in _kept:
        _let_go()
        _kept[key] = make()
    return _kept[key]


#: Texts of more bytes are not learnt from: with the number of rows this bounds what one task holds.
SAMPLE_TEXT_BYTES = 1 << 17


def labelled_sample(docs: DataFrame, labelled: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About `rows` rows of `labelled` (all of them if it has fewer), joined to `docs` (key, text) on `key`.

    The choice is by a hash of the key, the same at each run. What is broadcast is the
    sample's keys and labels, so its size is bounded by `rows`. Texts of over SAMPLE_TEXT_BYTES stay out.
    """
    docs = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    total = labelled.count()
    share = 1 << 30
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(share)) < int(share * rows / total))
    return docs.join(F.broadcast(labelled), key)


def in_one_task(df: DataFrame, train: Callable[[pa.Table], bytes], order: list[str]) -> bytes:
    """train()'s value over all rows of a sample that is bounded in rows and bytes, in one task on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([train(pa.Table.from_batches(found))], pa.binary())], ["model"])

    rows = df.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return bytes(rows[0][0]) if rows else b""


def packed(**arrays) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}
