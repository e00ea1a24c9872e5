"""Pieces of Arrow batches: what a Python function makes of texts at a time is bounded, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of texts that are worked on at a time, besides those of a single longer one.
BYTES = 1 << 18
#: Spark's setting for the bytes of an Arrow batch, its default, and what is put for that.
BATCH_BYTES, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches are no longer of Spark's default size: JVM and workers hold a few for every running task."""
    if df.sparkSession.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_BYTES, str(BATCH))
    return df


def pieces(texts: pa.Array, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows of about `size` bytes of text each; together all rows."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first = held = 0
    for i, n in enumerate(lengths):
        if i > first and held + n > size:
            yield first, i - first
            first, held = i, 0
        held += n
    if len(lengths) > first:
        yield first, len(lengths) - first


def offsets(counts: list[int]) -> pa.Array:
    """Where each list begins and the last one ends, from their lengths."""
    out = [0]
    for n in counts:
        out.append(out[-1] + n)
    return pa.array(out, pa.int32())
