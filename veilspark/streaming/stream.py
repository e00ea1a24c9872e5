"""Structured Streaming: the batch expressions on unbounded input. `adaptive` has the thresholds that learn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Profile
from ..plans import pipeline


def read_files(spark: SparkSession, path: str, schema: str, *, format: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A folder as a stream of small batches."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)


def redact(stream: DataFrame, name: str | Profile = "light", **options) -> DataFrame:
    """Stateless: the same columns as in batch."""
    return pipeline.analyze(stream, name, **options)


def redact_unique(stream: DataFrame, name: str | Profile = "light", *, time: str, delay: str = "1 hour", text: str = "text", **options) -> DataFrame:
    """Each distinct text once within the watermark."""
    once = stream.withColumn("text_sha256", F.sha2(F.col(text), 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_sha256"])
    return pipeline.analyze(once, name, text=text, **options)


def windowed_counts(df: DataFrame, *by: str, time: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows (sliding, with `slide`); late rows are dropped beyond the delay."""
    timed = df.withWatermark(time, delay) if df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(df: DataFrame, *by: str, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts in sessions that a pause of `gap` ends."""
    timed = df.withWatermark(time, delay) if df.isStreaming else df
    s = timed.groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, *, format: str = "parquet", mode: str = "append") -> None:
    """All that is there now, then stop; a later call goes on from the checkpoint."""
    stream.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
