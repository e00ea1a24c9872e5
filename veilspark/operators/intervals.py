"""Interval join: spans of one document that overlap, by bins of positions.

Each span stands in every bin of `width` positions that it touches, so the join's key is (document, bin) and a document of
many spans is dealt over many tasks. A pair counts in the first bin that both touch, so it comes once however many they
share. Inner joins only meet spans that lie within one bin's reach of each other.

Defined results: null keys, starts and ends meet nothing; a span that ends where it starts, or before, has no positions and
overlaps nothing; equal rows on either side give a pair each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a bin. Longer spans are copied once for each bin.
WIDTH = 64


def binned(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """`spans` once for each of their bins, numbered in `__bin`."""
    return spans.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.expr(f"sequence(floor({start} / {width}), floor(({end} - 1) / {width}))")))


def overlapping(a: DataFrame, b: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Pairs of spans with a common position: `key`, the columns of `a` as a_<name> and those of `b` as b_<name>."""
    x, y = (t.select(key, *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c != key)) for t, p in ((a, "a"), (b, "b")))
    both = binned(x, "a_start", "a_end", width).join(binned(y, "b_start", "b_end", width), [key, "__bin"])
    first = F.floor(F.greatest("a_start", "b_start") / width) == F.col("__bin")
    return both.where(first & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))).drop("__bin")


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two spans that overlap."""
    inter = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return inter / (a_end - a_start + b_end - b_start - inter)


def pair_counts(a: DataFrame, b: DataFrame, kind: Column, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(key, kind, n): how many pairs of a document's spans are of each `kind` (an expression on a_ and b_ columns); NONE
    counts those that share no position, from the numbers of spans and not by pairing them."""
    met = overlapping(a, b, key, width).groupBy(key, kind.alias("kind")).agg(F.count("*").alias("n"))
    sizes = a.groupBy(key).agg(F.count("*").alias("n_a")).join(b.groupBy(key).agg(F.count("*").alias("n_b")), key)
    sum_met = met.groupBy(key).agg(F.sum("n").alias("n_met"))
    rest = sizes.join(sum_met, key, "left").select(key, F.lit("NONE").alias("kind"), (F.col("n_a") * F.col("n_b") - F.coalesce("n_met", F.lit(0))).alias("n"))
    return met.unionByName(rest.where("n > 0"))
