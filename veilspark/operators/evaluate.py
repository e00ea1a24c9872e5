"""Evaluation: predicted against true entities, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = ("start", "end", "type")


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def matched(pred: DataFrame, truth: DataFrame, key: str = "doc_id", on: tuple[str, ...] = EXACT) -> DataFrame:
    """One-to-one matches on equal `on`: the n-th of equal predictions with the n-th of equal truths."""
    keys = [key, *on]
    p, t = (_numbered(x.select(*keys, *(c for c in ("score",) if c in x.columns)), keys, keys) for x in (pred, truth))
    return p.join(t.drop("score"), [*keys, "__k"])


def outcomes(pred: DataFrame, truth: DataFrame, key: str = "doc_id", on: tuple[str, ...] = EXACT) -> DataFrame:
    """A row for each prediction and each missed truth, with its outcome: tp, fp or fn."""
    keys = [key, *on]
    p, t = _numbered(pred.select(*keys), keys, keys), _numbered(truth.select(*keys), keys, keys)
    full = p.withColumn("in_p", F.lit(1)).join(t.withColumn("in_t", F.lit(1)), [*keys, "__k"], "full_outer")
    return full.select(*keys, F.when(F.col("in_t").isNull(), "fp").when(F.col("in_p").isNull(), "fn").otherwise("tp").alias("outcome"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def by_type(found: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and support for each type of `outcomes`."""
    counts = found.groupBy("type").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))
    return counts.select("type", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def averages(metrics: DataFrame) -> DataFrame:
    """Macro averages (of types) and micro ones (of sums) of `by_type`."""
    s = metrics.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    micro = [c.alias(f"micro_{n}") for c, n in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)]
    return s.select("macro_precision", "macro_recall", "macro_f1", *micro)


def score_error(pred: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean absolute difference of the scores of matched entities, by type."""
    p, t = pred.select(key, *EXACT, F.col("score").alias("p")), truth.select(key, *EXACT, F.col("score").alias("t"))
    return p.join(t, [key, *EXACT]).groupBy("type").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))


def leaks(masked: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many true entity texts each masked text still has."""
    both = masked.select(key, "masked_text").join(truth.select(key, F.col("text").alias("entity")), key)
    return both.groupBy(key).agg(F.count_if(F.col("masked_text").contains(F.col("entity"))).alias("leaks"), F.count("*").alias("entities"))


def agreement(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sizes of the intersection and differences of two detectors' (key, text, type) sets; b as the truth."""
    x, y = (d.select(key, "text", "type").distinct() for d in (a, b))
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), [key, "text", "type"], "full_outer")
    n = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return n.select("both", "only_a", "only_b", *prf(F.col("both"), F.col("only_a"), F.col("only_b")))


def speed_up(a: DataFrame, b: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows of two timing tables joined on `keys`, with b's time over a's."""
    x, y = a.select(*keys, F.col(time).alias("time_a")), b.select(*keys, F.col(time).alias("time_b"))
    return x.join(y, keys).withColumn("speed_up", ratio(F.col("time_b"), F.col("time_a")))


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str, key: str = "position") -> DataFrame:
    """Two tables side by side by rank of an order column; its values are ranked without a single task:
    both sides are ranked within ranges of the column and the ranges' sizes added up."""
    return _ranked(a, order_a, key).join(_ranked(b, order_b, key), key)


def _ranked(df: DataFrame, order: str, key: str) -> DataFrame:
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return parts.withColumn("__n", inner).join(F.broadcast(starts), "__part").withColumn(key, F.col("__start") + F.col("__n")).drop("__part", "__n", "__start")
