"""Thresholds that learn from feedback on a stream, and a scan of a stream that goes by them.

`learn` keeps a state for each (method, type) of finds: a find that was wrong raises the threshold while over a tenth of that
key's finds so far are wrong. After each micro-batch the changed thresholds go to a table, in a folder for each batch that a
retry replaces. `detect` scans a stream of texts and drops finds below the thresholds that the table holds when a batch
starts. It writes these down before the scan, so that a batch that is tried again after a failure uses the same ones, whatever
has been learnt since, and replaces its own results.

Defined results: a null `false_positive` is a right find; null methods and types are keys like any other; feedback of a
micro-batch counts in order of ts, nulls first; without a table, or for a key without feedback, `start` holds. One feedback
stream writes a table, and one text stream a folder of results. The state lies in RocksDB, whose provider is set while a query
starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import Profile, profile
from ..plans import pipeline

LEARNED = "method string, type string, threshold double, false_positives long, total long"
STATE = "rises long, wrong long, total long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Share of wrong finds above which a wrong one raises the threshold; fixed value.
TOLERATED = 0.1
START = 0.5


class Learner(StatefulProcessor):
    """State of one (method, type): how often its threshold rose, its wrong finds and all of them.

    With `rest` (seconds), a key that gets no feedback for that long is forgotten by a timer, which says that its threshold is
    back at the start; its state's time to live is twice as long, for keys whose timer is lost.
    """

    def __init__(self, start: float, rate: float, cap: float, rest: float | None):
        self.start, self.rate, self.cap, self.rest = start, rate, cap, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("learnt", STATE, int(2_000 * self.rest) if self.rest else None)

    def row(self, key: tuple, rises: int, wrong: int, total: int) -> pd.DataFrame:
        threshold = min(self.start + self.rate * rises, self.cap)
        return pd.DataFrame({"method": [key[0]], "type": [key[1]], "threshold": [threshold], "false_positives": [wrong], "total": [total]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rises, wrong, total = self.state.get() if self.state.exists() else (0, 0, 0)
        feedback = pd.concat([f[["ts", "false_positive"]] for f in rows]).sort_values("ts", kind="stable", na_position="first")
        bad = feedback["false_positive"].eq(True).to_numpy(dtype=bool, na_value=False)
        share = (wrong + np.cumsum(bad)) / (total + np.arange(1, len(bad) + 1))
        rises, wrong, total = rises + int((bad & (share > TOLERATED)).sum()), wrong + int(bad.sum()), total + len(bad)
        self.state.update((rises, wrong, total))
        if self.rest:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1_000 * self.rest))
        yield self.row(key, rises, wrong, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self.row(key, 0, 0, 0)

    def close(self) -> None:
        pass


def thresholds(feedback: DataFrame, *, start: float = START, rate: float = 0.1, cap: float = 0.95, rest: float | None = None) -> DataFrame:
    """(method, type, threshold, false_positives, total) of the keys that a micro-batch of feedback changes.

    feedback: a stream of (method, type, ts, false_positive). The threshold rises by `rate`, to `cap` at most. A task holds a
    time and a flag for each row that one key has in a micro-batch: bound it by the stream's source.
    """
    rows = feedback.select("method", "type", "ts", "false_positive")
    return rows.groupBy("method", "type").transformWithStateInPandas(Learner(start, rate, cap, rest), LEARNED, "update", "processingTime" if rest else "none")


def _run(writer, spark: SparkSession, timers: bool = False) -> None:
    """Runs what is there now to its end, with the provider that the state needs; with timers, which never end, as one batch."""
    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        query = (writer.trigger(once=True) if timers else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    query.awaitTermination()


def learn(feedback: DataFrame, table: str, checkpoint: str, **options) -> None:
    """Takes the feedback that is there now into the table of thresholds; a later call goes on from the checkpoint.

    With `rest` a call is one batch, in which timers that have run out act as well.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    out = thresholds(feedback, **options)
    _run(out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write), feedback.sparkSession, timers=bool(options.get("rest")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each (method, type) of the table; none where nothing has been learnt."""
    if not _exists(spark, table):
        return spark.createDataFrame([], LEARNED)
    rows = spark.read.schema(f"{LEARNED}, batch long").parquet(table)
    latest = rows.groupBy("method", "type").agg(F.max_by(F.struct("threshold", "false_positives", "total"), "batch").alias("r"))
    return latest.select("method", "type", "r.*")


def detect(texts: DataFrame, table: str, folder: str, checkpoint: str, name: str | Profile = "light", *, start: float = START, **options) -> None:
    """Scans the texts that are there now; their rows with `entities` go to <folder>/results, a folder for each batch.

    A find stays if its score reaches the threshold of its method and type. Of the table only the keys of the profile's rules
    come to the driver, a number for each rule at most.
    """
    rules = name if isinstance(name, Profile) else profile(name)
    spark = texts.sparkSession
    keys = {(r.method, r.type) for r in rules.rules}

    def write(rows: DataFrame, batch: int) -> None:
        used = f"{folder}/thresholds/batch={batch}"
        if not _exists(spark, f"{used}/_SUCCESS"):
            mine = F.col("method").isin(sorted({m for m, _ in keys})) & F.col("type").isin(sorted({t for _, t in keys}))
            current(spark, table).where(mine).coalesce(1).write.mode("overwrite").parquet(used)
        learnt = {(r.method, r.type): r.threshold for r in spark.read.schema(LEARNED).parquet(used).collect()}
        found = pipeline.detect(rows, rules, learnt={k: learnt.get(k, start) for k in sorted(keys)}, **options)
        found.write.mode("overwrite").parquet(f"{folder}/results/batch={batch}")

    _run(texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), spark)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """What `detect` has written so far."""
    return spark.read.parquet(f"{folder}/results").drop("batch")
