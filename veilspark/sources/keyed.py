"""Tables that are updated by key, and results that last between runs.

`upsert` keeps a table as Parquet in buckets by a hash of its key. Changes rewrite only the buckets that they touch, under
dynamic partition overwrite: the new files are staged and replace the old ones when the job commits, so a failed write leaves
the table as it was. A version column guards against lost updates: a change counts only if its version is the stored row's
next one, and a stale one raises before anything is written.

Defined results of `upsert`: a key that changes hold more than once takes its greatest version; null in a key's column, or a
null version, is refused; a new key may start at any version; the first write makes the table.

`analyzed_once` keeps results by (hash of text, language, hash of rule pack): texts that have one are not scanned again, and a
changed pack makes all old rows stale. Null texts are not stored and keep their result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Profile, profile
from ..plans import pipeline

BUCKETS = 64
BUCKET = "bucket"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert(changes: DataFrame, path: str, keys: list[str], *, version: str = "version", buckets: int = BUCKETS) -> None:
    """Writes `changes` into the table under `path`: rows of known keys replace them, the others are added.

    The number of buckets is the table's for good: give the same one each time.
    """
    spark = changes.sparkSession
    bad = changes.where(" or ".join(f"`{c}` is null" for c in (*keys, version)))
    if not bad.isEmpty():
        raise ValueError(f"null in {', '.join(keys)} or {version}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    columns = [c for c in changes.columns if c not in keys]
    new = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(version)).alias("row")).select(*keys, "row.*").withColumn(BUCKET, bucket).select(*changes.columns, BUCKET)
    if _exists(spark, path):
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
        old = spark.read.schema(new.schema).parquet(path).where(F.col(BUCKET).isin(touched))
        both = old.alias("o").join(new.select(*keys, F.col(version).alias("__next")).alias("n"), keys)
        stale = both.where(F.col("__next") != F.col(f"o.{version}") + 1).select(*keys).limit(3).collect()
        if stale:
            raise ValueError(f"stale versions of {[tuple(r) for r in stale]}")
        new = old.join(new, keys, "left_anti").select(*new.columns).unionByName(new)
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def pack_hash(rules: Profile) -> str:
    """What tells a pack from any other: its rules, policy, mask, context words and thresholds."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def analyzed_once(df: DataFrame, path: str, name: str | Profile = "light", *, text: str = "text", lang: str = "lang") -> DataFrame:
    """As `pipeline.analyze`, from results kept under `path`; texts without one are analysed, once each, and their results added."""
    spark, rules = df.sparkSession, name if isinstance(name, Profile) else profile(name)
    pack = pack_hash(rules)
    keys = ["text_sha256", "text_lang"]
    hashed = df.withColumn("text_sha256", F.sha2(F.col(text), 256)).withColumn("text_lang", F.coalesce(F.col(lang), F.lit("")))
    wanted = hashed.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("text"), F.col(lang).alias("lang")).dropDuplicates(keys)
    kept = spark.read.schema("text_sha256 string, text_lang string, pack string").parquet(path).where(F.col("pack") == pack) if _exists(spark, path) else None
    fresh = wanted if kept is None else wanted.join(kept.select(*keys), keys, "left_anti")
    found = pipeline.analyze(fresh, rules).drop("text", "lang", "success").withColumn("pack", F.lit(pack))
    found.write.mode("append").partitionBy("pack").parquet(path)
    # with a schema, as a folder without results has none
    results = spark.read.schema(found.schema).parquet(path).where(F.col("pack") == pack).drop("pack").dropDuplicates(keys)
    none = pipeline.analyze(hashed.where(F.col(text).isNull()), rules, text=text, lang=lang).drop("success")
    return hashed.join(results, keys).unionByName(none).drop(*keys)
