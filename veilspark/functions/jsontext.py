"""JSON of unknown shape in string columns: every string leaf masked in place, or walked by path as rows.

`redacted` keeps all else as it is written: keys, their order, numbers, blanks, repeated keys. `strings` parses to VARIANT and
walks it level by level.

Defined results: null stays null. Text that is not JSON (as VARIANT's parser judges, which refuses repeated keys) is masked as
one plain text, so nothing passes unmasked. A leaf whose mask changes nothing keeps its escapes; the others are written anew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .pieces import pieces

#: A string of JSON, and the colon that makes it a key.
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"(\s*:)?', re.DOTALL)
PARTS = "struct<gaps:array<string>,raw:array<string>,leaves:array<string>>"


def _cut(t: str) -> tuple[list[str], list[str], list[str]]:
    gaps, raw, done = [], [], 0
    for m in STRING.finditer(t):
        if m[1] is None:
            gaps.append(t[done : m.start()])
            raw.append(m[0])
            done = m.end()
    return [*gaps, t[done:]], raw, [json.loads(r, strict=False) for r in raw]


def _parts(x: Column) -> Column:
    """What lies between the string leaves of each text, the leaves as written and as they read."""

    @F.arrow_udf(PARTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at, n in pieces(texts):
                gaps, raw, leaves = zip(*(_cut(t or "") for t in texts.slice(at, n).to_pylist()), strict=True)
                yield pa.StructArray.from_arrays([pa.array(v, pa.list_(pa.string())) for v in (gaps, raw, leaves)], ["gaps", "raw", "leaves"])

    return run(x)


def quoted(x: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.struct(x.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def redacted(x: Column, use: Callable[[Column], Column]) -> Column:
    """The JSON text with use(leaf) for each string leaf."""

    def rebuilt(p: Column) -> Column:
        pairs = F.arrays_zip(p["raw"], p["leaves"])
        done = F.transform(pairs, lambda z: tx.bind(F.struct(z.alias("z"), use(z["leaves"]).alias("m")), lambda y: F.when(y["m"] == y["z"]["leaves"], y["z"]["raw"]).otherwise(quoted(y["m"]))))
        return F.array_join(F.zip_with(p["gaps"], F.concat(done, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")

    valid = F.try_parse_json(x).isNotNull()
    return F.when(x.isNull(), None).when(valid, tx.bind(_parts(F.when(valid, x)), rebuilt)).otherwise(use(x))


def strings(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) for each string leaf of the JSON texts in `column`; texts that are not JSON have none.

    One VARIANT level is opened at a time, until no object or array is left.
    """
    level = df.select(F.col(key), F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    out = None
    while True:
        typed = level.withColumn("kind", F.schema_of_variant("v"))
        leaves = typed.where("kind = 'STRING'").select(key, "path", F.variant_get("v", "$", "string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = typed.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if inner.isEmpty():
            return out
        spark = df.sparkSession
        opened = inner.select(key, "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key_").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key_")))
        names = [key, "path", "v", "pos", "key_", "value"]
        level = opened.toDF(*names).select(key, F.concat("path", step).alias("path"), F.col("value").alias("v"))
