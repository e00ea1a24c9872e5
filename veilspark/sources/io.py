"""Sources and sinks: files in, tables and reports out."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUGMENTED = "text_id bigint, original_text string, augmented_text string, augmentation_method string, language string, timestamp string, processing_time double"
REQUEST = "text string, language string, config map<string,string>"
ENTITY_LIST = "array<struct<type:string,text:string,start:int,end:int,confidence:double>>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, required: tuple[str, ...] = (), header: bool = True) -> DataFrame:
    """CSV files as UTF-8, or as Latin-1 where a file is not valid UTF-8. Missing `required` columns are an error.

    The encoding is decided file by file from the bytes, read in parallel.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [c for c in required if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"the schema lacks {', '.join(missing)}")
    files = spark.read.format("binaryFile").load(path).select("path", F.expr("is_valid_utf8(cast(content as string))").alias("utf8"))
    by_encoding: dict[bool, list[str]] = {}
    for r in files.collect():  # a row for each file: path and flag
        by_encoding.setdefault(r.utf8, []).append(r.path)
    parts = []
    for utf8, paths in sorted(by_encoding.items(), reverse=True):
        reader = spark.read.schema(schema).option("header", header).option("encoding", "UTF-8" if utf8 else "ISO-8859-1").option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
        parts.append(reader.csv(paths))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, *, lines: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def entity_list(column: Column, schema: str = ENTITY_LIST) -> Column:
    """A JSON string as a list of entities; bad JSON is an empty list."""
    return F.coalesce(F.from_json(column, schema), F.array().cast(schema))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], *, suffix: str = ".pdf") -> DataFrame:
    """(path, page, text) of binary documents through a parser that the caller supplies; other suffixes are an error.

    parse(content) gives the pages of one document; it runs on executors.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, k, t) for p, c in zip(frame["path"], frame["content"], strict=True) for k, t in enumerate(parse(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").load(path)
    bad = F.raise_error(F.concat(F.lit(f"not a {suffix} file: "), "path"))
    checked = files.select(F.when(F.lower("path").endswith(suffix), F.col("path")).otherwise(bad).alias("path"), "content")
    return checked.mapInPandas(run, "path string, page int, text string")


def requests(spark: SparkSession, bodies: list[dict]) -> DataFrame:
    """Request bodies (text or texts, language, config) as rows; languages default to en."""
    rows = [(t, b.get("language") or "en", {k: str(v) for k, v in (b.get("config") or {}).items()}) for b in bodies for t in (b["texts"] if "texts" in b else [b.get("text")])]
    return spark.createDataFrame(rows, REQUEST)


def settings(spark: SparkSession, prefix: str = "veilspark.", environment: str = "VEILSPARK_") -> dict[str, str]:
    """Settings from the environment, overridden by the session's."""
    out = {k[len(environment) :].lower(): v for k, v in os.environ.items() if k.startswith(environment)}
    return out | {r.key[len("spark." + prefix) :]: r.value for r in spark.sql("set").collect() if r.key.startswith("spark." + prefix)}


def write_results(df: DataFrame, path: str, mode: str = "error") -> None:
    """Nested results as JSON lines."""
    df.write.mode(mode).json(path)


def write_entities(entities: DataFrame, path: str, mode: str = "error") -> None:
    """Entities as CSV with a header; texts without one have no row."""
    entities.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_redacted(results: DataFrame, path: str, key: str = "doc_id", mode: str = "error") -> None:
    """Masked texts and reports, side by side: <path>/text and <path>/report, by key."""
    results.select(key, F.col("masked_text").alias("text")).write.mode(mode).json(f"{path}/text")
    results.select(key, "entities", "statistics").write.mode(mode).json(f"{path}/report")


def audit_rows(results: DataFrame, *, user: Column, at: Column, text: str = "text") -> DataFrame:
    """A row for each text with entities and a user: user_id, ts, text_sha256, n_entities, entity_types."""
    rows = results.withColumn("user_id", user).where((F.size("entities") > 0) & F.col("user_id").isNotNull())
    kinds = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["type"])))
    return rows.select("user_id", at.alias("ts"), F.sha2(F.col(text), 256).alias("text_sha256"), F.size("entities").alias("n_entities"), kinds.alias("entity_types"))


def write_metrics(metrics: DataFrame, folder: str, name: str = "metrics", at: datetime | None = None) -> str:
    """A CSV report with a header, named by its time (UTC, to the second) so that none replaces an earlier one; gives its path."""
    path = f"{folder.rstrip('/')}/{name}_{(at or datetime.now(UTC)).strftime('%Y%m%d_%H%M%S')}.csv"
    metrics.write.mode("error").option("header", True).option("escape", '"').csv(path)
    return path


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def save_index(vectors: DataFrame, path: str, mode: str = "error") -> None:
    """(id, text, embedding) as Parquet: the index is the table."""
    vectors.write.mode(mode).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def html_report(metrics: DataFrame, results: DataFrame, rows: int = 10) -> str:
    """A small page with a metrics table and the first results."""
    import html

    def table(df: DataFrame, n: int) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(n).collect())
        return f"<table><tr>{head}</tr>{body}</table>"

    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body><h1>Metrics</h1>{table(metrics, 200)}<h1>First results</h1>{table(results, rows)}</body></html>"
