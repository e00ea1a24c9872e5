"""Counts, rates and risk reports over entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------------------

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY = {"EMAIL": "MEDIUM", "PHONE_NUMBER": "HIGH", "SSN": "CRITICAL", "CREDIT_CARD": "CRITICAL", "BANK_ACCOUNT": "CRITICAL"}
ADVICE = {
    "CRITICAL": ("CRITICAL: Document contains sensitive financial or identity information.", "Immediate action required to remove or redact sensitive information."),
    "HIGH": ("HIGH: Document contains personal contact information.", "Consider redacting or anonymizing personal information."),
    "MEDIUM": ("MEDIUM: Document contains some personal information.", "Review and consider if information needs to be shared."),
    "LOW": ("No PII detected in the document.",),
}


def counts(entities: DataFrame, *by: str) -> DataFrame:
    return entities.groupBy(*by).agg(F.count("*").alias("n"))


def metrics_cube(entities: DataFrame) -> DataFrame:
    """Counts by (lang, type), type and method in one pass: grouping sets."""
    view = f"entities_{id(entities)}"
    entities.createOrReplaceTempView(view)
    try:
        return entities.sparkSession.sql(f"select lang, type, method, count(*) as n from {view} group by grouping sets ((lang, type), (type), (method))")
    finally:
        entities.sparkSession.catalog.dropTempView(view)


def by_method(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """For each method: finds, those of `least` or more, and the types."""
    return entities.groupBy("method").agg(F.count("*").alias("total"), F.count_if(F.col("score") >= least).alias("filtered"), F.sort_array(F.collect_set("type")).alias("types"))


def density(n: Column, length: Column) -> Column:
    return F.when(length > 0, n / length).otherwise(0.0)


def per_language(docs: DataFrame, measures: list[str], lang: str = "lang") -> DataFrame:
    """mean, sum, sample deviation, least and most of each measure by language."""
    aggs = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("sum", F.sum), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return docs.groupBy(lang).agg(F.count("*").alias("n"), *aggs)


def batch_summary(results: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: texts, entities, errors, time and mean time; zeros where there are no texts."""
    n = F.count("*")
    return results.agg(
        n.alias("total_processed"),
        F.coalesce(F.sum(F.size("entities")), F.lit(0)).cast("long").alias("total_pii_found"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_processing_time"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_time_per_text"),
    )


def errors(results: DataFrame, key: str = "doc_id", error: str = "error") -> DataFrame:
    """The failed texts with what went wrong. Texts without an error have no row."""
    return results.where(F.col(error).isNotNull()).select(key, error)


def call_statistics(calls: DataFrame) -> DataFrame:
    """One row for each service and one, with a null service, for all: calls, successes, failures, tokens, retries, cache hits and seconds.

    calls: a row for each call: service, success, tokens, retries, cached, seconds; nulls count as nothing.
    """
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero)).alias(c)
    return calls.rollup("service").agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("successful_calls"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failed_calls"),
        total("tokens", 0),
        total("retries", 0),
        F.count_if("cached").alias("cache_hits"),
        total("seconds", 0.0),
    )


def severity(kind: Column) -> Column:
    """0 to 3; unknown types are MEDIUM."""
    out = F.lit(1)
    for name, level in SEVERITY.items():
        out = F.when(kind == name, LEVELS.index(level)).otherwise(out)
    return out


def risk(docs: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every document its worst severity, number of entities, and advice."""
    per_type = entities.groupBy(key, "type").agg(F.count("*").alias("n"))
    found = per_type.groupBy(key).agg(F.max(severity(F.col("type"))).alias("worst"), F.sum("n").alias("n_entities"), F.sort_array(F.collect_list(F.struct("type", "n"))).alias("kinds"))
    out = docs.select(key).join(found, key, "left")
    level = F.element_at(F.array(*(F.lit(x) for x in LEVELS)), F.coalesce("worst", F.lit(0)) + 1)
    general = F.element_at(F.create_map(*(v for k, texts in ADVICE.items() for v in (F.lit(k), F.array(*(F.lit(t) for t in texts))))), F.col("risk_level"))
    special = F.coalesce(F.transform("kinds", lambda k: F.concat(F.lit("Found "), k["n"].cast("string"), F.lit(" "), k["type"], F.lit("(s)."))), F.array().cast("array<string>"))
    out = out.withColumn("risk_level", level)
    return out.select(key, "risk_level", F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"), F.concat(general, special).alias("recommendations"))


def service_risk(counts_by_type: Column, total: Column) -> Column:
    """HIGH for cards, SSNs, accounts or over 5 finds; MEDIUM for emails, phones or over 2; else LOW."""
    has = lambda *kinds: F.arrays_overlap(F.map_keys(counts_by_type), F.array(*(F.lit(k) for k in kinds)))
    return F.when(has("CREDIT_CARD", "SSN", "BANK_ACCOUNT") | (total > 5), "HIGH").when(has("EMAIL", "EMAIL_ADDRESS", "PHONE_NUMBER") | (total > 2), "MEDIUM").otherwise("LOW")


def word_count(text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long")


def first_n(df: DataFrame, n: int, by: str, *order: str) -> DataFrame:
    """The first n rows of each group in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def best_per_text(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of equal (type, text) in a document the best-scored, first entity, with how many there were."""
    w = Window.partitionBy(key, "type", "text")
    ranked = entities.withColumn("times", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc("score"), "start", "end", "method")))
    return ranked.where("__n = 1").drop("__n")


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of the key: the same at each run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def not_under(path: Column, prefixes: tuple[str, ...] = ("/static/", "/admin/", "/media/")) -> Column:
    """Whether a request's path begins with none of the prefixes; null paths do not."""
    out = F.lit(True)
    for p in prefixes:
        out = out & ~F.coalesce(path.startswith(p), F.lit(False))
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """For each column: its type, nulls and distinct values (about)."""
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"nulls_{k}") for k, c in enumerate(df.columns)), *(F.approx_count_distinct(c).alias(f"distinct_{k}") for k, c in enumerate(df.columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"nulls_{k}").alias("nulls"), F.col(f"distinct_{k}").alias("distinct_about")) for k, (c, t) in enumerate(df.dtypes)))).alias("x")
    return one.select(rows).select("x.*")


def prior_turns(turns: DataFrame, last: int = 20) -> DataFrame:
    """Each turn with the text of the `last` ones before it, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(w), "\n"))


def latest(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row of each group with the greatest `order`."""
    columns = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*columns), order).alias("x")).select(by, "x.*")
