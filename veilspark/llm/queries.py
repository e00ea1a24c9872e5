"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, fill_in_middle, lang_crf, lattice_lm, line_dedup, quality_classifier, quality_rules, simhash, spelling_variants, toxicity, warc
from .common import fold, read
from .oracles import oracle_sql  # noqa: F401

#: Tokens above which a document counts as long.
TOKEN_LIMIT = 2048


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return lattice_lm.score(docs, ~F.col("held_out"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    out = bpe.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    weights = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), weights)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_records(warc.write_records(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = lang_crf.fit(docs.where("not held_out"))
    return lang_crf.predict(docs.select("doc_id", "held_out", "text"), model)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "contaminated", F.size("hits").cast("long").alias("n_items"), F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), ",", "null").alias("item_ids"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = common.materialize(quality_rules.statistics(read(spark, sf_dir, "documents").select("doc_id", "text")), "rules-counted")
    forest = quality_rules.learn(counted, read(spark, sf_dir, "labels"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
    return quality_rules.judged(counted, forest).select(*columns)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(read(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = cut.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), "output")
    back = fill_in_middle.restore(cut)
    return back.withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0), weights)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_lm_scoring, op2_token_counts, op3_line_dedup, op4_simhash, op5_bpe_round_trip, op6_quality_classifier, op7_warc, op8_language_id, op9_decontamination, op10_quality_rules, op11_spelling_variants, op12_fill_in_middle, op13_toxicity)
    return {f.__name__: f for f in listed}
