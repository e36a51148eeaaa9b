"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.llm import (
    decontaminate,
    language,
    lines,
    merkle,
    negatives,
    neighbours,
    oracles,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
    spans,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_decontamination(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return decontaminate.contaminated(_documents(spark, sf), benchmark).select(
        "doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity")
    )


def op2_quality_rules(spark, sf):
    return quality.quality(_documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed", ",").alias("failed"),
    )


def op3_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(_documents(spark, sf))


def op4_secret_scan(spark, sf):
    return secrets.secrets(_documents(spark, sf)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )


def op5_language_id(spark, sf):
    docs = _documents(spark, sf)
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~out))
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_sharding(spark, sf):
    return sharding.shard(_documents(spark, sf))


def op7_line_dedup(spark, sf):
    cut = lines.drop_boilerplate(_documents(spark, sf), copies_once=True)
    return cut.select("doc_id", "text", lines.ADDED)


def op8_warc(spark, sf):
    return warc.round_trip(spark.read.parquet(f"{sf}/pages.parquet"))


def op9_substring_dedup(spark, sf):
    return spans.drop_repeated_spans(_documents(spark, sf))


def op10_best_fit_packing(spark, sf):
    return packing.pack(_documents(spark, sf))


def op11_merkle_manifest(spark, sf):
    return merkle.manifest(_documents(spark, sf), tampered=merkle.line_breaks_deleted)


def op12_nearest_neighbours(spark, sf):
    return neighbours.nearest_neighbours(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_hard_negatives(spark, sf):
    label = negatives.seventh_moved(F.col("vec_id"), F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"), label=label)


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_language_id": op5_language_id,
        "op6_sharding": op6_sharding,
        "op7_line_dedup": op7_line_dedup,
        "op8_warc": op8_warc,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
