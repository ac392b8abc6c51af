"""The operators of this folder as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.llm import decontaminate, language_model, lexical_search, licenses, main_text, packing, piece_counts, quality, records, repetition, simhash, source_audit, sql, substrings
from tensio.llm.batches import stage_path
from tensio.sources.tables import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


MAX_TOKENS = 4096


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = piece_counts.with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


END_ID = 2


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    index = records.write_records(docs, stage_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return records.with_start(records.read_records(index)).withColumnRenamed("key", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.with_main_text(pages, main_text.train(pages))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.with_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.drop_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.with_verdict(repetition.with_repetition(docs))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.with_digest(licenses.with_licenses(docs, keep=["doc_id"]))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_token_records": op3_token_records,
    "op4_html_extraction": op4_html_extraction,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_audit": op13_source_audit,
}

#: SQL of the same rows, where DuckDB can state them; the others are tested by brute force.
ORACLE: dict[str, str] = {
    "op8_substring_dedup": sql.substring_dedup(),
    "op10_quality_rules": sql.quality_rules(),
    "op11_license_scan": sql.license_scan(),
    "op12_lexical_search": sql.lexical_search(),
    "op13_source_audit": sql.source_audit(),
}
