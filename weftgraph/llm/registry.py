"""Queries of the corpus operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, byte_cnn, html_crf, license_dice, line_frequency, order_minhash, periodic_runs, pii_bootstrap, substring_dedup, token_groups, token_scan, whitening, winnowing
from weftgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
#: Path of the vocabulary and the pattern of its pre-tokens; never copied into the repository.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.assess(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_bootstrap.report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY, PATTERN)


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_counts(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY, PATTERN)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Query]:
    found = (op1_line_frequency, op2_substring_dedup, op3_pii_bootstrap, op4_order_minhash, op5_byte_bpe, op6_html_crf, op7_byte_cnn, op8_token_scan, op9_winnowing, op10_license_dice, op11_whitening, op12_periodic_runs, op13_token_groups)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": line_frequency.SQL, "op2_substring_dedup": substring_dedup.SQL, "op9_winnowing": winnowing.SQL, "op10_license_dice": license_dice.sql(), "op13_token_groups": token_groups.SQL}
