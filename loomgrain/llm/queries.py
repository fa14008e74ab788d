"""The thin queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgrain.llm import bpe, decontaminate, language_id, license_scan, line_templates, media_jpeg, secret_scan, simhash_dedup, token_blocks, warc
from loomgrain.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.round_trip(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.NOTICES + license_scan.full_texts())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_token_blocks": op1_token_blocks,
    "op2_media_jpeg": op2_media_jpeg,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_line_templates": op7_line_templates,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op10_bpe": op10_bpe,
}

SQL: dict[str, str] = {"op3_warc": warc.SQL, "op9_secret_scan": secret_scan.SQL}
