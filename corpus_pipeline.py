"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage but the last gives the columns of ``documents``. Rows that it drops are gone for the stages behind it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import bpe, decontaminate, language_id, line_templates, simhash_dedup
from loomgrain.llm.shared import written
from loomgrain.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which one learned language has at least half. The model learns from all labelled rows, held-out ones too."""
    model = language_id.train(docs)
    return language_id.accepted(docs.select(COLUMNS), model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows. One of which nothing stays is dropped."""
    kept = line_templates.dedup(docs.select(COLUMNS))
    kept = kept.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash_dedup.keep_first(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with n_tokens and the digests of its ids and of their decoding."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", languages),
    ("lines", lines),
    ("simhash", near_copies),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]

#: Language models and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, of all of ``documents``.

    A null or empty text has no letters, so the first stage drops its row; rows that repeat a document are one from the near-copy stage on, but rows
    without a doc_id stay apart. Other columns of the table don't pass through. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
