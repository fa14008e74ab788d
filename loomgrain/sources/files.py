"""Sinks and sources of files: CSV that no spreadsheet runs, JSON lines that a crawl goes on from, written contracts and settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrain.functions import scalars


def write_csv(df: DataFrame, path: str) -> None:
    """The rows as CSV with a header; texts are formula_safe(), what is nested is JSON."""
    columns = []
    for f in df.schema.fields:
        held = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            held = F.to_json(held)
        columns.append((scalars.formula_safe(held) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.StringType)) else held).alias(f.name))
    df.select(*columns).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds the rows as lines of JSON, nulls too; Spark commits whole files, so a job that ends early leaves no broken line."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of append_jsonl(); a line that is no JSON of the schema, as another writer's unfinished last one, is left out."""
    told = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    whole = F.col("r").isNotNull() & F.try_parse_json("value").isNotNull()
    return told.where(whole).select("r.*")


def left_to_do(frontier: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """What a crawl still has to read: the frontier without what its JSON lines hold."""
    return frontier.join(done.select(key).distinct(), key, "left_anti")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """extractor and contract (JSON) of files of JSON lines that hold both."""
    return read_jsonl(spark, path, "extractor string, contract string").where("extractor is not null and contract is not null")


def settings(text: str, known: dict[str, type]) -> dict[str, object]:
    """Settings of a JSON object. An unknown name, or a value of another type, is an error that names it."""
    told = json.loads(text)
    if not isinstance(told, dict):
        raise ValueError("settings are an object")
    for name, value in told.items():
        if name not in known:
            raise ValueError(f"no setting is called {name}")
        if type(value) is not known[name]:
            raise ValueError(f"{name} is to be of type {known[name].__name__}")
    return told
