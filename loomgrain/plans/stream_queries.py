"""Queries run as streams over files that are there, until these are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.plans.registry import register
from loomgrain.sources.tables import shared_path, table
from loomgrain.streaming import watch


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stream's source is a folder; the table is one file or a folder of them
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_drift_window", "select date_trunc('hour', ts) as begin, 'u' || (user_id % 3) as extractor, count(*) as n_checks, count(*) filter (event_type = 'error') as n_failed from events group by all")
def stream_drift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _events(spark, sf_dir).select("ts", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("extractor"), (F.col("event_type") != "error").alias("ok"))
    folder = shared_path(spark, "stream")
    found = watch.emptied(watch.drift(checks), f"{folder}/out", f"{folder}/state", "complete")
    return found.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@register("stream_first_arrivals", "select distinct user_id from events")
def stream_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "stream")
    return watch.emptied(watch.first_arrivals(_events(spark, sf_dir), "user_id", "365 days"), f"{folder}/out", f"{folder}/state").select("user_id")


@register(
    "stream_changed_prices",
    """with e as (select 'u' || (user_id % 50) as url, ts, cast(cast(floor(value) as int) % 3 as varchar) as price from events), l as (select *, lag(price) over (partition by url order by ts, price) as before from e)
 select url, ts, before, price as after from l where before <> price""",
)
def stream_changed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _events(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("url"), "ts", (F.floor("value").cast("int") % 3).cast("string").alias("price"))
    folder = shared_path(spark, "stream")
    return watch.emptied(watch.changed_prices(answers), f"{folder}/out", f"{folder}/state").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
