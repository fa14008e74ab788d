"""Pages and checks as streams: contracts held against arriving pages, drift by the hour, first arrivals and changed prices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgrain.operators import contract
from loomgrain.sources.tables import kept


def held_against(pages: DataFrame, listing: DataFrame, columns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Checks of every arriving page as Parquet under ``out``, a folder a batch, so that a batch that is run again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        nested = kept(contract.replay(df, listing))
        contract.checks(nested, listing, columns).write.mode("overwrite").parquet(f"{out}/batch={number}")
        nested.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift(checks: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """begin, extractor, n_checks and n_failed by windows of event time; ``checks`` has ts, extractor and ok."""
    w = F.window("ts", window)
    return checks.withWatermark("ts", late).groupBy(w, "extractor").agg(F.count("*").alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed")).select(F.col("window.start").alias("begin"), "extractor", "n_checks", "n_failed")


def first_arrivals(pages: DataFrame, key: str = "url", late: str = "1 hour") -> DataFrame:
    """The first row of a key within the watermark; the state of older keys goes."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


_CHANGE = "url string, ts timestamp, before string, after string"


def changed_prices(answers: DataFrame, late: str = "1 hour", forget_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """url, ts, before and after whenever an address's price isn't the last one. ``answers`` has url, ts and price; state is one price an address.

    An address is forgotten when the watermark is ``forget_ms`` past its last price; a price that comes later than the watermark allows
    counts in the order in which it comes.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).dropna(subset=["price"]).sort_values(["ts", "price"], kind="stable")
        last, seen = state.get if state.exists else (None, 0)
        out = []
        for ts, price in zip(rows["ts"], rows["price"], strict=True):
            if last is not None and price != last:
                out.append((key[0], ts, last, price))
            last, seen = price, max(seen, int(ts.timestamp() * 1000))
        if last is not None:
            state.update((last, seen))
            state.setTimeoutTimestamp(max(seen + forget_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["url", "ts", "before", "after"])

    return answers.withWatermark("ts", late).groupBy("url").applyInPandasWithState(step, _CHANGE, "price string, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def emptied(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table under ``out``; with ``complete``, the last state."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
