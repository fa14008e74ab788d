"""What several operators use: tables in the shared folder, words of an Arrow column, hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomgrain.sources.tables import shared_path as scratch_path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that a lost executor costs no recomputation and lineage ends."""
    return written_at(df, tag)[0]


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As written(), with the path, for tables that go before the session ends."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes``; a longer value is a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(column)
        sizes = np.asarray(pc.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        run = np.cumsum(sizes)
        begin = 0
        while begin < len(sizes):
            base = run[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(run, base + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


_served: tuple[str, Callable[[], None] | None] = ("", None)


def turn(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Said where a task begins. A worker outlives the stage that started it: what another operator remembered in it is forgotten, and freed memory goes back."""
    global _served
    before, drop = _served
    _served = operator, forget
    if before in ("", operator):
        return
    if drop is not None:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def texts(column: pa.Array) -> list[str]:
    """The values of a text column, null as the empty text."""
    return column.fill_null("").to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
