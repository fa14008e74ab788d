"""The Parquet tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes on disk up to which a table that was measured is broadcast.
SMALL = 4 << 20
#: Tasks a core of what is spread.
_TASKS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` from the folder ``sf_dir``, which may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` on the executors' disks, for rows that cost a parse and that one plan reads more than once.

    The lineage stays, so what a lost executor held is made again. Whoever keeps a frame for long calls unpersist().
    """
    return df.persist(StorageLevel.DISK_ONLY)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, several tasks to each, before a page is written from or parsed in each: a file of one row group would else be one task, and so would a small join."""
    return df.repartition(_TASKS * df.sparkSession.sparkContext.defaultParallelism)


def measured(df: DataFrame) -> DataFrame:
    """A contract, or another table that is small by nature, written to the shared folder: if it is small as written it is broadcast, else joins with it sort and merge.

    Without it a plan goes by estimates, and those of what is parsed or exploded are far too low: the pages' side of a join would be broadcast. Joins
    and aggregates that made the table aren't part of the plans that read it.
    """
    if getattr(df, "_loomgrain_measured", False):
        return df
    path = shared_path(df.sparkSession, "held")
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    size = int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    found = F.broadcast(held) if size <= SMALL else held.hint("merge")
    found._loomgrain_measured = True
    return found


def shared(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a purely local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='loomgrain-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared(spark)}/loomgrain-{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
