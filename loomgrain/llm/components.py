"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Every round is two joins on a vertex with its least neighbour; the edges live in the shared folder, and
the driver sees a count and a checksum a round. A hub's rows are split by the adaptive skew join, since
its minimum comes from an aggregate and not from a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.shared import drop_scratch, written_at


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``links`` (u, v: long) that has a link to another one.

    The component is its least vertex. Direction, repeats and loops of links don't matter; no links give no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, path = written_at(edges, "edges")
    before = None
    while True:
        told = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == told or told[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = told
        middle, middle_path = written_at(_large(edges), "edges")
        drop_scratch(edges.sparkSession, path)
        edges, path = written_at(_small(middle), "edges")
        drop_scratch(edges.sparkSession, middle_path)
