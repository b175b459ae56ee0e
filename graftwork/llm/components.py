"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.common import stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``u, v`` edges: the smallest node reachable.

    Alternates two star contractions (each node hangs its larger, then its
    smaller neighbours under the least one) until nothing changes; the number
    of rounds grows with the logarithm of the longest path. Minima are folded
    before they are shuffled and joined back as stored tables, so a node with
    very many neighbours is split over tasks.
    """
    now = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges"
    )
    before = None
    while (state := _checksum(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u > v").distinct(), "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        under = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(
            under.filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
