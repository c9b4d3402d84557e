"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a component of any size and shape is spread over the cluster; the edge
table of each round is a written table, and the number of rounds grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch


def _linked(edges: DataFrame, upper: bool) -> DataFrame:
    """Large-star (``upper``): each node links its greater neighbours to the least of its neighbourhood; small-star: its lesser ones and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if upper else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
    joined = both.join(least, F.col("u") == F.col("n"))
    if upper:
        found = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return found.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns u, v of one orderable type); the component is its least node.

    Null ends and loops link nothing (a node with nothing but a loop has no row). Repeated edges count once.
    """
    scratch = Scratch(edges.sparkSession)
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now = scratch.save(edges.select("u", "v").where("u <> v").distinct(), "0")
    before, i = now.agg(F.count("*"), mark).first(), 0
    while before[0]:
        i += 1
        now = scratch.save(_linked(_linked(now, True), False), str(i))
        scratch.drop(str(i - 1))
        after = now.agg(F.count("*"), mark).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
