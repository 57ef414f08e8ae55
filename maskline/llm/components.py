"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is its least node.

    Each round alternates two star steps, which at least halve the depth of
    every tree: all larger neighbours of a node are linked to the least
    neighbour, then all smaller ones.  The minima are partially aggregated; the
    rows of a node meet its minimum in a join, whose hot keys adaptive
    execution splits.  Links are numbers only, and there are at most as many as
    nodes after the first round.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: for v > u, link v to the least of u and its neighbours.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: for v <= u, link v, and u itself, to the least smaller neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
