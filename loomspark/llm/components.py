"""Connected components of an edge table, with no driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root: the least node reachable.

    Alternates star contractions: every node's larger neighbours are linked to
    its least neighbour, then its smaller ones, until all edges lead to roots. Paths
    shrink by a factor each round, so that a few rounds do; it always ends. Each round is
    a written table. Loops and repeated edges are harmless; no edges, no rows.
    """
    def settled(df):
        """Whether every node but the roots has one edge, which leads to a root."""
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in_")).union(df.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in_").alias("in_")).filter("out > 1 or out + in_ > 1").isEmpty()

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")).withColumn("m", F.least("u", "m"))
        large = spread(both.filter("v > u"), least.drop("n_rows"), ["u"], least, by=["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        joined = spread(large, least.drop("n_rows"), ["u"], least, by=["v"])
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "edges")
    # every node but a root now has one edge, which leads to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
