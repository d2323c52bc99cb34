"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns (node, component), component = smallest node reachable.

    Nodes without an edge to another node, and rows with a null, don't appear. Minima are taken by
    groupBy with partial aggregation; the joins that bring them back read two tables, so adaptive
    execution can split a hub with very many edges. Every round is written to the shared folder.
    Rounds grow with the logarithm of the longest chain.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = staged(e.distinct(), "edges")
    while True:
        both = e.union(e.select("b", "a"))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = staged(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        rest = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(rest.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # A forest of stars has no node on both sides, and then every leaf has one edge.
        if e.select(F.col("b").alias("a")).distinct().join(e, "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
