"""Connected components by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeset.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """Component of each node in edges (a, b): columns node, root, where root is the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest one, then the smaller ones, and stores
    the edges in the shared folder. Rounds grow with the logarithm of the nodes; edges never become more. A node with very
    many neighbours is an aggregation key or one side of an equi-join only, so its rows can be split among tasks.
    """
    ends = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, before = materialise(ends(edges), "edges"), None
    while True:
        # large star: every node sends its larger neighbours to the smallest node it knows
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ends(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: every node sends its smaller neighbours, and itself, to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = ends(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
        current = materialise(small, "edges")
        now = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
