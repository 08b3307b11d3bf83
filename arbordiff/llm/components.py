"""Connected components of a graph held in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import remove, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b), any order. Returns (node, root) for every node with a link; root: the smallest node that it reaches.
    Each step ends in a table of the shared folder. Only two sums come to the driver."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # Each side of a join is a table, so that Spark can split a node that a third of all edges lead to.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "large", instead_of=least)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges", instead_of=edges)
        for old in (large, low):
            remove(old)
        edges = small
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
