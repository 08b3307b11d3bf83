"""Sharing as joins and aggregations over node tables: for few huge trees, and for subtrees shared by a whole collection.

nodes: tree columns (the key), node_id, last_id, kind, height, digest. A node's descendants have numbers in (node_id, last_id].
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arity(nodes: DataFrame, keys: list[str], min_height: int = 1) -> DataFrame:
    """(keys, digest, arity): how often each subtree higher than min_height occurs. Summed before it is shuffled."""
    return nodes.where((F.col("kind") == "roll") & (F.col("height") > min_height)).groupBy(*keys, "digest").agg(F.count("*").alias("arity"))


def sharing_map(nodes: DataFrame, min_height: int = 1) -> DataFrame:
    """nodes: pair_id, side ('src' or 'dst'). (pair_id, digest, arity, mv) of what both sides have; mv from 0 in order of digest."""
    counted = arity(nodes, ["pair_id", "side"], min_height)
    both = counted.groupBy("pair_id", "digest").agg(F.sum("arity").alias("arity"), F.count("*").alias("sides")).where("sides = 2").drop("sides")
    return both.withColumn("mv", F.row_number().over(Window.partitionBy("pair_id").orderBy("digest")) - 1)


def extract_holes(nodes: DataFrame, shares: DataFrame, mode: str = "nonest") -> DataFrame:
    """(pair_id, side, node_id, height, mv) of the holes of a mode. nodes: one row for each node of each side of a pair."""
    return holes(shared_nodes(nodes, shares), mode)


def shared_nodes(nodes: DataFrame, shares: DataFrame) -> DataFrame:
    """The candidates of holes(). Both sides grow with the trees, and the size that Spark expects of a node table is that of the texts, so
    that neither may be broadcast."""
    wanted = nodes.where("kind = 'roll'").select("pair_id", "side", "digest", "node_id", "last_id", "height")
    return wanted.join(shares.select("pair_id", "digest", "arity", "mv").hint("merge"), ["pair_id", "digest"])


def holes(candidates: DataFrame, mode: str = "nonest") -> DataFrame:
    """(pair_id, side, node_id, height, mv) of the holes of a mode. candidates: pair_id, side, node_id, last_id, height, arity, mv of the
    nodes that both sides have. Whether a shared node lies below another is read off the running maximum of last_id in preorder: one sort
    of the candidates, no join of nodes with nodes."""
    if mode == "patience":
        candidates = candidates.where("arity = 2")
    elif mode == "proper":
        candidates = _with_below(candidates).where("arity >= below")
    elif mode != "nonest":
        raise ValueError(f"no such mode: {mode}")
    before = Window.partitionBy("pair_id", "side").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    top = candidates.withColumn("covered", F.max("last_id").over(before)).where("covered is null or covered < node_id")
    top = top.select("pair_id", "side", "node_id", "height", "mv")
    if mode != "nonest":
        return top
    sides = Window.partitionBy("pair_id", "mv")  # both sides of a variable, or it is no hole
    met = top.withColumns({"_first": F.min("side").over(sides), "_last": F.max("side").over(sides)})
    return met.where("_first <> _last").drop("_first", "_last")


def _with_below(candidates: DataFrame) -> DataFrame:
    """candidates with below: the greatest arity of any shared subtree below each (0: none). A group is one tree; from the last node to
    the first, a node takes in what stands on the stack within its range, so that the work is linear in the tree."""
    columns = [c for c in candidates.columns if c != "below"]

    def climb(tree: pa.Table) -> pa.Table:
        tree = tree.sort_by([("node_id", "descending")])
        stack: list[tuple[int, int]] = []
        out = []
        for node, last, own in zip(*(tree.column(c).to_pylist() for c in ("node_id", "last_id", "arity")), strict=True):
            below = 0
            while stack and stack[-1][0] <= last:
                below = max(below, stack.pop()[1])
            out.append(below)
            stack.append((node, max(own, below)))
        return tree.append_column("below", pa.array(out, pa.int64()))

    schema = ", ".join(f"{c} {t}" for c, t in candidates.select(columns).dtypes)
    return candidates.select(columns).groupBy("pair_id", "side").applyInArrow(climb, schema + ", below long")


def collection_subtrees(nodes: DataFrame, min_height: int = 1) -> DataFrame:
    """(digest, trees, occurrences) of the subtrees of a collection. nodes: tree_id."""
    per_tree = arity(nodes, ["tree_id"], min_height)
    return per_tree.groupBy("digest").agg(F.count("*").alias("trees"), F.sum("arity").alias("occurrences"))
