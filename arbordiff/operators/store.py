"""A content-addressed store of trees: each text is parsed once, each distinct subtree is a row once, and documents are roots.

Tables: occurrences (tree_id, node_id, last_id, height, digest), one row for each constructor of each tree; subtrees (digest, kind, dtype, con,
prim_type, prim_val, height, size, kids), one row for each distinct subtree of the collection, with the digests of its children; roots
(tree_id, digest). Occurrences are parsed and written once; what works on pairs of trees reads them and meets by digest."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbordiff.functions.kernels import node_table
from arbordiff.sources.tables import stored

CONTENT = ("kind", "dtype", "con", "prim_type", "prim_val", "height", "size", "kids")


@dataclass(frozen=True)
class Store:
    """occurrences also hold the columns of CONTENT if the store was built for its subtrees."""

    occurrences: DataFrame

    @cached_property
    def subtrees(self) -> DataFrame:
        """Digest and content of each distinct subtree. Equal digests have equal content, so that any row of a digest stands for all."""
        found = self.occurrences.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in CONTENT])
        return stored(found, "subtrees")

    @property
    def roots(self) -> DataFrame:
        return self.occurrences.where("node_id = 0").select("tree_id", "digest")

    def arities(self, min_height: int = 1) -> DataFrame:
        """(tree_id, digest, arity): how often a tree has each subtree higher than min_height. Summed before it is shuffled."""
        return self.occurrences.where((F.col("kind") == "roll") & (F.col("height") > min_height)).groupBy("tree_id", "digest").agg(F.count("*").alias("arity"))

    def shared_subtrees(self, min_height: int = 1) -> DataFrame:
        """(digest, trees, occurrences)."""
        return self.arities(min_height).groupBy("digest").agg(F.count("*").alias("trees"), F.sum("arity").alias("occurrences"))

    def sharing(self, pairs: DataFrame, min_height: int = 1) -> DataFrame:
        """(pair_id, src_id, dst_id, digest, arity, mv) of the subtrees that both trees of a pair have; mv from 0 in order of digest.
        pairs: (pair_id, src_id, dst_id) of different trees. Subtrees of a single tree of the collection can't be shared and go before pairs are formed."""
        arities = stored(self.arities(min_height), "arities")
        several = arities.groupBy("digest").agg(F.count("*").alias("trees")).where("trees > 1")
        often = stored(arities.join(several, "digest", "left_semi"), "often")
        source = pairs.join(often.select(F.col("tree_id").alias("src_id"), "digest", F.col("arity").alias("src_arity")), "src_id")
        both = source.join(often.select(F.col("tree_id").alias("dst_id"), "digest", F.col("arity").alias("dst_arity")), ["dst_id", "digest"])
        both = both.select("pair_id", "src_id", "dst_id", "digest", (F.col("src_arity") + F.col("dst_arity")).alias("arity"))
        return both.withColumn("mv", F.row_number().over(Window.partitionBy("pair_id").orderBy("digest")) - 1)

    def candidates(self, shares: DataFrame) -> DataFrame:
        """(pair_id, side, node_id, last_id, height, digest, arity, mv): where both trees of each pair have what they share. One scan of
        the occurrences for both sides."""
        sides = F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src_id").alias("tree_id")), F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("tree_id"))))
        asked = shares.select("pair_id", "digest", "arity", "mv", sides.alias("x")).select("pair_id", "digest", "arity", "mv", "x.*")
        nodes = self.occurrences.where("kind = 'roll'").select("tree_id", "digest", "node_id", "last_id", "height")
        return asked.join(nodes, ["tree_id", "digest"]).drop("tree_id")


def build(trees: DataFrame, text_col: str, grammar: str, id_col: str = "tree_id", with_content: bool = False) -> Store:
    """The store of a collection; texts without a tree have no rows, null ids neither. with_content: for Store.subtrees."""
    columns = ["node_id", "last_id", *(CONTENT if with_content else ("kind", "height")), "digest"]
    nodes = node_table(trees.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("tree_id"), text_col), text_col, grammar, columns)
    return Store(stored(nodes, "occurrences"))
