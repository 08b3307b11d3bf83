"""The library's operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.functions import kernels
from arbordiff.operators import patch_index, versions
from arbordiff.operators.patches import Options


def parse_trees(df: DataFrame, text_col: str, grammar: str) -> DataFrame:
    """df with ast (null where the text has no tree), height, n_nodes and parse_error."""
    return kernels.add_columns(df, [text_col], {"ast": "string", "height": "int", "n_nodes": "int", "parse_error": "string"}, lambda s, t: kernels.parse_row(s, grammar, t))


def tree_nodes(df: DataFrame, text_col: str, grammar: str, columns: list[str] | None = None, values_only: bool = False) -> DataFrame:
    """The node table: a row for each node of each tree, with df's other columns. Texts without a tree have no rows. columns: those of
    kernels.NODE that are wanted (None: kernels.PLAIN, all but kids, the children's digests, and parse_error); digests cost the most. With
    parse_error a text without a tree has one row, which tells why. values_only: rows of the nodes that are values alone."""
    return kernels.node_table(df, text_col, grammar, columns or kernels.PLAIN, values_only)


def diff_pairs(df: DataFrame, source_col: str, target_col: str, grammar: str, min_height: int = 1, mode: str = "nonest", global_scope: bool = False, seconds: float = 0, max_nodes: int = 0, columns: list[str] | None = None) -> DataFrame:
    """df with status, error, patch, n_changes, n_copies, nm, patch_cost, cost, operations, secs and result. A row that takes longer than
    `seconds` (0: no limit) has the status timeout, one of more than max_nodes nodes (0: no limit) too-large. columns: those of these that are
    wanted beside the status (None: all); nothing else is worked out."""
    outputs = kernels.chosen(kernels.DIFF, columns)
    wanted = frozenset(outputs)
    options = Options(min_height, mode, global_scope, max_nodes)
    return kernels.add_columns(df, [source_col, target_col], outputs, lambda s, a, b: kernels.diff_row(s, grammar, a, b, options, wanted), seconds)


def apply_patches(df: DataFrame, patch_col: str, text_col: str, grammar: str, deal: bool = True) -> DataFrame:
    """df with status, error and result. deal: False where the rows come from another kernel, which has dealt them to tasks."""
    return kernels.add_columns(df, [patch_col, text_col], kernels.APPLY, lambda s, p, t: kernels.apply_row(s, grammar, p, t), deal=deal)


def compose_chain(df: DataFrame, versions_col: str, grammar: str, min_height: int = 1, mode: str = "nonest") -> DataFrame:
    """df with the composed patch over an array of versions and what it makes of the first."""
    options = Options(min_height, mode)
    return kernels.add_columns(df, [versions_col], kernels.CHAIN, lambda s, v: kernels.chain_row(s, grammar, v, options))


def show_pairs(df: DataFrame, source_col: str, target_col: str, grammar: str, width: int | str = 80) -> DataFrame:
    """df with tree_text and patch_text: the source's tree and the patch to the target (null without one), over lines of at most `width`
    characters (or as many as the column of that name says) where nothing single is longer; parse_error where there is no tree."""
    if isinstance(width, str):
        return kernels.add_columns(df, [source_col, target_col, width], kernels.SHOW, lambda s, a, b, w: kernels.show_row(s, grammar, a, b, w))
    return kernels.add_columns(df, [source_col, target_col], kernels.SHOW, lambda s, a, b: kernels.show_row(s, grammar, a, b, width))


def canonical_patches(df: DataFrame, patch_col: str, deal: bool = True) -> DataFrame:
    """df with patch_digest, edit_digests and edits: patches (and the changes in them that aren't copies) that differ in the names of
    variables alone have equal digests, so that they meet by grouping; edits are the changes as text with canonical names."""
    return kernels.add_columns(df, [patch_col], kernels.CANONICAL, kernels.canonical_row)


def applicable_patches(changes: DataFrame, trees: DataFrame, grammar: str) -> DataFrame:
    """(patch_id, tree_id, status, error, result) for all pairs of changes (patch_id, patch) and trees (tree_id, text) that fit."""
    return patch_index.applicable(changes, trees, grammar)


def version_segments(rows: DataFrame, key_col: str, order_col: str, text_col: str, grammar: str, min_height: int = 1, mode: str = "nonest", seconds: float = 0) -> DataFrame:
    """(key, level, index, status, error, patch): composed patches over rows of versions, for patches_between."""
    return versions.segments(versions.numbered(rows, key_col, order_col, text_col), grammar, min_height, mode, seconds)


def patches_between(segments: DataFrame, ranges: DataFrame, seconds: float = 0) -> DataFrame:
    """ranges (key, begin, end, ...) with n_segments, status, error and the patch from version begin to version end (numbers from 0)."""
    return versions.between(segments, ranges, seconds)


def composable(df: DataFrame, second_col: str, first_col: str) -> DataFrame:
    """df with composes: whether the patch second_col can follow the patch first_col; null where either isn't a patch."""
    return kernels.add_columns(df, [second_col, first_col], {"composes": "boolean", "parse_error": "string"}, kernels.composes_row)


def merge_triples(df: DataFrame, a_col: str, o_col: str, b_col: str, grammar: str, expected_col: str | None = None, min_height: int = 1, mode: str = "nonest", global_scope: bool = False, seconds: float = 0, max_nodes: int = 0, columns: list[str] | None = None, deal: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df with status, error, merged, labels and conflicts. seconds, max_nodes and columns: as for diff_pairs. deal: False where the rows are
    dealt to tasks already. keep: the columns of df that are passed on (None: all)."""
    outputs = kernels.chosen(kernels.MERGE, columns)
    wanted = frozenset(outputs)
    options = Options(min_height, mode, global_scope, max_nodes)
    texts = [a_col, o_col, b_col, *([expected_col] if expected_col else [])]
    return kernels.add_columns(df, texts, outputs, kernels.merges(grammar, options, wanted), seconds, deal, keep)


def write_conflict_labels(merged: DataFrame, path: str) -> None:
    """Appends a line for each conflict."""
    merged.select(F.explode("labels").alias("value")).write.mode("append").text(path)
