"""Which of many patches apply to which of many trees: an index of deletion contexts that is joined with the trees' nodes.

A deletion context asks for a subtree (where it has no variables) or a constructor (where it has) at certain places. Each such demand is a key,
a hash of place and content, and each node of a tree offers the keys that it can answer. A patch is filed under its rarest demands, rarest
first: a path in a discrimination tree, of which patches with the same demands share the nodes. Trees walk it level by level, a join of
(tree, node) with the demands that the tree offers. What arrives is a candidate: the patch is applied, which also tells whether a
variable that occurs twice meets the same subtree. Nothing that applies is lost, as a tree to which a patch applies answers all demands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbordiff.functions import kernels
from arbordiff.operators import patches
from arbordiff.operators.terms import HOLE, ROLL, Space, Term, digests
from arbordiff.sources.grammars import ParseError, grammar, install, registry
from arbordiff.sources.tables import stored

#: Demands that a patch is filed under.
LEVELS = 3
#: Keys of a batch of rows that are sent on together.
MOST_KEYS = 1 << 14


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=16).digest()


def _head(x: Term) -> bytes:
    return f"{x.dtype}\0{x.con}\0{len(x.kids)}".encode("utf8", "surrogatepass")


def _below(place: bytes, i: int) -> bytes:
    return _hash(place, b"%d" % i)


ROOT = _hash(b"root")
ANY = _hash(ROOT, b"any")


def demands(pattern: Term) -> list[bytes]:
    """The keys of a deletion context: subtrees without variables as a whole, else constructors. A lone variable asks for any tree."""
    names, out, stack = digests(pattern), [], [(pattern, ROOT)]
    while stack:
        x, place = stack.pop()
        if x.rigid:
            out.append(_hash(place, b"is", names[id(x)].encode()))
        elif x.kind == ROLL:
            out.append(_hash(place, b"has", _head(x)))
            stack.extend((k, _below(place, i)) for i, k in enumerate(x.kids))
    return out or [ANY]


def offers(tree: Term) -> Iterator[bytes]:
    """The keys that a tree answers, two for each constructor and one for each value."""
    names, stack = digests(tree), [(tree, ROOT)]
    yield ANY
    while stack:
        x, place = stack.pop()
        yield _hash(place, b"is", names[id(x)].encode())
        if x.kind == ROLL:
            yield _hash(place, b"has", _head(x))
            stack.extend((k, _below(place, i)) for i, k in enumerate(x.kids))


def _keys(df: DataFrame, id_col: str, value_col: str, keys_of) -> DataFrame:
    """(id_col, key): a row for each key; what has none (no patch, no tree) has no rows."""
    kernels.bounded_batches(df.sparkSession)
    registered = registry()

    def kernel(batches):
        install(*registered)

        def flushed(b: pa.RecordBatch, at: list[int], keys: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], [id_col, "key"])

        for b in batches:
            at, keys = [], []
            for i, value in enumerate(b.column(1).to_pylist()):
                if value is None:
                    continue
                try:
                    found = [*keys_of(value)]
                except (ValueError, RecursionError):  # not a patch, not a text of the grammar
                    continue
                at += [i] * len(found)
                keys += found
                if len(keys) >= MOST_KEYS:
                    yield flushed(b, at, keys)
                    at, keys = [], []
            if keys:
                yield flushed(b, at, keys)

    return df.select(id_col, value_col).mapInArrow(kernel, f"{id_col} {dict(df.dtypes)[id_col]}, key binary")


def filed_changes(df: DataFrame, source_col: str, target_col: str, name: str, keep: list[str]) -> DataFrame:
    """The columns of keep with status, error, patch and its demands, which are told while the patch is at hand: reading it again costs as
    much as half of making it."""

    def work(space: Space, source: str | None, target: str | None) -> dict:
        try:
            a, b = kernels.parsed(space, name, source, target)
        except ParseError as e:
            return {"status": "parse-error", "error": str(e)}
        made = patches.diff(space, a, b)
        return {"status": "success", "patch": patches.encode_patch(made), "demands": demands(patches.distribute(space, made).delete)}

    return kernels.add_columns(df, [source_col, target_col], {"status": "string", "error": "string", "patch": "string", "demands": "array<binary>"}, work, keep=keep)


def applicable(changes: DataFrame, trees: DataFrame, name: str, levels: int = LEVELS) -> DataFrame:
    """(patch_id, tree_id, status, error, result) of the pairs that fit: status success, or error with a variable that has no value.
    changes: (patch_id, patch) and, if filed_changes() made them, demands; trees: (tree_id, text). Ids are unique; equal patches and equal texts are best given once, as the result
    has a row for each pair."""
    parse = grammar(name)

    def of_patch(text: str) -> list[bytes]:
        space = Space()
        return demands(patches.distribute(space, patches.decode_patch(space, text)).delete)

    told = "demands" in changes.columns
    asked = changes.select("patch_id", F.explode("demands").alias("key")) if told else stored(_keys(changes, "patch_id", "patch", of_patch), "demands")
    wanted = asked.select("key").distinct()
    # only what some patch asks for is kept of the trees
    hits = stored(_keys(trees, "tree_id", "text", lambda text: offers(parse(Space(), text))).join(wanted, "key"), "offers")
    often = hits.groupBy("key").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("patch_id").orderBy("n", "key")
    ranked = asked.join(often, "key", "left").na.fill(0, ["n"]).withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= levels)
    filed = stored(ranked.groupBy("patch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("path")), "filed")
    nodes = filed.select(F.posexplode(F.transform("path", lambda k, i: F.struct(F.slice("path", F.lit(1), i).alias("parent"), k.alias("key"), F.slice("path", F.lit(1), i + 1).alias("node")))).alias("level", "x")).select("level", "x.*").distinct()
    nodes = stored(nodes, "nodes")
    at = hits.join(nodes.where("level = 0").select("key", "node"), "key").select("tree_id", "node")
    arrived = [at]
    for level in range(1, levels):
        asking = arrived[-1].join(nodes.where(F.col("level") == level).select(F.col("parent").alias("node"), "key", F.col("node").alias("next")), "node")
        arrived.append(stored(asking.join(hits, ["tree_id", "key"]).select("tree_id", F.col("next").alias("node")), "arrived"))
    everywhere = arrived[0]
    for a in arrived[1:]:
        everywhere = everywhere.unionByName(a)
    candidates = everywhere.join(filed.withColumnRenamed("path", "node"), "node").select("patch_id", "tree_id")
    pairs = candidates.join(changes.select("patch_id", "patch"), "patch_id").join(trees.select("tree_id", "text"), "tree_id")
    out = kernels.add_columns(pairs, ["patch", "text"], kernels.APPLY, lambda s, p, t: kernels.apply_row(s, name, p, t))
    return out.where("status <> 'apply-fail'").select("patch_id", "tree_id", *kernels.APPLY)
