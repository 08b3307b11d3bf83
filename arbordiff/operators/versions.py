"""Patches between any two versions of a document, by an associative scan over rows of versions.

Versions are rows, not arrays. The patch of neighbouring versions is a segment of level 0; two neighbouring segments of a level, the first
of an even number, compose to one of the next. A level is one join on (key, number) and one kernel on a pair of patches, and there are as
many levels as the longest history has bits. The patch from version i to j is then composed of at most two segments of each level. No row,
group or task holds the versions of a key: a key with a third of all rows is dealt out like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbordiff.functions import kernels
from arbordiff.operators.patches import Options
from arbordiff.sources.tables import stored

SEGMENT = {"status": "string", "error": "string", "patch": "string"}


def numbered(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, number, text): the versions of each key from 0 in the order of `order`; of equal ones the lesser text comes first. Rows are sorted
    by ranges of (key, order), and only the ranges' counts are summed by key, so that long histories are numbered in parts. Null keys go;
    a null order comes first."""
    kept = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text"))
    # stored, as the ranges are drawn anew whenever they are computed
    dealt = stored(kept.repartitionByRange("key", "order", "text").withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = dealt.withColumn("place", F.row_number().over(Window.partitionBy("key", "range").orderBy("order", "text")) - 1)
    return within.join(starts, ["key", "range"]).select("key", (F.col("start") + F.col("place")).alias("number"), "text")


def segments(versions: DataFrame, grammar: str, min_height: int = 1, mode: str = "nonest", seconds: float = 0) -> DataFrame:
    """(key, level, index, status, error, patch): of each key the composed patches from version index * 2 ** level to (index + 1) * 2 ** level.
    versions: as from numbered(). A segment that can't be made has a status other than success, and so have those made of it."""
    options = Options(min_height, mode)
    versions = stored(versions, "versions")
    after = versions.select("key", (F.col("number") - 1).alias("number"), F.col("text").alias("_after"))
    pairs = versions.withColumnRenamed("text", "_before").join(after, ["key", "number"])
    made = kernels.add_columns(pairs, ["_before", "_after"], SEGMENT, lambda s, a, b: kernels.patch_row(s, grammar, a, b, options), seconds)
    level = out = stored(made.select("key", F.lit(0).alias("level"), F.col("number").alias("index"), *SEGMENT), "segments")
    for n in range(1, 63):
        half = F.shiftright("index", 1)
        first = level.where("index % 2 = 0").select("key", half.alias("index"), F.col("patch").alias("_first"))
        second = level.where("index % 2 = 1").select("key", half.alias("index"), F.col("patch").alias("_second"))
        made = kernels.add_columns(first.join(second, ["key", "index"]), ["_second", "_first"], SEGMENT, kernels.compose_row, seconds)
        level = stored(made.select("key", F.lit(n).alias("level"), "index", *SEGMENT), "segments")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def pieces(begin: Column, end: Column) -> Column:
    """The segments that lie end to end from version begin to end, in this order: array of (start, level, index). Of each level at most one
    at either side: the first is odd, or the last is even, so that no larger segment holds it."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        low, high = F.ceil(begin / size).cast("long"), F.floor(end / size).cast("long")
        left = F.when((low < high) & (low % 2 == 1), F.struct((low * size).alias("start"), level.alias("level"), low.alias("index")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(((high - 1) * size).alias("start"), level.alias("level"), (high - 1).alias("index")))
        return F.array_compact(F.array(left, right))

    return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(50)), of)))


def between(made: DataFrame, ranges: DataFrame, seconds: float = 0) -> DataFrame:
    """ranges (key, begin, end and others) with n_segments, status, error and patch: from version begin to version end. A range without a
    step has the status empty, one that the history doesn't have no-such-version; both have no patch. made: as from segments()."""
    rest = [c for c in ranges.columns if c not in ("n_segments", *SEGMENT)]
    asked = stored(ranges.select(*rest, F.monotonically_increasing_id().alias("_row")).withColumn("_pieces", pieces(F.col("begin"), F.col("end"))), "asked")
    wanted = asked.select("_row", "key", F.inline("_pieces"))
    found = wanted.join(made.select("key", "level", "index", "patch"), ["key", "level", "index"])
    # at most two pieces of each level meet in a row
    chains = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "patch"))), lambda x: x["patch"]).alias("_patches"))
    valid = (F.col("begin") >= 0) & (F.col("begin") <= F.col("end"))
    joined = asked.join(chains, "_row", "left").withColumn("n_segments", F.size("_pieces").cast("long"))
    joined = joined.withColumn("_patches", F.when(valid & (F.size("_pieces") == F.coalesce(F.size("_patches"), F.lit(0))), F.coalesce("_patches", F.array().cast("array<string>"))))
    return kernels.add_columns(joined, ["_patches"], SEGMENT, kernels.chain_patches_row, seconds).select(*rest, "n_segments", *SEGMENT)
