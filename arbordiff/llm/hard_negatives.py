"""Hard negatives by branch and bound over ball trees.

Every row belongs to a cell: the bucket of its label, and the nearest of a few centres of a bounded sample. A cell is cut into partitions
of at most about PART rows, and each partition has a ball tree of its own. A ball (centre, radius) bounds the inner products of all rows
in it with a query from above and from below. An anchor is first sent to the cells of its own label's bucket and finds its positives, then,
with the window of each positive, to every cell that the windows and the cell's ball leave open, and finds the highest scores within each
window. Nodes go that lie outside the window or strictly beneath the k-th score found so far; results are exact. The partitions' findings
are merged by a top-k whose first half runs before the shuffle.

A component x counts as floor(scale * x), and scores are integers; they are exact beyond the 53 bits of a double, too, and a score beyond a
long is the nearest long. Null labels and ids, and vectors that are null, empty or hold null or non-finite components take no part. Inner
products are between vectors of one length, so that rows of another length are neither positives nor negatives. Equal rows (id, vector and
label) count once; several vectors of one id are rows of their own. Equal scores: smaller id first, then the row stored first. Fewer
than asked: all. An empty table gives an empty one; other columns are left alone, whatever their names."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbordiff.llm.common import map_arrow, numbered, written

#: Rows that the centres are fitted on; buckets of labels and centres at most (their product bounds what is broadcast); rows of a cell that
#: are worth another centre; rows of a partition and queries that meet at once; rows of a leaf.
SAMPLE, BUCKETS, CENTRES, CELL, PART, QUERIES, LEAF = 10_000, 16, 64, 50_000, 8_192, 2_048, 128
LONG = 2**63 - 1


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles: integers, if large ones no longer all of them."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def is_wide(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether an inner product may be more than a double holds exactly."""
    return np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] >= 2**53


def products(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Exact inner products, as doubles or, if wide, as integers of any length."""
    if not wide:
        return q @ x.T
    left, right = ([[int(v) for v in row] for row in side.tolist()] for side in (q, x))
    out = np.empty((len(q), len(x)), object)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out[i, j] = max(-LONG - 1, min(LONG, sum(v * w for v, w in zip(a, b, strict=True))))
    return out


class BallTree:
    """Rows in an order in which each node is a slice: nodes are (begin, end, left child, right child), balls centre and radius."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[list[int]] = []
        centres, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            own = x[self.order[begin:end]]
            centre = own.mean(0)
            away = np.sqrt(np.square(own - centre).sum(1))
            n = len(self.nodes)
            self.nodes.append([begin, end, -1, -1])
            centres.append(centre)
            radii.append(away.max())
            if parent >= 0:
                self.nodes[parent][2 + side] = n
            if end - begin > leaf and radii[-1] > 0:
                far = own[away.argmax()]
                along = own @ (own[np.square(own - far).sum(1).argmax()] - far)  # between two rows that are far apart
                half = (end - begin) // 2
                split = np.argpartition(along, half)
                self.order[begin:end] = self.order[begin:end][split]
                todo += [(begin, begin + half, n, 0), (begin + half, end, n, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any row of each node, with room for rounding."""
        return ball_bounds(q, self.centres, self.radii)


def ball_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt(np.square(q).sum(1))[:, None]
    middle = q @ centres.T
    reach = length * radii + 1e-9 * (length * (radii + np.sqrt(np.square(centres).sum(1)))) + 1e-6
    return middle - reach, middle + reach


def top(tree: BallTree, x: np.ndarray, q: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, allowed, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query of q the k rows of greatest score between low and high, ties by `order` (smaller first): (query, row, score), sorted
    by query and rank. allowed(queries, rows): which pairs count. low and high: arrays (queries, windows); a window is a query of its own."""
    n, windows = len(q), low.shape[1]
    least, most = tree.bounds(q)
    wide = is_wide(q, x)
    score = np.full((n, windows, k), -np.inf, object if wide else float)
    found = np.full((n, windows, k), -1)
    todo = [(0, np.arange(n))]
    while todo:
        node, who = todo.pop()
        floor = np.maximum(low[who], score[who, :, -1])  # a window needs nothing strictly beneath its k-th score
        who = who[((most[who, node, None] >= floor) & (least[who, node, None] <= high[who])).any(1)]
        if not len(who):
            continue
        begin, end, left, right = tree.nodes[node]
        if left >= 0:
            # the child that more of the queries prefer comes first (last on the stack)
            first, second = (left, right) if (most[who, left] >= most[who, right]).sum() * 2 >= len(who) else (right, left)
            todo += [(second, who), (first, who)]
            continue
        rows = tree.order[begin:end]
        new, fits = products(q[who], x[rows], wide), allowed(who, rows)
        for w in range(windows):
            edge = np.maximum(low[who, w], score[who, w, -1])
            i, j = np.nonzero(fits & (new >= edge[:, None]) & (new <= high[who, w][:, None]))
            if not len(i):
                continue
            touched = np.unique(i)
            held = who[touched]
            at = np.concatenate([i, np.repeat(touched, k)])
            scores = np.concatenate([new[i, j], score[held, w].ravel()])
            ids = np.concatenate([rows[j], found[held, w].ravel()])
            real = ids >= 0
            at, scores, ids = at[real], scores[real], ids[real]
            best = np.lexsort((order[ids], -scores, at)) if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda m: (at[m], -scores[m], order[ids[m]])))
            at, scores, ids = at[best], scores[best], ids[best]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            kept = rank < k
            score[who[at[kept]], w, rank[kept]], found[who[at[kept]], w, rank[kept]] = scores[kept], ids[kept]
    at = np.nonzero(found >= 0)
    return np.ravel_multi_index(at[:2], (n, windows)), found[at], score[at]


def _centres(rows: np.ndarray, k: int) -> np.ndarray:
    centres = rows[np.random.default_rng(5).choice(len(rows), k, replace=False)]
    for _ in range(10):
        near = (np.square(centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        centres = np.stack([rows[near == i].mean(0) if (near == i).any() else centres[i] for i in range(k)])
    return centres


def mine(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by anchor_every and
    each of its `positives` nearest rows of the same label the first `negatives` rows of another label whose score is from least to most
    per cent of the positive's."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    rows = numbered(rows.distinct(), "row", "vectors")
    out = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        out = out.unionByName(_mine(rows.where(F.size("v") == r.n), r["count"], anchor_every, positives, negatives, least, most, scale))
    return out


def _mine(rows: DataFrame, total: int, anchor_every: int, positives: int, negatives: int, least: int, most: int, scale: int) -> DataFrame:
    spark, kind = rows.sparkSession, dict(rows.dtypes)["v"]
    k = min(CENTRES, -(-total // CELL))
    sampled = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, 0.9 * SAMPLE / total)))) if total > SAMPLE else rows
    sample = np.array([r.v for r in sampled.select("v").limit(SAMPLE).collect()], float) if k > 1 else np.zeros((0, 1))
    centres = spark.sparkContext.broadcast(_centres(np.floor(scale * sample), min(k, len(sample))) if len(sample) else None)

    def file(batches):
        for b in batches:
            x = integers(b.column(1), scale)
            near = np.zeros(len(x), np.int64) if centres.value is None else (np.square(centres.value).sum(1) - 2 * x @ centres.value.T).argmin(1)
            away = np.sqrt(np.square(x - (0 if centres.value is None else centres.value[near])).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(away)], ["vec_id", "v", "label", "row", "centre", "away"])

    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    filed = map_arrow(rows, file, f"vec_id long, v {kind}, label string, row long, centre int, away double")
    filed = written(filed.withColumn("cell", F.col("centre") * BUCKETS + bucket).drop("centre"), "cells")
    seen = filed.groupBy("cell").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("away").alias("radius")).collect()  # CENTRES * BUCKETS rows at most
    cells = {r.cell: r for r in seen}
    parts = {r.cell: -(-r.n // PART) for r in seen}
    parted = filed.withColumn("part", F.pmod(F.xxhash64("row"), _of(parts)).cast("int"))
    told = spark.sparkContext.broadcast({r.cell: (r.low, r.high, r.radius, parts[r.cell]) for r in seen})
    anchors = filed.where(F.col("vec_id") % anchor_every == 0).select("vec_id", "v", "label", "row", F.col("cell").alias("own"))

    def sent(batches, to) -> object:
        """Each query once for each partition of the cells that to(batch, cells) marks."""
        for b in batches:
            which, into, part = [], [], []
            names = sorted(told.value)
            for i, c in zip(*np.nonzero(to(b, names)), strict=True):
                p = told.value[names[c]][3]
                which += [i] * p
                into += [names[c]] * p
                part += range(p)
            taken = b.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(into, pa.int32()), pa.array(part, pa.int32())], [*b.schema.names, "cell", "part"])

    def same_bucket(b: pa.RecordBatch, names: list[int]) -> np.ndarray:
        return (b.column(b.schema.get_field_index("own")).to_numpy()[:, None] % BUCKETS) == (np.array(names) % BUCKETS)[None, :]

    def within(b: pa.RecordBatch, names: list[int]) -> np.ndarray:
        """Cells with a row of another label whose ball meets a window."""
        low, high = _windows(b.column(b.schema.get_field_index("scores")).to_pylist(), positives, least, most)
        labels, q = b.column(b.schema.get_field_index("label")).to_pylist(), integers(b.column(b.schema.get_field_index("v")), scale)
        middle = np.zeros((len(names), q.shape[1])) if centres.value is None else centres.value[np.array(names) // BUCKETS]
        lo, hi = ball_bounds(q, middle, np.array([told.value[c][2] for c in names]))
        other = np.array([[not (told.value[c][0] == told.value[c][1] == y) for c in names] for y in labels])
        return other & ((hi[:, :, None] >= low[:, None, :]) & (lo[:, :, None] <= high[:, None, :]) & (low <= high)[:, None, :]).any(2)

    fields = f"vec_id long, v {kind}, label string, row long, own int"
    asked = map_arrow(anchors, lambda bs: sent(bs, same_bucket), f"{fields}, cell int, part int")
    pairs = _met(asked, parted, _positives(positives, scale), "query long, other long, other_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "other_id", "other")
    chosen = written(pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives), "positives")
    windows = chosen.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("scores"))  # at most `positives` each
    asking = anchors.join(windows.withColumnRenamed("query", "row"), "row").select("vec_id", "v", "label", "row", "own", F.transform("scores", lambda s: s["score"]).alias("scores"))
    asked = map_arrow(asking, lambda bs: sent(bs, within), f"{fields}, scores array<long>, cell int, part int")
    met = _met(asked, parted, _negatives(positives, negatives, least, most, scale), "query long, positive int, other long, other_id long, score long")
    best = Window.partitionBy("query", "positive").orderBy(F.desc("score"), "other_id", "other")
    met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).alias("n")
    out = met.join(chosen.alias("p"), (F.col("n.query") == F.col("p.query")) & (F.col("n.positive") == F.col("p.rank"))).join(anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id")).alias("a"), F.col("n.query") == F.col("a.query"))
    return out.select("anchor_id", F.col("p.other_id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.other_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def _of(counts: dict[int, int]) -> Column:
    """What counts has for the column `cell`, else 0."""
    return F.element_at(F.from_json(F.lit(json.dumps([counts.get(c, 0) for c in range(CENTRES * BUCKETS)])), "array<int>"), F.col("cell") + 1)


def _met(asked: DataFrame, parted: DataFrame, meet, schema: str) -> DataFrame:
    """meet(queries, rows) for each partition and block of about QUERIES of the queries that were sent there. A cell's partitions get the
    same queries."""
    asked = written(asked, "asked")
    blocks = {r.cell: -(-r["count"] // QUERIES) for r in asked.where("part = 0").groupBy("cell").count().collect()}
    rows = parted.where(_of(blocks) > 0).withColumn("block", F.explode(F.sequence(F.lit(0), _of(blocks) - 1)))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("row"), _of(blocks)).cast("int"))
    names = {"cell": "to_cell", "part": "to_part", "block": "to_block"}
    return queries.groupBy("cell", "part", "block").cogroup(rows.withColumnsRenamed(names).groupBy(*names.values())).applyInArrow(meet, schema)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers for the labels in the columns, equal ones for equal labels."""
    number: dict[str, int] = {}
    return [np.array([number.setdefault(y, len(number)) for y in c.to_pylist()], np.int64) for c in columns]


def _order(rows: pa.Table) -> np.ndarray:
    """The place of each row by (id, row)."""
    out = np.empty(rows.num_rows, np.int64)
    out[np.lexsort((rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()))] = np.arange(rows.num_rows)
    return out


def _positives(k: int, scale: int):
    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "other", "other_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        q, x = integers(queries.column("v").combine_chunks(), scale), integers(rows.column("v").combine_chunks(), scale)
        mine, own = _codes(queries.column("label"), rows.column("label"))
        asker, row = queries.column("row").to_numpy(), rows.column("row").to_numpy()
        open_ = np.full((len(q), 1), np.inf)
        at, hit, score = top(BallTree(x), x, q, k, -open_, open_, lambda who, what: (mine[who][:, None] == own[what][None, :]) & (asker[who][:, None] != row[what][None, :]), _order(rows))
        return pa.table([pa.array(asker[at]), pa.array(row[hit]), pa.array(rows.column("vec_id").to_numpy()[hit]), pa.array([int(s) for s in score.tolist()], pa.int64())], names)

    return meet


def _windows(scores: list[list[int]], positives: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query's windows: least * p <= 100 * score <= most * p. A missing positive's window is empty."""
    kind = object if any(abs(p) >= 2**53 for own in scores for p in own) else float
    low, high = np.full((len(scores), positives), np.inf, kind), np.full((len(scores), positives), -np.inf, kind)
    for i, own in enumerate(scores):
        for j, p in enumerate(own):
            low[i, j], high[i, j] = -(-least * p // 100), most * p // 100
    return low, high


def _negatives(positives: int, k: int, least: int, most: int, scale: int):
    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "positive", "other", "other_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names)
        q, x = integers(queries.column("v").combine_chunks(), scale), integers(rows.column("v").combine_chunks(), scale)
        mine, own = _codes(queries.column("label"), rows.column("label"))
        low, high = _windows(queries.column("scores").to_pylist(), positives, least, most)
        row = rows.column("row").to_numpy()
        at, hit, score = top(BallTree(x), x, q, k, low, high, lambda who, what: mine[who][:, None] != own[what][None, :], _order(rows))
        query, window = np.divmod(at, positives)
        return pa.table([pa.array(queries.column("row").to_numpy()[query]), pa.array(window + 1, pa.int32()), pa.array(row[hit]), pa.array(rows.column("vec_id").to_numpy()[hit]), pa.array([int(s) for s in score.tolist()], pa.int64())], names)

    return meet
