"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and every row is filed under a leaf. A query walks the tree through a priority queue (the child
whose centre has the largest inner product first) and visits leaves until the calibrated number is reached and enough rows are met.
The number is calibrated on the sample: the fewest visits that find the wanted share of the true neighbours. Leaves that are neighbours
in the tree form groups of bounded size; a query is sent once to each group in which it visits leaves, with these leaves, and its
nearest rows of the whole group come back.

Null, zero and non-finite vectors and null ids take no part. Inner products are between vectors of one length: each length that occurs
is searched by itself. Equal rows (id and vector) count once; of several vectors of one id each is a row and, if the id is a query's,
a query of its own. Of equal vectors only those of the k+1 smallest ids can be among a query's k nearest (ties go to the smaller id), so
that only they are filed; no result changes by that. Fewer than k candidates: all of them. An empty table gives an empty one; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbordiff.llm.common import map_arrow, numbered, written

#: Rows that the tree is fitted on, rows of a leaf aimed at and least sampled rows of one, children of a node, rows and queries that meet
#: in one task at once. The number of leaves grows with the table as far as the sample can tell leaves apart.
SAMPLE, LEAF_ROWS, LEAST_SAMPLED, BRANCHES, CHUNK = 20_000, 100, 8, 8, 8_192


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


class Tree:
    """centres[i], children[i] (empty for a leaf), leaf[i] (number of the leaf, or -1)."""

    def __init__(self, rows: np.ndarray, leaf_rows: int, seed: int = 5):
        random = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [rows.mean(0)], [[]], [-1]
        todo, self.leaves = [(0, np.arange(len(rows)))], 0
        while todo:
            node, members = todo.pop()
            groups = self._split(rows[members], min(BRANCHES, -(-len(members) // leaf_rows)), random) if len(members) > leaf_rows else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for g in groups:
                self.children[node].append(len(self.centres))
                self.centres.append(rows[members[g]].mean(0))
                self.children.append([])
                self.leaf.append(-1)
                todo.append((len(self.centres) - 1, members[g]))
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(rows: np.ndarray, k: int, random) -> list[np.ndarray]:
        centres = rows[random.choice(len(rows), k, replace=False)]
        for _ in range(12):
            near = (np.square(centres).sum(1) - 2 * rows @ centres.T).argmin(1)
            centres = np.stack([rows[near == i].mean(0) if (near == i).any() else rows[random.integers(len(rows))] for i in range(k)])
        near = (np.square(centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        return [g for i in range(k) if len(g := np.flatnonzero(near == i))]

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the nearest child."""
        out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            if not self.children[node]:
                out[members] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = (np.square(c).sum(1) - 2 * rows[members] @ c.T).argmin(1)
            todo += [(child, g) for i, child in enumerate(self.children[node]) if len(g := members[near == i])]
        return out

    def visit(self, query: np.ndarray):
        """The leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            for score, child in zip(self.centres[self.children[node]] @ query, self.children[node], strict=True):
                heapq.heappush(queue, (-float(score), child))


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, tests: int = 300) -> int:
    """The fewest visits that find the share `recall` of the true k nearest of sampled queries among the sample."""
    filed, places = tree.file(sample), []
    for q in np.random.default_rng(3).permutation(len(sample))[:tests]:
        scores = sample @ sample[q]
        scores[q] = -np.inf
        nearest = np.argpartition(-scores, min(k, len(scores) - 1))[: min(k, len(scores) - 1)]
        order = {leaf: i for i, leaf in enumerate(tree.visit(sample[q]))}
        places += [order[leaf] for leaf in filed[nearest]]
    return int(np.quantile(places, recall, method="higher")) + 1 if places else 1


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, its k nearest found by inner product."""
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    whole = whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0))
    whole = numbered(whole.distinct(), "row", "vectors")
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in whole.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        found = found.unionByName(_search(whole.where(F.size("v") == r.n), r.n, r["count"], query_every, k, recall))
    return found


def _groups(sizes: np.ndarray) -> np.ndarray:
    """The group of each leaf: neighbouring leaves of about CHUNK rows together."""
    before = np.cumsum(sizes) - sizes
    return (before // CHUNK).astype(np.int32)


def _search(whole: DataFrame, dimensions: int, total: int, query_every: int, k: int, recall: float) -> DataFrame:
    """whole: (vec_id, v, row), a table of rows of one length."""
    spark, kind = whole.sparkSession, dict(whole.dtypes)["v"]
    first = Window.partitionBy("v").orderBy("vec_id", "row")
    rows = whole.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    sampled = whole.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, 0.9 * SAMPLE / total)))) if total > SAMPLE else whole
    sample = np.array([r.v for r in sampled.orderBy("row").limit(SAMPLE).collect()], float)
    if not len(sample):
        sample = np.array([r.v for r in whole.limit(1).collect()], float)
    distinct = np.unique(sample, axis=0)  # copies don't shape the tree, but count when it is calibrated
    tree = Tree(distinct, max(LEAST_SAMPLED, LEAF_ROWS * len(sample) // total))
    visits = calibrate(tree, sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.file(_matrix(b.column(1), dimensions)), pa.int32())], ["vec_id", "v", "row", "leaf"])

    filed = written(map_arrow(rows, file, f"vec_id long, v {kind}, row long, leaf int"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():  # as many as the tree has leaves
        sizes[r.leaf] = r["count"]
    told = spark.sparkContext.broadcast((sizes, _groups(sizes)))
    # a leaf of more rows than a task takes (close rows that the sample had few of) is cut into parts
    parts = {g: -(-int(n) // CHUNK) for g, n in enumerate(np.bincount(told.value[1], sizes)) if n > 2 * CHUNK}

    def walk(batches):
        sizes, groups = told.value
        for b in batches:
            at, asked, leaves = [], [], []
            for i, q in enumerate(_matrix(b.column(1), dimensions)):
                met, wanted = 0, {}
                for n, leaf in enumerate(shared.value.visit(q)):
                    if n >= visits and met > k:
                        break
                    if sizes[leaf]:
                        wanted.setdefault(int(groups[leaf]), []).append(leaf)
                        met += sizes[leaf]
                at += [i] * len(wanted)
                asked += wanted
                leaves += wanted.values()
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(asked, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["vec_id", "v", "row", "group", "leaves"])

    asked = written(map_arrow(whole.where(F.col("vec_id") % query_every == 0), walk, f"vec_id long, v {kind}, row long, group int, leaves array<int>"), "visits")
    asks = {r.group: -(-r["count"] // CHUNK) for r in asked.groupBy("group").count().collect() if r["count"] > CHUNK}

    def many(counts: dict[int, int]):
        """Into how many parts a group's rows or queries are cut."""
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("group")), F.lit(1)) if counts else F.lit(1)

    def cut(df: DataFrame, own, other, names: list[str]) -> DataFrame:
        """Each row in its own part of its group, and once for each part of the other side."""
        df = df.withColumn(names[0], F.pmod(F.xxhash64("row"), own).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), (other - 1).cast("int"))))

    numbers = F.from_json(F.lit(json.dumps(told.value[1].tolist())), "array<int>")
    grouped = filed.withColumn("group", F.element_at(numbers, F.col("leaf") + 1))
    left = cut(asked, many(asks), many(parts), ["qpart", "part"]).groupBy("group", "part", "qpart")
    right = cut(grouped, many(parts), many(asks), ["part", "qpart"]).groupBy("group", "part", "qpart")
    nearest = pa.list_(pa.struct([("d", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("best", nearest)])

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        leaf, ids, own = (rows.column(c).to_numpy() for c in ("leaf", "vec_id", "row"))
        order = np.lexsort((own, ids, leaf))
        leaf, ids, own = leaf[order], ids[order], own[order]
        x = _matrix(rows.column("v").combine_chunks(), dimensions)[order]
        edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
        place = {int(leaf[b]): (b, e) for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        q, asker = _matrix(queries.column("v").combine_chunks(), dimensions), queries.column("row").to_numpy()
        # the queries of each leaf, and what each query has found so far: its k best scores
        wanted = queries.column("leaves").combine_chunks()
        at = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
        flat = wanted.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        at, flat = at[order], flat[order]
        edges = np.flatnonzero(np.diff(flat, prepend=-1, append=-1))
        scores, rows_met = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if int(flat[b]) not in place:
                continue
            lo, hi = place[int(flat[b])]
            for c in range(b, e, 1024):
                who = at[c : min(e, c + 1024)]
                for low in range(lo, hi, 4096):
                    part = slice(low, min(hi, low + 4096))
                    # what is near by the library's product is summed again, so that scores are the same whatever the batch
                    new = q[who] @ x[part].T
                    new[asker[who][:, None] == own[part][None, :]] = -np.inf
                    edge = scores[who].min(1, keepdims=True)
                    near = np.flatnonzero((new >= edge - 1e-9 * np.abs(np.where(np.isfinite(edge), edge, 0))).any(1))
                    if not len(near):
                        continue
                    r, col = np.nonzero(new[near] >= edge[near] - 1e-9 * np.abs(np.where(np.isfinite(edge[near]), edge[near], 0)))
                    r = near[r]
                    real = np.isfinite(new[r, col])
                    r, col = r[real], col[real]
                    exact = (q[who[r]] * x[low + col]).sum(1)
                    # old and new together: of each query the k best, ties to the smaller id
                    all_q = np.concatenate([r, np.repeat(np.arange(len(who)), k)])
                    all_s = np.concatenate([exact, scores[who].ravel()])
                    all_r = np.concatenate([low + col, rows_met[who].ravel()])
                    kept = all_r >= 0
                    all_q, all_s, all_r = all_q[kept], all_s[kept], all_r[kept]
                    order = np.lexsort((own[all_r], ids[all_r], -all_s, all_q))
                    all_q, all_s, all_r = all_q[order], all_s[order], all_r[order]
                    rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                    top = rank < k
                    fresh_s, fresh_r = np.full((len(who), k), -np.inf), np.full((len(who), k), -1)
                    fresh_s[all_q[top], rank[top]], fresh_r[all_q[top], rank[top]] = all_s[top], all_r[top]
                    scores[who], rows_met[who] = fresh_s, fresh_r
        best = [[{"d": -s, "vec_id": int(ids[r]), "row": int(own[r])} for s, r in zip(ss, rr, strict=True) if r >= 0] for ss, rr in zip(scores.tolist(), rows_met.tolist(), strict=True)]
        return pa.table([queries.column("vec_id"), queries.column("row"), pa.array(best, nearest)], schema=schema)

    met = left.cogroup(right).applyInArrow(meet, "query_id long, query long, best array<struct<d:double,vec_id:long,row:long>>")
    best = met.groupBy("query_id", "query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.d")).alias("score"))
