"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together form a partition; partition i gets a threshold t_i (-1: not looked at) with sum t_i = tau - m + 1, so that two
fingerprints within tau bits agree within t_i in some partition i. A dynamic programme picks the thresholds with the fewest expected
candidates. Every fingerprint probes the values within t_i of its own; what meets is verified on all 64 bits.

A key with many fingerprints is refined by further bits, and where even that leaves very many (fingerprints all around a centre), those
within floor(tau/2) and ceil(tau/2) bits of a value meet at that value: all that meet with one of the first kind are linked, so that a
minimum per value gives the links whatever the number.

Nulls and empty texts have no shingles: fingerprint zero, linked like any other. A null id never is a component's smallest unless it
has no other. Texts are read whole, however long. An empty table gives an empty one, repeated rows are repeated in the result, a tie of
bits (set in just half the hashes) is 0. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import batch, map_arrow, numbered, own_name, utf8, written
from arbordiff.llm.components import components

#: Fingerprints under one key beyond which the key is refined by further bits, and under a refined key beyond which balls are met.
REFINE, DENSE = 2048, 50_000
#: Fingerprints from which the expected candidates are estimated; the estimate steers cost only, never results.
ESTIMATE = 3000


def fingerprint(text: bytes, words_in_shingle: int = 3, seed: int = 42) -> int:
    """bytes.split() splits at 09-0D and 20, bytes.lower() maps A-Z only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_in_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -words_in_shingle]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], seed) for s, e in zip(starts, (ends[words_in_shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # 4 MB of bits at a time
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """(id_col, row, fp) for every row; row (row_col, or else a number given here) tells repeated rows apart."""
    kind = dict(docs.dtypes)[id_col]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words_in_shingle, seed) for t in utf8(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], [id_col, "row", "fp"])

    rows = docs.select(F.col(id_col), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(text_col))
    return map_arrow(rows, kernel, f"`{id_col}` {kind}, row long, fp long")


def _bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set: sums of a row for each task."""
    schema = pa.schema([("n", pa.int64()), ("c", pa.list_(pa.int64()))])

    def kernel(batches):
        n, total = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield batch(schema, [[n], [total.ravel().tolist()]])

    parts = prints.mapInArrow(kernel, "n long, c array<long>")
    rows = parts.select("n", F.posexplode("c").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    counts = np.zeros(4096)
    for r in rows:
        counts[r.i] = r.c
    return (rows[0].n if rows else 0), counts.reshape(64, 64)


def _grouped(n: int, counts: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about 64/m bits: each starts with a free bit and takes the bits most correlated with what it has."""
    p = np.diag(counts) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    free, parts = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [free.pop(0)]
        while len(part) < size:
            part.append(free.pop(int(np.argmax([related[b, part].sum() for b in free]))))
        parts.append(sorted(part))
    return parts


def _thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """costs[i][t+1]: cost of threshold t in partition i. The cheapest thresholds of the given sum, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(cost, -1):
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total]


def choose_partitions(prints: DataFrame, tau: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    n, counts = _bit_counts(prints)
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp")).limit(ESTIMATE).collect()], np.int64).view(np.uint64)
    choices = []
    for m in range(2, tau + 3):
        parts = _grouped(n, counts, m)
        costs = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            seen = np.zeros(65)
            for i in range(0, len(sample), 500):
                seen[: (c := np.bincount(np.bitwise_count((sample[i : i + 500, None] ^ sample) & mask).ravel())).size] += c
            seen[0] -= len(sample)
            near = np.cumsum(seen) / max(1, len(sample) * (len(sample) - 1))
            cost, ways = [0.0], 0.0
            for t in range(tau + 1):
                ways += float(np.prod([(len(part) - k) / (k + 1) for k in range(t)]))
                cost.append(20 * n * ways + n * n / 2 * max(near[t], ways * 0.5 ** len(part)))
            costs.append(cost)
        choices.append((*_thresholds(costs, tau - m + 1), parts))
    _, thresholds, parts = min(choices, key=lambda c: c[0])
    return [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0]


def _probes(prints: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, home, fp): each fingerprint under its own value of each partition (home) and under the values that it probes."""
    masks = [(sum(1 << b for b in bits), [0] if t == 0 else [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)], t) for bits, t in partitions]
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("home", pa.bool_()), ("fp", pa.int64())])

    def kernel(batches):
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            for i, (mask, flips, t) in enumerate(masks):
                own = x & np.uint64(mask)
                flip = np.array(flips, np.uint64)
                for lo in range(0, len(x), 1 << 13):
                    keys = own[lo : lo + (1 << 13), None] ^ flip
                    use = np.ones(keys.shape, bool)
                    if t == 1:  # of two that differ in one bit, the one without it probes
                        use[:, 1:] = (own[lo : lo + (1 << 13), None] & flip[1:]) == 0
                    r, c = np.nonzero(use)
                    yield batch(schema, [np.full(len(r), i, np.int32), keys[r, c].view(np.int64), c == 0, x[lo + r].view(np.int64)])

    return prints.mapInArrow(kernel, "part int, key long, home boolean, fp long")


def _forest(x: np.ndarray, home: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one key (home with home, home with probe) as a spanning forest: at most len(x)-1 of them."""
    label = np.arange(len(x))
    homes = np.flatnonzero(home)
    step = max(1, (1 << 20) // len(x))
    for lo in range(0, len(homes), step):
        block = homes[lo : lo + step]
        r, b = np.nonzero(np.bitwise_count(x[block, None] ^ x) <= tau)
        a = block[r]
        while (apart := label[a] != label[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
            while ((up := label[label]) != label).any():
                label = up
    other = np.flatnonzero(label != np.arange(len(x)))
    return x[other], x[label[other]]


def _linked(rows: DataFrame, tau: int) -> DataFrame:
    """(a, b): links that join all that is linked under a key. rows: sorted by key in each partition."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(keys, home, fp):
        edge = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        size = ends - starts
        x = fp.view(np.uint64)
        small = np.zeros(len(fp), bool)
        few = (size > 1) & (size <= 8)
        small[:] = np.repeat(few, size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, 8):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(x) > d else np.zeros(0, int)
            i = i[(home[i] | home[i + d]) & (np.bitwise_count(x[i] ^ x[i + d]) <= tau) & (x[i] != x[i + d])]
            if len(i):
                yield batch(schema, [fp[i], fp[i + d]])
        for g in np.flatnonzero(size > 8):
            s = slice(starts[g], ends[g])
            if home[s].any():
                a, b = _forest(x[s], home[s], tau)
                if len(a):
                    yield batch(schema, [a.view(np.int64), b.view(np.int64)])

    def kernel(batches):
        held, size = [], 0
        for b in batches:
            new = [np.asarray(b.column(i)) if i != 3 else b.column(3).to_numpy(zero_copy_only=False) for i in range(5)]
            if size >= 50_000 and len(new[4]):
                # all but the last key are whole; what came before the new batch is worked off up to where that key begins
                whole = [np.concatenate(p) for p in zip(*held, strict=True)]
                last = np.flatnonzero(np.any([whole[k] != whole[k][-1] for k in range(3)], axis=0))
                held = [whole]
                if len(last):
                    cut = int(last[-1]) + 1
                    yield from solve([h[:cut] for h in whole[:3]], whole[3][:cut], whole[4][:cut])
                    held = [[h[cut:] for h in whole]]
                size = len(held[0][4]) // 2  # a large key is put together again only when it has doubled
            held.append(new)
            size += len(new[4])
        if held:
            whole = [np.concatenate(p) for p in zip(*held, strict=True)]
            if len(whole[4]):
                yield from solve(whole[:3], whole[3], whole[4])

    return rows.select("part", "key", "sub", "home", "fp").mapInArrow(kernel, "a long, b long")


def links(prints: DataFrame, tau: int = 3) -> DataFrame:
    """prints: distinct fingerprints (fp). (a, b) such that a chain of them joins any two that are within tau bits, and no others."""
    partitions = choose_partitions(prints, tau)
    probes = _probes(prints, partitions)
    masks = [sum(1 << b for b in bits) for bits, _ in partitions]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    home = prints.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("part", "key"))
    hot = home.groupBy("part", "key").count().where(F.col("count") > REFINE).select("part", "key", F.lit(True).alias("hot"))
    rows = probes.join(hot, ["part", "key"], "left")
    # Of tau+1 chunks of the bits outside the partition, one is the same in both.
    chunks = []
    for m in masks:
        rest = [b for b in range(64) if not m >> b & 1]
        cut = [rest[i :: tau + 1] for i in range(tau + 1)]
        chunks.append([sum(1 << b for b in c) for c in cut])
    subs = F.lit(None).cast("array<long>")
    for i, cs in enumerate(chunks):
        each = [F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(c - (1 << 64) if c >> 63 else c).cast("long"))) for j, c in enumerate(cs)]
        subs = F.when(F.col("part") == i, F.array(*each)).otherwise(subs)
    rows = rows.withColumn("sub", F.explode(F.when(F.col("hot"), subs).otherwise(F.array(F.lit(0).cast("long")))))
    dense = rows.where("hot").groupBy("part", "key", "sub").count().where(F.col("count") > DENSE).select("part", "key", "sub", F.lit(True).alias("dense"))
    dense = written(dense, "dense")
    if dense.isEmpty():
        return _linked(_dealt(rows), tau)
    rows = rows.join(dense, ["part", "key", "sub"], "left")
    return _linked(_dealt(rows.where("dense is null")), tau).unionByName(_ball_links(rows.where("dense").select("fp").distinct(), tau))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.select("part", "key", "sub", "home", "fp").repartition("part", "key", "sub").sortWithinPartitions("part", "key", "sub")


def _ball_links(prints: DataFrame, tau: int) -> DataFrame:
    """prints: distinct (fp). Links that join all within tau bits. Each fingerprint is filed under the values within floor(tau/2) bits and
    looks under those within ceil(tau/2) bits: what is filed under a value is within tau bits of all that looks there."""
    flips = np.array([sum(1 << b for b in c) for k in range((tau + 1) // 2 + 1) for c in combinations(range(64), k)], np.uint64)
    filed = np.bitwise_count(flips) <= tau // 2
    schema = pa.schema([("value", pa.int64()), ("fp", pa.int64()), ("filed", pa.bool_())])

    def kernel(batches):
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            for lo in range(0, len(x), 64):
                part = x[lo : lo + 64]
                yield batch(schema, [(part[:, None] ^ flips).ravel().view(np.int64), np.repeat(part, len(flips)).view(np.int64), np.tile(filed, len(part))])

    met = prints.mapInArrow(kernel, "value long, fp long, filed boolean")
    centres = met.where("filed").groupBy("value").agg(F.min("fp").alias("a"))
    return met.join(centres, "value").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, words_in_shingle: int = 3, row_col: str | None = None) -> DataFrame:
    """(id_col, row, fp, fingerprint, component_id, first): component_id is the smallest id that links reach, first marks one row of each component."""
    prints = written(fingerprints(docs, id_col, text_col, words_in_shingle, row_col=row_col), "prints")
    classes = written(prints.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), "row")).alias("head")), "classes")
    roots = components(links(classes.select("fp"), tau))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    heads = written(rooted.groupBy("root").agg(F.min("head").alias("least")), "least")  # stored, so that a frequent root can be split
    named = rooted.join(heads, "root").select("fp", "least")
    return prints.join(named, "fp").select(id_col, "row", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """The rows of docs that are the first of their component: the smallest id, and of repeated rows one."""
    row = own_name(docs, "_r")
    stored = numbered(docs, row, "documents")
    found = near_duplicates(stored, id_col, text_col, tau, words_in_shingle, row).where("first").select(F.col("row").alias(row))
    return stored.join(found, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
