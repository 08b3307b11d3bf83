"""Near copies: components of documents whose sets of word shingles have a Jaccard similarity of at least a given value.

1. Each text becomes its set of shingles (64-bit hashes). Rows with equal sets are one class.
2. SimHash fingerprints of the shingles of a class, linked at FAR or fewer differing bits by the generalised pigeonhole principle (simhash.py):
   the classes of a component are candidates. Near copies whose fingerprints are further apart are found beside it by
   MinHash values of a class in BANDS bands of ROWS: two classes that agree in a band are candidates. At similarity 0.8 a pair misses all
   bands with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8.
3. The texts of the classes of a component or band key meet in one task. There a breadth-first search by exact similarity gives a spanning forest, so
   that a large group of near copies never is all its pairs.
4. Of a key with over GROUP classes one class is the pivot, and each other one is compared with it where it is. What is near the pivot
   is joined to it; the rest, usually little, meets all classes of the key in blocks of at most GROUP on either side.

Nulls and empty texts have no shingles and are copies of each other. Up to `words` words are a single shingle. Words are split and
lower-cased as for SimHash. Texts of any length are compared whole. Ties: the smallest id of a component stands for it, and of repeated
rows one. An empty table gives an empty one; extra columns are left alone, whatever their names. The texts are stored once with a number
for each row, and all later steps read that table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm import simhash
from arbordiff.llm.common import batch, map_arrow, numbered, own_name, pack, ranges, unpack, unpacked, written
from arbordiff.llm.components import components
from arbordiff.llm.repeats import _mix

BANDS, ROWS = 32, 4
#: Differing bits at which two fingerprints are linked.
FAR = 3
#: Classes of a key that meet in one task.
GROUP = 1_000
_random = np.random.default_rng(17)
_FLIP = _random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 1 << 63, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Distinct hashes of the strings of `words` words, in order of size."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    k = min(words, len(found))
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(found) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = _mix(total + each[i : i + n])
    return np.unique(total)


def simhash_of(sets: np.ndarray) -> int:
    """The fingerprint of a set of shingles: a bit is 1 if set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(sets), 1 << 16):
        total += np.unpackbits(sets[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(sets), bitorder="little").view("<u8")[0])


def band_keys(sets: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(sets):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(sets), 1 << 11):
        least = np.minimum(least, ((sets[i : i + (1 << 11), None] ^ _FLIP) * _TIMES).min(0))
    return _mix((_mix(least.reshape(BANDS, ROWS)) * _BAND).sum(1, dtype=np.uint64)).view(np.int64)


def simhash_members(classes: DataFrame) -> DataFrame:
    """classes: (cls, row, fp). (cls, row, key): the key of each class that has others in the component of its fingerprint."""
    roots = components(simhash.links(classes.select("fp").distinct(), FAR)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots.hint("merge"), "fp", "left").select("cls", "row", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))
    rooted = written(rooted, "simhash")
    several = rooted.groupBy("key").count().where("count > 1").select("key")
    return rooted.join(several, "key", "left_semi")


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (of positions) with at least this similarity that join all that such links join: breadth first, from each to all not yet met."""
    sizes = np.array([len(s) for s in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    own = np.zeros(numbers.max() + 1, bool)
    left, out = np.arange(len(sets)), []
    held, begin = numbers, starts  # the sets of what is left
    while len(left):
        queue, left = [int(left[0])], left[1:]
        held, begin = held[begin[1] if len(begin) > 1 else len(held) :], begin[1:] - (begin[1] if len(begin) > 1 else 0)
        while queue and len(left):
            at = queue.pop()
            mine = numbers[starts[at] : starts[at] + sizes[at]]
            own[mine] = True
            both = np.add.reduceat(own[held], begin, dtype=np.int64)
            own[mine] = False
            near = both >= similarity * (sizes[at] + sizes[left] - both) - 1e-9
            if near.any():
                out.extend((at, x) for x in left[near].tolist())
                queue.extend(left[near].tolist())
                left = left[~near]
                held = numbers[ranges(starts[left], sizes[left])]
                begin = np.cumsum(sizes[left]) - sizes[left]
    return out


def links(sets: DataFrame, similarity: float, words: int) -> DataFrame:
    """sets: (key, cls, packed text). (a, b): links that join all classes that similar pairs under a key join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(ids, packed):
        joined = forest([shingles(t, words) for t in unpack(pa.array(packed, pa.binary()))], similarity) if len(ids) > 1 else []
        return batch(schema, [[ids[a] for a, _ in joined], [ids[b] for _, b in joined]])

    def kernel(batches):
        last, ids, found = None, [], []
        for b in batches:
            for key, cls, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key != last and ids:
                    yield solve(ids, found)
                    ids, found = [], []
                last = key
                ids.append(cls)
                found.append(s)
        if ids:
            yield solve(ids, found)

    return map_arrow(sets.select("key", "cls", "packed").repartition("key").sortWithinPartitions("key"), kernel, "a long, b long")


def links_of_large(sets: DataFrame, similarity: float, words: int) -> DataFrame:
    """The same for keys of any number of classes, with at most 2 * GROUP texts in one task at a time."""
    pivots = written(sets.groupBy("key").agg(F.min(F.struct("cls", "packed")).alias("p")).select("key", F.col("p.cls").alias("pivot"), F.col("p.packed").alias("text")), "pivots")

    def judge(batches):
        pivot, own = None, None
        for b in batches:
            near = []
            for p, text, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if p != pivot:
                    pivot, own = p, shingles(unpack(pa.array([text], pa.binary()))[0], words)
                other = shingles(unpack(pa.array([packed], pa.binary()))[0], words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                near.append(both >= similarity * (len(own) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(near, pa.bool_())], ["key", "pivot", "cls", "packed", "near"])

    judged = sets.select("key", "cls", "packed").join(pivots, "key").select("key", "pivot", "text", "cls", "packed")
    judged = written(map_arrow(judged, judge, "key long, pivot long, cls long, packed binary, near boolean"), "judged")
    star = judged.where("near and cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    counts = judged.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("rest")).where("rest > 0")
    counts = written(counts.select("key", *[F.ceil(F.col(c) / GROUP).cast("int").alias(f"{c}_blocks") for c in ("n", "rest")]), "blocks")
    dealt = judged.join(counts, "key")

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        rows = rows.withColumn(own, F.pmod(F.xxhash64("cls"), F.col(f"{own}_blocks"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return rows.select(F.xxhash64("key", F.col("n").cast("int"), F.col("rest").cast("int")).alias("key"), "cls", "packed")

    blocks = side(dealt, "n", "rest").unionByName(side(dealt.where("not near"), "rest", "n"))
    return star.unionByName(links(blocks, similarity, words))


def _classes(stored: DataFrame, similarity: float, words: int, id_col: str, text_col: str, row: str) -> tuple[DataFrame, DataFrame]:
    """stored: numbered rows with packed texts. (id, row, cls) for every row, and (cls, own, least struct<n, id, row>) for every class: its
    own first row and that of its component."""
    kind = dict(stored.dtypes)[id_col]
    rows = stored.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("packed"))

    def sketch(batches):
        for b in batches:
            sets = [shingles(t, words) for t in unpack(b.column(2))]
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = np.array([simhash_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(prints)], ["id", "row", "cls", "keys", "fp"])

    sketches = written(map_arrow(rows, sketch, f"id {kind}, row long, cls long, keys array<long>, fp long"), "sketches")
    heads = sketches.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row", "keys", "fp")).alias("head"))
    classes = written(heads, "classes")
    printed = classes.where(F.size("head.keys") > 0).select("cls", F.col("head.row").alias("row"), F.col("head.fp").alias("fp"))
    members = classes.select("cls", F.col("head.row").alias("row"), F.explode("head.keys").alias("key")).unionByName(written(simhash_members(printed), "linked"))
    # Keys with the same classes are the same work: one of them stands for all.
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "cls")).alias("y"))
    often = written(groups.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "often")

    def sets(keys: DataFrame) -> DataFrame:
        asked = members.join(keys, "key", "left_semi").groupBy("cls", "row").agg(F.collect_list("key").alias("asked"))
        return rows.join(asked, "row").select(F.explode("asked").alias("key"), "cls", "packed")

    found = links(sets(often.where(F.col("n") <= GROUP)), similarity, words)
    large = often.where(F.col("n") > GROUP)
    if not large.isEmpty():
        found = found.unionByName(links_of_large(written(sets(large), "large"), similarity, words))
    roots = components(found)
    least = F.struct("head.n", "head.id", "head.row")
    rooted = classes.join(roots, classes.cls == roots.node, "left").select("cls", least.alias("head"), F.coalesce("root", "cls").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.join(written(rooted.groupBy("root").agg(F.min("head").alias("least")), "least"), "root").select("cls", F.col("head.row").alias("own"), "least")
    return sketches.select("id", "row", "cls"), named


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id, first) for every row: component_id is the smallest id of the component, first marks one row of it."""
    rows, named = _classes(numbered(pack(docs.select(id_col, text_col), text_col), "_r", "texts"), similarity, words, id_col, text_col, "_r")
    return rows.join(named, "cls").select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("first"))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component: the smallest id, and of repeated rows one."""
    row = own_name(docs, "_r")
    stored = numbered(pack(docs, text_col), row, "texts")
    _, named = _classes(stored, similarity, words, id_col, text_col, row)
    return unpacked(stored.join(named.where("own = least.row").select(F.col("own").alias(row)), row, "left_semi").drop(row), text_col, docs)
