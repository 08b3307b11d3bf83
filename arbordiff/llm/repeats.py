"""Removal of long repeated strings by interval expansion on a Burrows-Wheeler transform: strings of bytes, of words, or both.

1. Every string of `length` bytes is keyed by the least hash of the `gram`-byte strings within it, so that equal strings have equal keys.
   Neighbouring starts with one key are a run; strings of a key with a single run can't repeat (unless the text around is periodic).
   A string of `words` words is keyed by the least hash of its pieces of half as many words in the same way.
2. Runs with the same bytes (words) are one class. A class of several members repeats as a whole. The text of one member of each class
   is fetched for the keys with several classes.
3. The classes of a key meet in one block (many keys to a block, a very frequent key in many). The block is sorted by prefix doubling,
   transformed, and the intervals of equal strings are extended backwards breadth first: common prefixes come in order of increasing
   length, intervals of one suffix are dropped, and the expansion stops at the least length. What is left are the strings that occur
   more than once. The sort by doubling knows the intervals of half that length already; expansion begins with those, and goes on by
   strings of as many symbols as the sort has numbered (from 224 bytes by 112, 56, 7 and 1), transformed by these. Symbols are bytes,
   or the words of the block.
4. Blocks of a very frequent key exchange digests of their distinct strings, so that repeats across blocks count, too.

Strings never cross rows. A null text is empty. Texts shorter than the least length can't repeat. Repeated rows repeat each other. The
order of rows means nothing, and an empty table gives an empty one; extra columns are left alone, whatever their names. Texts of any
length are worked off whole. The texts are stored once with a number for each row, and all later steps read that table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import batch, map_arrow, numbered, own_name, pack, ranges, unpack, written

#: Bytes of a block, and classes of a key beyond which it is dealt over blocks of that many classes.
BLOCK, HOT = 1_000_000, 500
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes whose hashes are worked out at once.
_STEP = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(_STEP + 4096, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    part = h >> np.uint64(32)
    h = np.bitwise_xor(h, part)
    h *= _M1
    h ^= np.right_shift(h, np.uint64(29), out=part)
    h *= _M2
    h ^= np.right_shift(h, np.uint64(32), out=part)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: of 2, of 4, of 8 and so on, and at last of two such stretches that overlap."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :])


def _periodic(text: bytes, length: int, window: int) -> np.ndarray:
    """For every `hop` bytes whether the text may repeat itself from there at a distance of less than `window`. If a string of `length`
    bytes does, so does a piece at one of these places within it; more places may be marked."""
    hop, piece = length // 4, length // 6
    return np.array([text.find(text[t : t + piece], t + 1, t + window + piece) >= 0 for t in range(0, len(text), hop)], bool)


def runs_of(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Keys, first starts, numbers of starts, digests of the bytes of the runs of a text, and whether the key may recur in the run."""
    window, hop = length - gram + 1, length // 4
    marks = np.concatenate([[0], np.cumsum(_periodic(text, length, window))])
    forth, back = _power_tables()
    out = []
    for at in range(0, len(text) - length + 1, _STEP):  # windows that start in [at, at + _STEP)
        t = np.frombuffer(text, np.uint8)[at : at + _STEP + length - 1].astype(np.uint64)
        sums = np.zeros(len(t) + 1, np.uint64)
        np.cumsum((t + np.uint64(1)) * forth[: len(t)], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * back[: len(t) - gram + 1])
        keys = _sliding_min(grams, length - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        count = np.diff(np.concatenate([first, [len(keys)]]))
        digest = _mix((sums[first + count + length - 1] - sums[first]) * back[first])
        last = first + at + count + length - 2
        recurs = (count > window) | (marks[last // hop + 1] > marks[(first + at) // hop])
        out.append((keys[first], first + at, count, digest, recurs))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_runs(text: bytes, words: int) -> tuple[np.ndarray, ...]:
    """Of the strings of `words` words of a text: keys, first words, numbers of strings and digests of the runs of strings whose least
    piece of half the words is at the same place. What stands between words doesn't count."""
    each = word_hashes(text)
    n, gram = len(each) - words + 1, words // 2 + 1
    powers = [p[: len(each)] for p in _power_tables()]
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64)) if len(powers[0]) < len(each) else ()):
        p = np.full(len(each), base, np.uint64)
        p[0] = 1
        powers[k] = np.multiply.accumulate(p)
    sums = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each * powers[0], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * powers[1][: len(each) - gram + 1])
    least = _sliding_min(grams, words - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.concatenate([first, [n]]))
    if (count > grams[first[:, None] + np.arange(words - gram + 1)].argmin(1) + 1).any():  # the least piece comes again within a run: its places are looked at
        within = np.lib.stride_tricks.sliding_window_view(grams, words - gram + 1)
        place = np.concatenate([within[i : i + _STEP].argmin(1) for i in range(0, n, _STEP)]) + np.arange(n)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        count = np.diff(np.concatenate([first, [n]]))
    digest = _mix((sums[first + count + words - 1] - sums[first]) * powers[1][first])
    return least[first], first, count, digest


def word_hashes(text: bytes) -> np.ndarray:
    found = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def _before(sa: np.ndarray, number: np.ndarray, room: np.ndarray, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform by strings of `hop` symbols: for each row the number of the string before its suffix (0: a separator is in it), and
    the row of the suffix that begins with that string. number: of the string at each place, above 0 and in their order; room: symbols
    before the next separator. Rows of one string keep their order, as many as there are in its stretch of the suffix array."""
    n = len(sa)
    at = sa - hop
    bwt = np.where((at >= 0) & (room[at] >= hop), number[at], 0).astype(np.int32)
    order = np.sort(bwt.astype(np.int64) << 32 | np.arange(n))
    order &= 0xFFFFFFFF
    ordered, own = bwt[order], np.where(room[sa] >= hop, number[sa], 0)
    del at
    # the stretches of strings without a separator, one after another, are the rows in the order of the strings before them
    rows = np.flatnonzero(own)
    lf = np.zeros(n, np.int32)
    lf[order[np.searchsorted(ordered, 1) :]] = rows
    return bwt, lf


def repeated_starts(segments: list[bytes | np.ndarray], length: int, seed: int = 0) -> list[np.ndarray]:
    """For each segment (bytes, or an array of numbers), which of its strings of `length` symbols occur at several places of the segments
    (as booleans). seed: expansion begins with the intervals of this length, rounded down to one that the sort passes through; 0 for half
    of `length`."""
    segments = [np.frombuffer(s, np.uint8) if isinstance(s, bytes) else s for s in segments]
    sizes = np.array([len(s) for s in segments])
    joined = np.concatenate(segments)
    if joined.dtype == np.uint8:
        joined, bits = joined.astype(np.int32) + 1, 9
    else:  # symbols are numbered
        joined = np.unique(joined, return_inverse=True)[1].astype(np.int32) + 1
        bits = max(9, int(joined.max(initial=0)).bit_length())
    ends = np.cumsum(sizes + 1) - 1
    n = len(joined) + len(sizes)
    text = np.zeros(n, np.int32 if bits > 15 else np.int16)
    inner = np.ones(n, bool)
    inner[ends] = False
    text[inner] = joined
    del joined, inner
    # Suffix array sorted by the first `length` symbols at least: as many symbols as 63 bits hold, then doubling. Tables are of 4 bytes
    # where they can be, as a block's memory is a worker's.
    at_once = 63 // bits
    padded = np.concatenate([text, np.zeros(at_once, text.dtype)])
    key = np.zeros(n, np.int64)
    for i in range(at_once):
        key <<= bits
        key |= padded[i : i + n]
    depth, seeded, seed_depth = 0, None, 0
    seed = seed or length // 2 + length // 8
    # How far each round of the expansion goes: as far as rounds of the sort do, at last symbol by symbol.
    longest = at_once
    while 2 * longest <= seed:
        longest *= 2
    hops, left, hop = [], length - longest, longest
    while left > 0:
        hops += [hop] * (left // hop)
        left, hop = left % hop, hop // 2 if hop > at_once else 1
    numbers = {1: text}
    while True:
        sa = np.argsort(key)
        key = key[sa]
        number = np.zeros(n, np.int32)
        np.cumsum(key[1:] != key[:-1], out=number[1:])
        depth = depth * 2 or at_once
        rank = np.empty(n, np.int32)
        rank[sa] = number
        if seeded is None or depth <= seed:
            seeded, seed_depth = rank, depth
        if depth in hops:
            numbers[depth] = rank + 1
        if depth >= min(length, n) or number[-1] == n - 1:
            break
        key = rank.astype(np.int64)
        key <<= 32
        key[: max(0, n - depth)] |= rank[depth:]
    del key, number, rank
    if seed_depth > length:
        raise ValueError("strings are too short for this method")
    # Intervals of the strings of seed_depth symbols without a separator.
    room = np.repeat(ends, sizes + 1) - np.arange(n)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(seeded[sa])) + 1, [n]])
    low, size = edge[:-1], np.diff(edge)
    keep = (size > 1) & (room[sa[low]] >= seed_depth)
    low, size = low[keep], size[keep]
    del seeded, edge
    for hop in hops:
        if not len(low):
            break
        bwt, lf = _before(sa, numbers[hop], room, hop)
        run = np.zeros(n, np.int32)
        np.cumsum(bwt[1:] != bwt[:-1], out=run[1:])
        alike = run[low] == run[low + size - 1]
        low_a, size_a = low[alike], size[alike]
        keep = bwt[low_a] > 0
        parts = [(lf[low_a[keep]], size_a[keep])]
        if not alike.all():  # the symbols before differ: an interval for each of them
            rows = ranges(low[~alike], size[~alike])
            code = np.repeat(np.arange(len(low) - len(low_a)), size[~alike]) << 32 | bwt[rows]
            order = np.argsort(code, kind="stable")
            code, rows = code[order], rows[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
            many = np.diff(np.concatenate([first, [len(code)]]))
            keep = (many > 1) & (code[first] & 0xFFFFFFFF > 0)
            parts.append((lf[rows[first[keep]]], many[keep]))
        low, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = np.zeros(n, bool)
    found[sa[ranges(low, size)]] = True
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [found[s : s + max(0, m - length + 1)] for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _spans(found: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(found.astype(np.int8), prepend=0, append=0))
    return [{"first": f, "count": e - f} for f, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))


def repeated_spans(texts: DataFrame, length: int, gram: int, words: int, row: str, text_col: str) -> DataFrame:
    """texts: a stored table of row numbers and packed texts. (_r, starts, word_starts), both array<struct<first, count>>, of the rows in
    which a string starts that starts elsewhere, too: count such starts from byte (word) `first` on. words: 0 for strings of bytes only."""
    texts = texts.select(F.col(row).alias("row"), F.col(text_col).alias("packed")).where("packed is not null")
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("count", pa.int32()), ("row", pa.int64()), ("first", pa.int64()), ("recurs", pa.bool_())])
    # a key's lowest bit tells its kind: symbols in a string, bytes of a symbol
    kinds = {0: (length, 1), 1: (words, 8)}

    def find_runs(batches):
        for b in batches:
            parts = []
            for number, text in zip(b.column(0).to_pylist(), unpack(b.column(1)), strict=True):
                if len(text) >= length:
                    keys, first, count, digest, recurs = runs_of(text, length, gram)
                    parts.append((keys & ~np.uint64(1), digest, count, number, first, recurs))
                if words and len(text) >= 2 * words - 1 and len(text.split(None, words)) >= words:  # a byte for each word and space
                    keys, first, count, digest = word_runs(text, words)
                    parts.append((keys | np.uint64(1), digest, count, number, first, np.zeros(len(keys), bool)))
            if parts:
                columns = [(k.view(np.int64), d.view(np.int64), c.astype(np.int32), np.full(len(k), r), f, x) for k, d, c, r, f, x in parts]
                yield batch(schema, [np.concatenate(x) for x in zip(*columns, strict=True)])

    runs = written(map_arrow(texts, find_runs, "key long, digest long, count int, row long, first long, recurs boolean"), "runs")
    # What a join by a frequent key asks for is stored first: both sides then are dealt anew, and Spark can split the frequent key.
    often = written(runs.groupBy("key").agg(F.count("*").alias("n"), F.max("recurs").alias("r")).where("n > 1 or r").select("key"), "often")
    members = written(runs.join(often, "key", "left_semi"), "members", instead_of=runs)
    classes = members.groupBy("key", "digest", "count").agg(F.count("*").alias("members"), F.min(F.struct("row", "first")).alias("rep"), F.max("recurs").alias("recurs"))
    classes = written(classes, "classes")
    per_key = classes.groupBy("key").agg(F.count("*").alias("classes"), F.max("recurs").alias("r"))
    mixed = per_key.where("classes > 1 or r").select("key", F.when(F.col("classes") > HOT, F.ceil(F.col("classes") / HOT)).otherwise(1).cast("int").alias("blocks"))
    mixed = written(mixed, "mixed")
    wanted = classes.join(mixed, "key").select("key", "digest", "count", F.col("rep.row").alias("row"), F.col("rep.first").alias("first"), (F.pmod(F.xxhash64("digest"), F.col("blocks"))).cast("int").alias("block"), "blocks")
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "digest", "count", "first", "block", "blocks")).alias("asked"))
    fields = [("key", pa.int64()), ("digest", pa.int64()), ("count", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32())]
    segment_schema = pa.schema([*fields, ("symbols", pa.binary())])

    def cut(batches):
        for b in batches:
            for whole, asks in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                [text] = unpack(pa.array([whole.as_py()], pa.binary()))
                sources = [text, word_hashes(text).tobytes() if any(r["key"] & 1 for r in asks) else b""]
                out = []
                for r in asks:
                    n, width = kinds[r["key"] & 1]
                    out.append(sources[r["key"] & 1][width * r["first"] : width * (r["first"] + r["count"] + n - 1)])
                for lo in range(0, len(asks), 2048):
                    yield batch(segment_schema, [*([r[f] for r in asks[lo : lo + 2048]] for f, _ in fields), out[lo : lo + 2048]])

    segments = map_arrow(texts.join(asked, "row").select("packed", "asked"), cut, "key long, digest long, count int, block int, blocks int, symbols binary")
    dealt = segments.repartition("key", "block").sortWithinPartitions("key", "block")
    result_schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("count", pa.int32()), ("spans", _SPANS), ("strings", pa.list_(pa.binary())), ("at", pa.list_(pa.int32()))])

    def expand(batches):
        held: dict[int, list] = {0: [], 1: []}
        size, last = {0: 0, 1: 0}, None
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                kind = r[0] & 1
                if size[kind] >= BLOCK and (r[0], r[3]) != last:
                    yield solve(held[kind], *kinds[kind])
                    held[kind], size[kind] = [], 0
                held[kind].append(r)
                size[kind] += len(r[5])
                last = r[0], r[3]
        for kind, rows in held.items():
            if rows:
                yield solve(rows, *kinds[kind])

    def solve(rows, n, width):
        found = repeated_starts([r[5] if width == 1 else np.frombuffer(r[5], np.uint64) for r in rows], n)
        strings, at, told = [], [], set()
        for r, f in zip(rows, found, strict=True):
            own, places = [], []
            if r[4] > 1:  # blocks of one key: each distinct string once, and every string that is alone in its block
                for i in range(len(f)):
                    d = hashlib.blake2b(r[5][width * i : width * (i + n)], digest_size=16).digest()
                    if not f[i] or (r[0], d) not in told:
                        told.add((r[0], d))
                        own.append(d)
                        places.append(-1 if f[i] else i)
            strings.append(own)
            at.append(places)
        return batch(result_schema, [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], pa.array([_spans(f) for f in found], _SPANS), pa.array(strings, pa.list_(pa.binary())), pa.array(at, pa.list_(pa.int32()))])

    solved = written(map_arrow(dealt, expand, "key long, digest long, count int, spans array<struct<first:long,count:long>>, strings array<binary>, at array<int>"), "solved")
    told = solved.where(F.size("strings") > 0).select("key", "digest", "count", F.explode(F.arrays_zip("strings", "at")).alias("x")).select("key", "digest", "count", F.col("x.strings").alias("string"), F.col("x.at").alias("at"))
    twice = written(told.groupBy("string").count().where("count > 1").select("string"), "twice")
    across = told.join(twice, "string", "left_semi").where(F.col("at") >= 0)
    spans = solved.select("key", "digest", "count", F.explode("spans").alias("s")).select("key", "digest", "count", "s.first", F.col("s.count").alias("n"))
    spans = spans.unionByName(across.select("key", "digest", "count", F.col("at").cast("long").alias("first"), F.lit(1).cast("long").alias("n")))
    whole = classes.where("members > 1").select("key", "digest", "count", F.lit(0).cast("long").alias("first"), F.col("count").cast("long").alias("n"))
    of_class = spans.join(whole.select("key", "digest", "count"), ["key", "digest", "count"], "left_anti").unionByName(whole)
    of_class = written(of_class.groupBy("key", "digest", "count").agg(F.collect_list(F.struct("first", "n")).alias("spans")), "spans")
    of_row = members.join(of_class, ["key", "digest", "count"]).select("row", (F.col("key") % 2 != 0).alias("w"), F.transform("spans", lambda s: F.struct((F.col("first") + s["first"]).alias("first"), s["n"].alias("count"))).alias("spans"))
    both = [F.flatten(F.collect_list(F.when(F.col("w") == kind, F.col("spans")))).alias(name) for kind, name in ((False, "starts"), (True, "word_starts"))]
    return of_row.groupBy(F.col("row").alias("_r")).agg(*both)


def covered(starts: list[dict] | None, length: int, touching: bool = True) -> list[list[int]]:
    """Maximal runs (begin, end) of what strings at the given starts cover. touching: whether two that only touch are one run; what is
    between two words is in no string if these are in two."""
    return _joined(([s["first"], s["first"] + s["count"] - 1 + length] for s in starts or ()), touching)


def _joined(runs, touching: bool = True) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(runs):
        if out and begin < out[-1][1] + touching:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def in_bytes(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Runs of words as runs of bytes, from the first byte of the first word to the end of the last."""
    if not runs:
        return []
    space = np.isin(np.frombuffer(b" " + text + b" ", np.uint8), np.frombuffer(b"\t\n\v\f\r ", np.uint8))
    edge = np.flatnonzero(space[1:] != space[:-1])
    begins, ends = edge[::2], edge[1::2]
    return [[int(begins[a]), int(ends[b - 1])] for a, b in runs]


def remaining(text: bytes, gone: list[list[int]]) -> bytes:
    left, kept = 0, []
    for begin, end in gone:
        kept.append(text[left:begin])
        left = end
    return b"".join([*kept, text[left:]])


def _with_spans(docs: DataFrame, length: int, gram: int, words: int, text_col: str) -> tuple[DataFrame, str]:
    """docs, packed, with the column of spans (null where there are none), and that column's name. The row numbers are gone again."""
    row = own_name(docs, "_r")
    stored = numbered(pack(docs, text_col), row, "texts")
    spans = repeated_spans(stored, length, gram, words, row, text_col)
    name = own_name(docs, "_spans")
    spans = spans.select(F.col("_r").alias(row), F.struct("starts", "word_starts").alias(name))
    return stored.join(spans, row, "left").drop(row), name


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 200, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept (remaining bytes), removed (begin and end of each run) by the
    repeated strings of `length` bytes; n_repeated_words: words within repeated strings of `words` words (0: not looked for)."""
    rows, name = _with_spans(docs.select(id_col, text_col), length, gram, words, text_col)
    run = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def remove(batches):
        for b in batches:
            sizes, kept, gone, covers = [], [], [], []
            for text, spans in zip(unpack(b.column(1)), b.column(2).to_pylist(), strict=True):
                runs = covered(spans and spans["starts"], length)
                sizes.append(len(text))
                kept.append(remaining(text, runs))
                gone.append([{"begin": x, "end": y} for x, y in runs])
                covers.append(sum(y - x for x, y in covered(spans and spans["word_starts"], words)))
            removed = [sum(g["end"] - g["begin"] for g in x) for x in gone]
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in gone], pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, run), pa.array(covers, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, "n_bytes", "n_removed", "n_spans", "kept", "removed", "n_repeated_words"])

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(rows.select(id_col, text_col, name), remove, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<begin:long,end:long>>, n_repeated_words long")


def drop_repeats(docs: DataFrame, length: int = 400, gram: int = 200, words: int = 0, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with the repeated strings (of `length` bytes, and of `words` words if not 0) taken out of the texts; size_col, where there is
    one, follows the text. A character of which only some bytes go goes wholly. Rows of which no more than blanks are left go; rows
    without repeats stay as they are."""
    rows, name = _with_spans(docs, length, gram, words, text_col)
    text_type = pa.large_string() if docs.sparkSession.conf.get("spark.sql.execution.arrow.useLargeVarTypes", "false") == "true" else pa.string()

    def kernel(batches):
        for b in batches:
            at, spans = b.schema.get_field_index(text_col), b.column(b.schema.get_field_index(name)).to_pylist()
            b = b.drop_columns([name])
            nulls = b.column(at).is_null().to_pylist()
            old = unpack(b.column(at))
            new = [t if s is None else remaining(t, _joined([*covered(s["starts"], length), *in_bytes(t, covered(s["word_starts"], words, touching=False))])).decode("utf8", "ignore").encode() for t, s in zip(old, spans, strict=True)]
            if (n := b.schema.get_field_index(size_col)) >= 0:
                sizes = [x if s is None else len(t.decode()) for x, t, s in zip(b.column(n).to_pylist(), new, spans, strict=True)]
                b = b.set_column(n, b.schema.field(n), pa.array(sizes, b.schema.field(n).type))
            b = b.set_column(at, text_col, pa.array([None if x else t for t, x in zip(new, nulls, strict=True)], pa.binary()).cast(text_type))
            yield b.filter(pa.array([s is None or bool(t.strip()) for t, s in zip(new, spans, strict=True)], pa.bool_()))

    return map_arrow(rows, kernel, docs.schema)
