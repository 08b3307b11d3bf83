"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all benchmark items form one automaton (bounded blocks of items, one automaton each).
Training words stream through it; at each word the longest match that ends there is known. A match of at least
`window` words holds a whole window of some item, and a shorter item matches as a whole.

Nulls: a null text, in either table, has no words; a null item_id counts as ''. Repeated rows give repeated results;
repeated items are one item for each id; of several items with one passage all are named. Texts are read whole, however
long. An empty table of documents gives an empty one, an empty benchmark hits nothing. Other columns are left alone,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import Shared, map_arrow, own_name, utf8, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of item text in one automaton, which then takes about 230 MB of a worker; a larger benchmark is worked off in blocks of this size.
BLOCK_BYTES = 2 << 20


class Automaton:
    """Suffix automaton of many word sequences. items: (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        coded = [(i, [number.setdefault(w, len(number) + 1) for w in ws]) for i, ws in items if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in coded:
            state = 0
            for w in ws:
                state = self._extend(state, w)
        order = np.argsort(self.length, kind="stable")
        # The state that holds the suffix of exactly `window` words, and the nearest suffix that is a whole short item.
        self.at_window, self.short_link = [-1] * len(self.length), [-1] * len(self.length)
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, tuple[int, set[str]]] = {}
        for i, ws in coded:
            if len(ws) < window:
                state = 0
                for w in ws:
                    state = self.next[state][w]
                self.short_items.setdefault(state, (len(ws), set()))[1].add(i)
        for v in map(int, order[1:]):
            up = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
            self.short_link[v] = v if v in self.short_items else self.short_link[up]
        for i, ws in coded:
            state = 0
            for n, w in enumerate(ws, 1):
                state = self.next[state][w]
                if n >= window:
                    self.window_items.setdefault(self.at_window[state], set()).add(i)
        self.least = min([window, *(n for n, _ in self.short_items.values())])
        # A bit for each pair of neighbouring item words; a wrong bit costs time only.
        self.bits = 22
        self.pairs = np.zeros(1 << self.bits, bool)
        for _, ws in coded:
            a = np.asarray(ws, np.uint64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the sequence that ends in `last`, followed by w."""
        nexts, link, length = self.next, self.link, self.length
        if (q := nexts[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new, p = self._new(length[last] + 1, 0, {}), last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(first word, end, items) of each window that occurs; ids: item words' numbers, 0 for any other word."""
        found: list[tuple[int, int, set[str]]] = []
        if len(ids) < self.least or len(self.length) == 1:
            return found
        known = ids > 0
        if self.least == 1:
            good = known
        else:
            good = known[:-1] & known[1:]
            at = np.flatnonzero(good)
            coded = ids.astype(np.uint64)
            good[at] = self.pairs[self._slot(coded[at], coded[at + 1])]
        edge = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2] + (self.least > 1)
        long = end - begin >= self.least
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            self._walk(ids[b:e].tolist(), b, found)
        return found

    def _walk(self, words: list[int], at: int, found: list) -> None:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for n, w in enumerate(words, at + 1):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                matched += 1
            if matched >= window:
                found.append((n - window, n, self.window_items[self.at_window[state]]))
            s = self.short_link[state]
            while s > 0:
                size, items = self.short_items[s]
                if size <= matched:
                    found.append((n - size, n, items))
                s = self.short_link[link[s]]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most BLOCK_BYTES (or one item)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null")
    block, size, given = [], 0, False
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > BLOCK_BYTES:
            yield block
            block, size, given = [], 0, True
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    if block or not given:
        yield block


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


class _Block:
    """Looks for the items of one block."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.automaton = Automaton([(i, WORD.findall(t.lower())) for i, t in items], window)
        self.get = self.automaton.vocabulary.get

    def find(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        return self.automaton.scan(np.fromiter(map(self.get, words, repeat(0)), np.int64, len(words)))


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, spans (first word and end of each maximal hit run), longest (words in the
    longest run), items (sorted), items_sha256, contaminated. No shuffle. Of a benchmark of several blocks each goes over the texts in
    turn, and what is found so far is stored with them in between, so that one automaton is in memory at a time."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    found_schema = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"

    def kernel_of(shared: Shared, last: bool):
        def kernel(batches):
            block = shared.made(lambda items: _Block(items, window))
            for b in batches:
                counts, spans, items = [], [], []
                for text, old, met in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = WORD.findall(text.lower())
                    found = block.find(words)
                    counts.append(len(words))
                    spans.append([{"first": f, "end": e} for f, e in _union([*((x["first"], x["end"]) for x in old), *((f, e) for f, e, _ in found)])])
                    items.append(sorted(set(met).union(*(i for _, _, i in found))))
                results = [pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                if last:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *results], ["id", "n_words", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *results], ["id", "text", "spans", "items"])

        return kernel

    before = None
    for items, last in _with_last(_blocks(benchmark)):
        shared = Shared(docs.sparkSession, items)
        if not last:
            before = rows = written(map_arrow(rows, kernel_of(shared, False), rows.schema), "matched", instead_of=before)
            shared.broadcast.unpersist()
    found = map_arrow(rows, kernel_of(shared, True), f"id {kind}, {found_schema}")
    size = F.transform("spans", lambda s: s["end"] - s["first"])
    return found.select(
        F.col("id").alias(id_col), "n_words", F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        "spans", "items", F.coalesce(F.array_max(size), F.lit(0).cast("long")).alias("longest"),
    )


def _with_last(xs: Iterator) -> Iterator[tuple]:
    """Each of xs, and whether it is the last."""
    held = next(xs)
    for x in xs:
        yield held, False
        held = x
    yield held, True


def _union(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for f, e in sorted(spans):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([f, e])
    return out


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the spans of words and what stands within them."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    left, kept = 0, []
    for f, e in spans:
        kept.append(text[left : places[f][0]])
        left = places[e - 1][1]
    return b" ".join([*kept, text[left:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs without benchmark passages: every hit span goes from the text (words and what stands between them), and again, until no window
    is left in what remains; a document of which more than max_coverage of the words are hit, over all rounds, goes altogether. Other
    rows and columns stay as they are; size_col, where there is one, follows the text. A benchmark of several blocks gives the same: in
    each round all blocks are looked for before anything goes, over texts that are stored between blocks."""
    blocks = _blocks(benchmark)
    first, one = next(_with_last(blocks))
    if one:
        shared = Shared(docs.sparkSession, first)
        return map_arrow(docs, _cleaner(text_col, size_col, max_coverage, lambda: shared.made(lambda items: _Block(items, window)).find), docs.schema)
    return _by_blocks(docs, benchmark, window, max_coverage, text_col, size_col)


def _cleaner(text_col: str, size_col: str, max_coverage: float, finder):
    """The kernel for a benchmark of one block."""

    def kernel(batches):
        find = finder()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            keep, texts = [], []
            for i, before in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
                text, total, hit = before, 0, 0
                while text and (found := find(words := WORD.findall(text.lower()))):
                    total = total or len(words)
                    spans = _union((f, e) for f, e, _ in found)
                    hit += sum(e - f for f, e in spans)
                    if hit > max_coverage * total:
                        break
                    text = _without(text, spans)
                if hit <= max_coverage * total:
                    keep.append(i)
                    texts.append((text, before is not text))
            if keep:
                yield _changed(b.take(pa.array(keep, pa.int64())), [t for t, _ in texts], [x for _, x in texts], text_col, size_col)

    return kernel


def _changed(b: pa.RecordBatch, texts: list[bytes | None], changed: list[bool], text_col: str, size_col: str) -> pa.RecordBatch:
    """b with the texts that have changed, and their sizes."""
    if not any(changed):
        return b
    at = b.schema.get_field_index(text_col)
    b = b.set_column(at, b.schema.field(at), pa.array(texts, pa.binary()).cast(b.schema.field(at).type))
    if (n := b.schema.get_field_index(size_col)) >= 0:
        sizes = [len(t.decode()) if x else s for t, x, s in zip(texts, changed, b.column(n).to_pylist(), strict=True)]
        b = b.set_column(n, b.schema.field(n), pa.array(sizes, b.schema.field(n).type))
    return b


def _by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, max_coverage: float, text_col: str, size_col: str) -> DataFrame:
    """Rounds over all blocks. With each row goes a state: words of the whole text, words hit so far, the spans of this round."""
    name = own_name(docs, "_state")
    state = pa.struct([("total", pa.int64()), ("hit", pa.int64()), ("spans", _SPANS)])
    fresh = F.struct(F.lit(-1).cast("long").alias("total"), F.lit(0).cast("long").alias("hit"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"))
    rows = table = written(docs.withColumn(name, fresh), "rounds")

    def states(b):
        return b.schema.get_field_index(name), b.column(b.schema.get_field_index(name)).to_pylist()

    def look_of(shared: Shared, first: bool):
        def kernel(batches):
            block = shared.made(lambda items: _Block(items, window))
            for b in batches:
                n, own = states(b)
                for text, x in zip(utf8(b.column(b.schema.get_field_index(text_col))), own, strict=True):
                    if text and (first or x["hit"]):  # texts in which the first round found nothing are done
                        words = WORD.findall(text.lower())
                        x["total"] = len(words) if x["total"] < 0 else x["total"]
                        x["spans"] = [{"first": f, "end": e} for f, e in _union([*((s["first"], s["end"]) for s in x["spans"]), *((f, e) for f, e, _ in block.find(words))])]
                yield b.set_column(n, name, pa.array(own, state))

        return kernel

    def cut(batches):
        for b in batches:
            at, (n, own) = b.schema.get_field_index(text_col), states(b)
            keep, texts, changed, left = [], [], [], []
            for i, (text, x) in enumerate(zip(b.column(at).cast(pa.binary()).to_pylist(), own, strict=True)):
                spans = [[s["first"], s["end"]] for s in x["spans"]]
                hit = x["hit"] + sum(e - f for f, e in spans)
                if hit <= max_coverage * max(0, x["total"]):
                    keep.append(i)
                    texts.append(_without(text, spans) if spans else text)
                    changed.append(bool(spans))
                    left.append({"total": max(0, x["total"]), "hit": hit, "spans": []})
            if keep:
                b = b.take(pa.array(keep, pa.int64()))
                yield _changed(b.set_column(n, name, pa.array(left, state)), texts, changed, text_col, size_col)

    first = True
    while True:
        for items in _blocks(benchmark):
            shared = Shared(docs.sparkSession, items)
            table = rows = written(map_arrow(rows, look_of(shared, first), rows.schema), "rounds", instead_of=table)
            shared.broadcast.unpersist()
        first = False
        if rows.where(F.size(f"{name}.spans") > 0).isEmpty():
            return rows.drop(name)
        table = rows = written(map_arrow(rows, cut, rows.schema), "rounds", instead_of=table)
