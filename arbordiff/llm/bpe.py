"""Byte-level BPE by rounds over padded matrices.

A text is cut by a pattern. Cuts not seen before go to length buckets; a bucket is a padded matrix with a cut's bytes in each row. In a
round every row merges its leftmost pair of least rank: pair ranks come from a hash table, the merged column is compacted away, and
rows without a pair leave. Cuts longer than the widest bucket are merged with a queue of pairs instead, which gives the same ids in
O(n log n).

A null or empty text has no ids and decodes to no bytes; a null text's ids are empty, not null. Whole texts are encoded, long ones in
portions that end where every pattern of the supported form has to cut. An empty table gives an empty one, repeated rows repeat; other
columns are left alone, whatever their names. Ties of rank can't be: a pair's rank is that of one token; of equal pairs the leftmost goes
first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from arbordiff.llm.common import Shared, map_arrow, ranges

NONE = np.int32(2**31 - 1)
#: Most bytes of a row in each bucket.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)
#: Cuts, and chunks of cuts, that a worker remembers at most, and their characters; cells of a matrix, and characters of a portion of a
#: text.
REMEMBERED, REMEMBERED_CHARACTERS, CELLS, PORTION = 200_000, 3_000_000, 1 << 18, 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order; ranks are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranked = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks have gaps")
    return [ranked[i] for i in range(len(ranked))]


class PairTable:
    """Rank of the token that two tokens give together: open addressing in two arrays."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        pairs = [(rank[t[:k]] << 32 | rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, ranks = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # of those that want a free slot one gets it, the others look at the next
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            self.ranks[slots[free]] = ranks[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NONE where there is none or either is padding (negative)."""
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = a.ravel()[todo].astype(np.int64) << 32 | b.ravel()[todo]
        slots, flat = self._slot(keys), out.reshape(-1)
        while len(todo):
            seen = self.keys[slots]
            hit = seen == keys
            flat[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (seen >= 0)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def one(self, a: int, b: int) -> int:
        slot, key = int(self._slot(np.array([a << 32 | b]))[0]), a << 32 | b
        while self.keys[slot] >= 0:
            if self.keys[slot] == key:
                return int(self.ranks[slot])
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(NONE)


class _Runs:
    """Numbered strings and the ids of each: all ids in one array, with where those of a string begin and how many they are."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.at, self.size, self.ids, self.characters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def add(self, new: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        self.characters += sum(map(len, new))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.at[numbers], self.size[numbers])]

    def full(self) -> bool:
        return len(self.number) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte has no token")
        self.pairs = PairTable(tokens)
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.two_spaces = regex.compile(r"\s\s")
        self.cuts, self.chunks = _Runs(), _Runs()

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """The ids of each text, as a list of runs. Texts are worked off together, PORTION characters at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            begin = 0
            while begin < len(text):
                end = begin + PORTION
                while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):  # white space after anything else starts a cut
                    end += 1
                end = min(end, len(text))
                held.append((i, text[begin:end]))
                size += end - begin
                begin = end
                if size >= PORTION:
                    self._portion(held, out)
                    held, size = [], 0
        self._portion(held, out)
        return out

    def _portion(self, held: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        """A space between two other characters starts a cut, so that a text without neighbouring white space falls into chunks, each
        with the space before it, that can be looked up whole. A text's first chunk has none; it is looked up as ' ' + chunk."""
        if self.cuts.full():
            self.cuts = _Runs()
        if self.chunks.full():
            self.chunks = _Runs()
        spaced, plain = [], []
        for i, text in held:
            if self.two_spaces.search(text):
                plain.append((i, len(out[i]), self.pattern.findall(text)))
            else:
                chunks = text.split(" ")
                chunks[0] = " " + chunks[0]
                spaced.append((i, len(out[i]), chunks))
            out[i].append(np.zeros(0, np.int32))
        numbers = self._numbers(self.cuts, [c for _, _, c in plain], self._learn)
        for (i, k, _), n in zip(plain, numbers, strict=True):
            out[i][k] = self.cuts.gather(n)
        numbers = self._numbers(self.chunks, [c for _, _, c in spaced], self._learn_chunks)
        for (i, k, _), n in zip(spaced, numbers, strict=True):
            out[i][k] = self.chunks.gather(n)

    @staticmethod
    def _numbers(runs: _Runs, lists: list[list[str]], learn) -> list[np.ndarray]:
        """The numbers of the strings in each list; new ones are learned first."""
        found = [np.fromiter(map(runs.number.get, strings, repeat(-1)), np.int64, len(strings)) for strings in lists]
        missing = [np.flatnonzero(n < 0).tolist() for n in found]
        if new := list(dict.fromkeys(strings[j] for strings, js in zip(lists, missing, strict=True) for j in js)):
            learn(new)
            for n, strings, js in zip(found, lists, missing, strict=True):
                n[js] = [runs.number[strings[j]] for j in js]
        return found

    def _learn_chunks(self, new: list[str]) -> None:
        cuts = [self.pattern.findall(c[1:] if c[:1] == " " else " " + c) for c in new]
        [numbers] = self._numbers(self.cuts, [[*chain.from_iterable(cuts)]], self._learn)
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        ends = np.concatenate([[0], np.cumsum(self.cuts.size[numbers])])
        stops = np.cumsum(size)
        self.chunks.add(new, ends[stops] - ends[stops - size], self.cuts.gather(numbers))

    def _learn(self, new: list[str]) -> None:
        cuts = [c.encode() for c in new]
        size, at = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        found, total = [], 0
        ranks = np.fromiter(map(self.rank.get, cuts, repeat(-1)), np.int32, len(cuts))
        length = np.fromiter(map(len, cuts), np.int64, len(cuts))
        bucket = np.searchsorted(BUCKETS, length)

        def put(members: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
            nonlocal total
            size[members], at[members] = sizes, total + np.cumsum(sizes) - sizes
            found.append(ids)
            total += len(ids)

        whole = np.flatnonzero(ranks >= 0)
        put(whole, np.ones(len(whole), np.int64), ranks[whole])
        for k, width in enumerate(BUCKETS):
            members = np.flatnonzero((bucket == k) & (ranks < 0))
            for lo in range(0, len(members), step := max(1, CELLS // width)):
                part = members[lo : lo + step]
                put(part, *self._rounds([cuts[i] for i in part.tolist()], length[part], width))
        for i in np.flatnonzero((bucket == len(BUCKETS)) & (ranks < 0)).tolist():
            put(np.array([i]), np.array([len(ids := self._queue(cuts[i]))]), ids)
        order = ranges(at, size)
        self.cuts.add(new, size, np.concatenate([np.zeros(0, np.int32), *found])[order])

    def _rounds(self, cuts: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each cut has, and the ids one after another."""
        raw = np.frombuffer(b"".join([c.ljust(width, b"\0") for c in cuts]), np.uint8).reshape(len(cuts), width)
        m = np.where(np.arange(width) < length[:, None], self.byte_rank[raw], np.int32(-1))
        r = np.full(m.shape, NONE, np.int32)
        r[:, :-1] = self.pairs.look(m[:, :-1], m[:, 1:])
        rows, result, left = np.arange(len(cuts)), np.full_like(m, -1), length.copy()
        while len(rows):
            n = np.arange(len(rows))
            at = r.argmin(1)
            least = r[n, at]
            if (done := least == NONE).any():
                result[rows[done], : m.shape[1]] = m[done]
                go = ~done
                m, r, rows, at, least, n = m[go], r[go], rows[go], at[go], least[go], n[: int(go.sum())]
                if not len(rows):
                    break
            m[n, at] = least
            left[rows] -= 1
            gone = np.arange(m.shape[1]) != at[:, None] + 1  # the pair's second column goes
            m, r = m[gone].reshape(len(rows), -1), r[gone].reshape(len(rows), -1)
            last = m.shape[1] - 1
            follow = m[n, np.minimum(at + 1, last)]
            r[n, at] = self.pairs.look(least, np.where(at < last, follow, -1))
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self.pairs.look(m[before, at[before] - 1], least[before])
        return left, result[np.arange(width) < left[:, None]]

    def _queue(self, cut: bytes) -> np.ndarray:
        ids = self.byte_rank[np.frombuffer(cut, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pairs.look(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(rank, i, a, b) for i, (rank, a, b) in enumerate(zip(first, ids, ids[1:])) if rank != NONE]
        heapq.heapify(heap)
        cache: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids):
                pair = ids[i], ids[j]
                if (rank := cache.get(pair)) is None:
                    rank = cache[pair] = self.pairs.one(*pair)
                if rank != NONE:
                    heapq.heappush(heap, (rank, i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)


def _runs(batches, encoder: Encoder):
    """(ids of the rows, sizes, values) for a few texts at a time: how many ids each text has, and the ids one after another."""
    for b in batches:
        texts = b.column(1)
        for lo in range(0, len(texts), 64):
            parts = encoder.encode([t or "" for t in texts.slice(lo, 64).to_pylist()])
            size = np.array([sum(map(len, p)) for p in parts], np.int64)
            yield b.column(0).slice(lo, 64), size, np.concatenate([np.zeros(0, np.int32), *(x for p in parts for x in p)])


def _lists(size: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row. vocabulary: path of a rank file, read on the driver (its size is that of the vocabulary)."""
    shared = Shared(docs.sparkSession, (read_ranks(vocabulary), pattern))

    def kernel(batches):
        encoder = shared.made(lambda value: Encoder(*value))
        for rows, size, values in _runs(batches, encoder):
            yield pa.RecordBatch.from_arrays([rows, _lists(size, values)], [id_col, "ids"])

    return map_arrow(docs.select(id_col, text_col), kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids as out_col. Null ids give null, an id outside the vocabulary fails."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    columns = [c for c in encoded.columns if c != out_col]

    def kernel(batches):
        tokens = shared.value
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            out = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in (ids[i].as_py() if not ids[i].is_valid else ids[i].values.to_numpy().tolist() for i in range(len(ids)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*columns, out_col])

    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.select(columns).dtypes)
    return map_arrow(encoded.select(columns), kernel, f"{fields}, `{out_col}` binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, ids if with_ids, n_tokens, ids_sha256, decoded_sha256) for every row. One pass in one worker: texts are encoded, and the
    ids are written out and decoded where they are."""
    shared = Shared(docs.sparkSession, (read_ranks(vocabulary), pattern))
    names = [id_col, *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"]

    def made(value):
        encoder = Encoder(*value)
        return encoder, [b"%d" % i for i in range(len(encoder.tokens))]

    def kernel(batches):
        encoder, decimals = shared.made(made)
        for rows, size, values in _runs(batches, encoder):
            written, decoded, at = [], [], 0
            for n in size.tolist():
                ids = values[at : at + n].tolist()
                at += n
                written.append(hashlib.sha256(b" ".join(map(decimals.__getitem__, ids))).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(encoder.tokens.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([rows, *[_lists(size, values)] * with_ids, pa.array(size), pa.array(written), pa.array(decoded)], names)

    fields = "ids array<int>, " if with_ids else ""
    return map_arrow(docs.select(id_col, text_col), kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {fields}n_tokens long, ids_sha256 string, decoded_sha256 string")
