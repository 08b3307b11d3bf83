"""Alignment of the tokens of two tokenizers by a transducer over dangling suffixes.

Both tokenizers cut the same bytes. The transducer's state is which side leads and the bytes by which it leads; it reads the next token
of the other side, and where nothing is left over a group of tokens that cover the same bytes ends. Transitions are remembered by state
and token. Each token that is read while a side leads overlaps the leading token: that is a link. How many documents hold an id pair
linked is counted over the whole corpus, and each document's links are weighed by these counts.

Side A is a byte-level BPE of the `tokenizers` library, side B a `sentencepiece` model with byte fallback that puts a space first; a text
gets that space on side A, too. A space or newline between two other characters ends a token on both sides (checked when the models are
read), so that texts fall into chunks; a chunk is tokenized and aligned once and remembered.

Null and empty texts, and texts whose tokens on a side don't spell the text (as U+2581 doesn't on side B), have no tokens: zeros and an
empty digest. Strings of special tokens are plain text. Repeated rows are documents of their own and count as often; of equal counts all
are best; a null id is kept. Texts are read whole, PORTION characters at a time; an empty table gives an empty one, other columns are
left alone, whatever their names.

At scale: documents are gathered in blocks of bounded size, each with one dictionary of its id pairs. Only dictionaries are exploded,
summed and joined with the counts; a block's documents then meet their dictionary. The most frequent pair is once in each dictionary."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import Shared, map_arrow, ranges, written

#: Chunks that a worker remembers at most and their characters, the longest chunk remembered, transitions remembered, and characters of a
#: portion of a text.
REMEMBERED, REMEMBERED_CHARACTERS, LONGEST, TRANSITIONS, PORTION = 400_000, 8_000_000, 64, 1_000_000, 1 << 20
#: Documents and distinct links of a block at most (a document is never cut).
BLOCK_ROWS, BLOCK_LINKS = 2_048, 500_000
#: Before a space or newline between two other characters. str.isspace() holds for all that either tokenizer takes for white space.
CHUNKS = re.compile(r"(?<=\S)(?=[ \n]\S)")
WIDE = re.compile(r"\s\s")
#: The characters that byte-level vocabularies write as they are.
PLAIN = (*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: PLAIN as they are, the others as U+0100 and on."""
    others = [b for b in range(256) if b not in PLAIN]
    return {chr(b): b for b in PLAIN} | {chr(0x100 + i): b for i, b in enumerate(others)}


class SideA:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has as many workers as cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(file)
        self.model.encode_special_tokens = True
        byte = byte_of_character()
        ids = self.model.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that have their first space."""
        return [x.ids for x in self.model.encode_batch(texts, add_special_tokens=False)]


class SideB:
    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") or " " in p or "\n" in p for p in pieces):
            raise ValueError("a piece has a space or newline after another character")
        self.space = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that have their first space, or begin with a newline in the middle of a text."""
        return [ids[1:] if t[0] == "\n" and ids[:1] == [self.space] else ids for t, ids in zip(texts, self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1), strict=True)]


class Transducer:
    """States: 0 (nothing left over), n > 0 if A leads, and -n if B does, by the bytes of number n."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.a_text, self.b_text = ([str(i) for i in range(len(side))] for side in (a, b))
        self._forget()

    def _forget(self) -> None:
        self.number, self.left, self.size = {}, [b""], 0
        self.moves: dict[int, dict[int, int]] = {0: {}}  # state -> token -> state

    def _state(self, a_leads: bool, left: bytes) -> int:
        if not left:
            return 0
        if (n := self.number.setdefault(left, len(self.left))) == len(self.left):
            self.left.append(left)
            self.moves[n], self.moves[-n] = {}, {}
        return n if a_leads else -n

    def _move(self, state: int, token: int) -> int:
        """Where the state goes with the next token of the side that doesn't lead, or of A if none does."""
        left, self.size = self.left[abs(state)], self.size + 1
        read = (self.b if state > 0 else self.a)[token]
        if left.startswith(read):
            return self._state(state > 0, left[len(read) :])
        if not read.startswith(left):
            raise ValueError("the sides differ")
        return self._state(state <= 0, read[len(left) :])

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[str]]:
        """(links as a << 32 | b, groups as 'a1,a2|b1'). ValueError or IndexError if the tokens don't spell the same bytes."""
        if self.size > TRANSITIONS:
            self._forget()
        moves, a_text, b_text, links, groups, i, j = self.moves, self.a_text, self.b_text, [], [], 0, 0
        while i < len(a):
            from_a, from_b, state = i, j, 0
            while True:  # one group
                if state > 0:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                    high = token << 32
                if state:
                    links.append(high | b[j - 1])
                row = moves[state]
                if (after := row.get(token)) is None:
                    after = row[token] = self._move(state, token)
                if not (state := after):
                    break
            left = a_text[a[from_a]] if i - from_a == 1 else ",".join([a_text[x] for x in a[from_a:i]])
            right = b_text[b[from_b]] if j - from_b == 1 else ",".join([b_text[x] for x in b[from_b:j]])
            groups.append(f"{left}|{right}")
        if j < len(b):
            raise ValueError("the sides differ")
        return links, groups


class Aligner:
    """Remembers the alignment of chunks: their numbers of tokens, groups, links, and groups as text."""

    def __init__(self, a_file: str, b_file: bytes):
        self.a, self.b = SideA(a_file), SideB(b_file)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.counts, self.at, self.links, self.texts, self.characters = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [], 0

    def _aligned(self, chunks: list[str]) -> list[tuple | None]:
        """For each chunk with what stands before it: (tokens of A, of B, links, groups), or None if a side doesn't spell it."""
        out: list[tuple | None] = []
        spelled = self.a.bytes
        for chunk, a, b in zip(chunks, self.a.encode(chunks), self.b.encode(chunks), strict=True):
            found = None
            if b"".join([spelled[i] for i in a]) == chunk.encode():
                with contextlib.suppress(ValueError, IndexError):  # the transducer tells whether B spells the same
                    found = len(a), len(b), *self.transducer.align(a, b)
            out.append(found)
        return out

    def _learn(self, new: list[str]) -> None:
        """Chunks that can't be spelled get -1 tokens."""
        found = self._aligned([c if c[0] in " \n" else " " + c for c in new])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.counts = np.concatenate([self.counts, np.array([(-1, 0, 0) if x is None else (x[0], x[1], len(x[3])) for x in found], np.int64).reshape(-1, 3)])
        links = [[] if x is None else x[2] for x in found]
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, links), np.int64, len(links)))])
        self.links = np.concatenate([self.links, np.array([k for ks in links for k in ks], np.int64)])
        self.texts += ["" if x is None else ";".join(x[3]) for x in found]
        self.characters += sum(map(len, new))

    def portion(self, texts: list[str], first: list[bool]) -> list[tuple | None]:
        """For each portion of a text (first: its beginning), (tokens of A, of B, groups, links, groups as text), or None."""
        if len(self.number) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self._forget()
        cut = [_chunks(t, f) for t, f in zip(texts, first, strict=True)]
        found = [np.fromiter(map(self.number.get, cs, repeat(-1)), np.int64, len(cs)) for cs in cut]
        missing = [np.flatnonzero(n < 0).tolist() for n in found]
        long: dict[str, tuple | None] = {}
        if new := list(dict.fromkeys(cs[k] for cs, ks in zip(cut, missing, strict=True) for k in ks)):
            # what is long is aligned where it is and not remembered
            long = dict.fromkeys(c for c in new if len(c) > LONGEST)
            if long:
                long = dict(zip(long, self._aligned([c if c[0] in " \n" else " " + c for c in long]), strict=True))
            self._learn([c for c in new if c not in long])
            for n, cs, ks in zip(found, cut, missing, strict=True):
                n[ks] = [self.number.get(cs[k], -1) for k in ks]
        out: list[tuple | None] = []
        for cs, numbers in zip(cut, found, strict=True):
            known = numbers[numbers >= 0]
            counts = self.counts[known]
            rest = [long[c] for c in cs if c in long] if long and len(known) < len(cs) else []
            if (counts[:, 0] < 0).any() or None in rest:
                out.append(None)
                continue
            links = self.links[ranges(self.at[known], self.at[known + 1] - self.at[known])]
            sums = counts.sum(0).tolist()
            if rest:
                links = np.concatenate([links, *(np.array(x[2], np.int64) for x in rest)])
                sums = [sums[0] + sum(x[0] for x in rest), sums[1] + sum(x[1] for x in rest), sums[2] + sum(len(x[3]) for x in rest)]
                text = ";".join([";".join(long[c][3]) if n < 0 else self.texts[n] for c, n in zip(cs, numbers.tolist(), strict=True)])
            else:
                text = ";".join(map(self.texts.__getitem__, numbers.tolist()))
            out.append((*sums, links, text))
        return out


def _chunks(text: str, first: bool) -> list[str]:
    """The chunks of a portion: as they are if a space stands before them, with the newline if one does. A first chunk that begins with
    white space keeps its own space, so that it isn't taken for one after a newline."""
    if not WIDE.search(text):
        chunks = text.replace("\n", " \n").split(" ")
        if chunks[0] and chunks[-1] not in ("", "\n"):
            return chunks
    chunks = CHUNKS.split(text)
    out = [c[1:] if c[0] == " " else c for c in chunks[1:]]
    return [" " + chunks[0] if first and chunks[0][0].isspace() else chunks[0][1:] if not first and chunks[0][0] == " " else chunks[0], *out]


def _portions(text: str):
    """The text in portions that end where chunks end; all but the first begin with the space or newline before their first chunk."""
    begin = 0
    while begin < len(text):
        m = CHUNKS.search(text, begin + PORTION) if begin + PORTION < len(text) else None
        end = m.end() if m else len(text)
        yield text[begin:end]
        begin = end


class Row:
    """What is known of a text: numbers of tokens and groups, distinct links with how often they occur, digest of the groups."""

    def __init__(self, row: int, with_groups: bool):
        self.row, self.counts, self.digest, self.groups, self.bad, self.some = row, [0, 0, 0], hashlib.sha256(), [] if with_groups else None, False, False
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, found: tuple | None) -> None:
        if found is None:
            self.bad = True
        if self.bad:
            self.links = []
            return
        self.counts = [x + y for x, y in zip(self.counts, found[:3], strict=True)]
        text = (";" if self.some else "") + found[4]
        self.some = True
        self.digest.update(text.encode())
        if self.groups is not None:
            self.groups.append(text)
        self.links.append(np.unique(found[3], return_counts=True))
        if len(self.links) > 16:
            self.links = [self.summed()]

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.links) == 1:
            return self.links[0]
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in self.links]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.links]), len(keys)).astype(np.int64)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with with_groups groups: 'a1,a2|b1;a3|b2,b3') for every
    row. a_path, b_path: files of the two tokenizers, read on the driver (their size is that of a vocabulary)."""
    with open(a_path, encoding="utf8") as f:
        a_file = f.read()
    with open(b_path, "rb") as f:
        b_file = f.read()
    json.loads(a_file)
    shared = Shared(docs.sparkSession, (a_file, b_file))
    kind = dict(docs.dtypes)[id_col]
    extra = ["groups"] * with_groups

    def kernel(batches):
        aligner = shared.made(lambda value: Aligner(*value))
        task, n_block, rows, ids, n_links = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            held, begun = [], []
            texts = b.column(1).to_pylist()
            size = 0
            for i, text in enumerate(texts):
                row = Row(i, with_groups)
                begun.append(row)
                for k, part in enumerate(_portions(text or "")):
                    held.append((row, part, k == 0))
                    size += len(part)
                    if size >= PORTION:
                        _work(aligner, held)
                        held, size = [], 0
            _work(aligner, held)
            done = 0
            for i, row in enumerate(begun):
                rows.append((row, row.summed()))
                row.links = []
                n_links += len(rows[-1][1][0])
                if len(rows) >= BLOCK_ROWS or n_links >= BLOCK_LINKS:
                    ids.append(b.column(0).slice(done, i + 1 - done))
                    yield block(rows, ids, task << 32 | n_block)
                    rows, ids, n_links, n_block, done = [], [], 0, n_block + 1, i + 1
            if done < len(begun):
                ids.append(b.column(0).slice(done))
        if rows:
            yield block(rows, ids, task << 32 | n_block)

    def block(rows: list, ids: list, number: int) -> pa.RecordBatch:
        """The rows of a block, and last its dictionary: a row without an id."""
        sizes = np.array([len(k) for _, (k, _) in rows], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(k for _, (k, _) in rows)])
        times = np.concatenate([np.zeros(0, np.int64), *(n for _, (_, n) in rows)])
        keys, at, held = np.unique(flat, return_inverse=True, return_counts=True)
        n, zeros = len(rows), [[0, 0, 0]]
        counts = np.array([[0, 0, 0] if r.bad else r.counts for r, _ in rows] + zeros, np.int64)
        digests = ["" if r.bad or not r.some else r.digest.hexdigest() for r, _ in rows] + [None]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes), [len(flat)]]), pa.int32())
        dictionary = pa.array([0] * (n + 1) + [len(keys)], pa.int32())
        columns = [pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)]), *(pa.array(counts[:, i]) for i in range(3)), pa.array(counts[:, 0] + counts[:, 1] - counts[:, 2]), pa.array(digests, pa.string())]
        if with_groups:
            columns.append(pa.array(["" if r.bad else "".join(r.groups) for r, _ in rows] + [None], pa.string()))
        columns += [pa.array(np.full(n + 1, number, np.int64)), pa.array([False] * n + [True]), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    pa.ListArray.from_arrays(dictionary, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(dictionary, pa.array(held, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *extra, "block", "is_dictionary", "at", "times", "keys", "held"])

    groups = "groups string, " if with_groups else ""
    fields = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {groups}"
    stored = written(map_arrow(docs.select(id_col, text_col), kernel, fields + "block long, is_dictionary boolean, at array<int>, times array<int>, keys array<long>, held array<long>"), "alignments")
    dictionaries = stored.where("is_dictionary").select("block", F.posexplode(F.arrays_zip("keys", "held")).alias("at", "x")).select("block", "at", F.col("x.keys").alias("key"), F.col("x.held").alias("held"))
    counts = written(dictionaries.groupBy("key").agg(F.sum("held").alias("count")), "pairs")
    best = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("count").alias("best"))  # a row for each id of A at most
    weighed = counts.withColumn("a", F.shiftright("key", 32)).join(F.broadcast(best), "a").select("key", "count", (F.col("count") == F.col("best")).alias("is_best"))
    told = dictionaries.join(weighed, "key").select("block", "at", "count", "is_best")

    def meet(rows: pa.Table, told: pa.Table) -> pa.Table:
        """The rows of a block and the counts of its dictionary."""
        count, is_best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
        place = told.column("at").to_numpy()
        count[place], is_best[place] = told.column("count").to_numpy(), told.column("is_best").to_numpy().astype(np.int64)
        at, times = rows.column("at").combine_chunks(), rows.column("times").combine_chunks()
        sizes = np.diff(at.offsets.to_numpy())
        links, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(rows.num_rows), sizes)

        def summed(of: np.ndarray) -> pa.Array:
            out = np.zeros(rows.num_rows, np.int64)
            np.add.at(out, row, of)
            return pa.array(out)

        kept = {c: rows.column(c) for c in (id_col, "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(kept | {"n_best": summed(times * is_best[links]), "count_sum": summed(times * count[links])} | {c: rows.column(c) for c in ("groups_sha256", *extra)})

    out = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    rows = stored.where("not is_dictionary").drop("keys", "held", "is_dictionary").withColumnRenamed("block", "own_block")
    return rows.groupBy("own_block").cogroup(told.groupBy("block")).applyInArrow(meet, out)


def _work(aligner: Aligner, held: list) -> None:
    if held:
        for (row, _, _), found in zip(held, aligner.portion([t for _, t, _ in held], [f for _, _, f in held]), strict=True):
            row.add(found)
