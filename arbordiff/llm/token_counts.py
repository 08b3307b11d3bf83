"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Where the walk can't go on from a node, the longest matches that the node's string begins with are
popped and the walk stands on the node of what is left: both the number popped and that node are known beforehand (failure links), so
a word of n bytes takes O(n) steps and no piece is ever built.

A word is a run without ASCII white space, with `marker` before it. A word of which some byte can't be matched counts as one unknown
piece. Null and empty texts have no words; words and texts are read whole, however long. Of matches that begin at one place the longest
wins, so there are no ties. An empty table gives an empty one, repeated rows repeat; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from arbordiff.llm.bpe import read_ranks
from arbordiff.llm.common import Shared, map_arrow, utf8

#: Words whose counts a worker remembers.
REMEMBERED = 400_000


class LongestMatch:
    def __init__(self, vocabulary: list[bytes]):
        self.move: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        whole, parents = {0: False}, [(-1, 0)]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                if (key := node << 8 | byte) not in self.move:
                    self.move[key] = len(parents)
                    parents.append((node, byte))
                node = self.move[key]
            if piece:
                whole[node] = True
        depth = [0] * len(parents)
        for v in range(1, len(parents)):
            depth[v] = depth[parents[v][0]] + 1
        self.fail, self.pops = [-1] * len(parents), [0] * len(parents)
        for v in sorted(range(1, len(parents)), key=depth.__getitem__):
            if whole.get(v):
                self.fail[v], self.pops[v] = 0, 1
                continue
            up, byte = parents[v]
            node, popped = self.fail[up], self.pops[up]
            while node >= 0 and (node << 8 | byte) not in self.move:
                popped += self.pops[node]
                node = self.fail[node]
            if node >= 0:
                self.fail[v], self.pops[v] = self.move[node << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of the word, or -1 if it has none."""
        move, fail, pops = self.move, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (to := move.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else -1


class _Counts(dict):
    def __init__(self, automaton: LongestMatch, marker: bytes):
        self.automaton, self.marker = automaton, marker

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.marker + word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def count_pieces(docs: DataFrame, vocabulary: str, marker: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_pieces, n_unknown): pieces include one for each unknown word. vocabulary: path of a rank file."""
    shared = Shared(docs.sparkSession, read_ranks(vocabulary))

    def kernel(batches):
        look = shared.made(lambda tokens: _Counts(LongestMatch(tokens), marker)).__getitem__
        for b in batches:
            words, pieces, unknown = [], [], []
            for text in utf8(b.column(1)):
                counts = [*map(look, split := text.split())]
                lost = counts.count(-1)
                words.append(len(split))
                pieces.append(sum(counts) + 2 * lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, pieces, unknown))], [id_col, "n_words", "n_pieces", "n_unknown"])

    return map_arrow(docs.select(id_col, text_col), kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_pieces long, n_unknown long")
