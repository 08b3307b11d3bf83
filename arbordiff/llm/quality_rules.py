"""Quality rules as weak supervision.

Each rule looks at one measure of the whole text and votes good or bad, or abstains between its two bounds. Documents are counted by
their pattern of votes (at most 3 ** rules patterns, however many documents). Expectation maximisation over all patterns estimates, without labels,
how often each rule is right when it votes on a good and on a bad document; rules are never taken for worse than chance, so that the
classes can't swap. The posterior probability that a document is good then decides, instead of all rules having to pass.

Null and empty texts have no words: measures are zero, the rules that need words abstain and `base_failed` is true. Texts are read whole,
PORTION bytes at a time in one column of numbers. Repeated rows count as often; a posterior of exactly the threshold is kept; without any vote
the posterior is the prior; null ids stay. An empty table gives an empty one, other columns are left alone, whatever their names."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import map_arrow, utf8, written

#: Words of a window of which repetitions count, and words whose windows are looked at together (a text is never cut).
WINDOW, PORTION = 5, 1 << 18
#: Characters that count as symbols, and as the end of a sentence.
SYMBOLS, STOPS, WHITE = b"#*$%&|<>", b".!?", b" \t\n\v\f\r"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
CONTINUED = bytes(range(0x80, 0xC0))
MARKS = bytes(b for b in range(33, 127) if b not in UPPER + LOWER + DIGITS)
#: All but letters, digits and white space; ends of sentences to '.' and white space to ' '.
BARE = bytes(b for b in range(128) if b not in WHITE + UPPER + LOWER + DIGITS)
_ENDS = bytes(ord(".") if b in STOPS else ord(" ") if b in WHITE else ord("x") for b in range(256))
#: For each row: words, code points in them, symbols, lines with a word, those equal to an earlier one, words in repeated windows; words
#: without letter or digit, words that end a sentence, words equal to the one before, marks, ASCII capitals and small letters, and bytes that are not white space.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bare_words", "n_stops", "n_echoes", "n_marks", "n_capitals", "n_small", "n_bytes")


@dataclass(frozen=True)
class Rule:
    """A share of two measures: good up to `good`, bad from `bad` on (if bad < good: good from `good` on, bad up to `bad`). Abstains in
    between and where the second measure is less than `least`."""

    name: str
    part: str
    whole: str
    good: float
    bad: float
    least: int = 1

    def vote(self) -> Column:
        """1 good, -1 bad, 0 abstains."""
        share = F.col(self.part) / F.col(self.whole)
        good, bad = (share <= self.good, share >= self.bad) if self.good < self.bad else (share >= self.good, share <= self.bad)
        return F.when(F.col(self.whole) < self.least, 0).when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    Rule("length", "n_words", "one", good=50, bad=9),
    Rule("symbols", "n_symbols", "n_words", good=0.02, bad=0.1),
    Rule("repeated lines", "n_dup_lines", "n_lines", good=0.0, bad=0.3, least=4),
    Rule("repeated words", "n_repeat_words", "n_words", good=0.05, bad=0.2, least=10),
    Rule("echoes", "n_echoes", "n_words", good=0.02, bad=0.2, least=10),
    Rule("bare words", "n_bare_words", "n_words", good=0.02, bad=0.2, least=5),
    Rule("marks", "n_marks", "n_bytes", good=0.06, bad=0.15, least=20),
    Rule("capitals", "n_capitals", "n_letters", good=0.2, bad=0.5, least=20),
    Rule("sentences", "n_stops", "n_words", good=0.25, bad=0.5, least=10),
    Rule("long words", "word_chars", "n_words", good=10.0, bad=16.0, least=5),
    Rule("short words", "word_chars", "n_words", good=3.0, bad=2.0, least=5),
)


def repeated(words: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that its text has more than once. words: numbers, equal for equal words; text: of each word its text.
    Windows whose hash nothing else has are left out; the others are told apart exactly, a word at a time."""
    hit = np.zeros(len(words), bool)
    n = len(words) - window + 1
    if n < 2:
        return hit
    hashes = text[:n].astype(np.uint64)
    for i in range(window):
        hashes = (hashes ^ words[i : n + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice & (text[:n] == text[window - 1 :]))
    rank = text[at].astype(np.int64)
    for i in range(window):
        _, rank, times = np.unique(rank << 32 | words[at + i], return_inverse=True, return_counts=True)
        again = times[rank] > 1
        at, rank = at[again], rank[again]
    for i in range(window):
        hit[at + i] = True
    return hit


def measure(texts: list[bytes]) -> np.ndarray:
    """(texts, MEASURES). Words are runs of other bytes than 09-0D and 20, as bytes.split() has them."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    number = defaultdict(count().__next__)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            rows = np.repeat([i for i, _ in held], [len(w) for _, w in held])
            words = np.concatenate([w for _, w in held])
            echoes = rows[1:][(words[1:] == words[:-1]) & (rows[1:] == rows[:-1])]
            for column, which in (("n_repeat_words", rows[repeated(words, rows)]), ("n_echoes", echoes)):
                out[:, MEASURES.index(column)] += np.bincount(which, minlength=len(texts))
            held.clear()
            number.clear()

    for i, b in enumerate(texts):
        words = b.split()
        if not words:
            continue
        lines = [x for x in b.split(b"\n") if x and not x.isspace()]

        def some(what: bytes, b: bytes = b) -> int:
            return len(b) - len(b.translate(None, what))

        ends = b.translate(_ENDS)
        stops = ends.count(b". ") + ends.endswith(b".")
        bare = len(words) - len(b.translate(None, BARE).split())
        solid = len(b) - some(WHITE)
        out[i] = len(words), solid - some(CONTINUED), some(SYMBOLS), len(lines), len(lines) - len(set(lines)), 0, bare, stops, 0, some(MARKS), some(UPPER), some(LOWER), solid
        held.append((i, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
        size += len(words)
        if size >= PORTION:
            flush()
            size = 0
    flush()
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, MEASURES as longs) for every row."""

    def kernel(batches):
        for b in batches:
            found = measure(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], [id_col, *MEASURES])

    return map_arrow(docs.select(id_col, text_col), kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{m} long" for m in MEASURES))


class Model:
    """prior: log odds of good; good[r], bad[r]: how often rule r is right when it votes on a good, on a bad document."""

    def __init__(self, prior: float, good: np.ndarray, bad: np.ndarray):
        self.prior, self.good, self.bad = prior, good, bad

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds that a vote for good and one for bad add."""
        return np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = self.weights()
        return 1 / (1 + np.exp(-np.clip(self.prior + (votes > 0) @ yes + (votes < 0) @ no, -30, 30)))


def fit(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> Model:
    """Expectation maximisation over patterns of votes, (patterns, rules), and how many documents have each. Begins with all-must-pass."""
    rules = votes.shape[1]
    if not len(votes):
        return Model(0.0, np.full(rules, 0.75), np.full(rules, 0.75))
    yes, no, weight = votes > 0, votes < 0, n.astype(float)
    posterior = np.where(no.any(1), 0.3, np.where(yes.any(1), 0.95, 0.8))
    for _ in range(rounds):
        p, q = weight * posterior, weight * (1 - posterior)
        share = np.clip(p.sum() / weight.sum(), 0.01, 0.99)
        good = np.clip((p @ yes + 3) / (p @ yes + p @ no + 4), 0.001, 0.999)
        bad = np.clip((q @ no + 1) / (q @ yes + q @ no + 4), 0.001, 0.999)
        # a vote may never speak against what it votes for
        bad = np.maximum(bad, 1 - good + 1e-6)
        model = Model(float(np.log(share / (1 - share))), good, bad)
        now = model.posterior(votes)
        if np.abs(now - posterior).max() < 1e-9:
            break
        posterior = now
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, MEASURES, votes array<int>, quality double, base_failed, kept) for every row. base_failed: fewer than 10 words, or over 20 %
    of them in repeated windows; kept: not base_failed and quality, the posterior, at least the threshold."""
    found = measures(docs, id_col, text_col).withColumns({"one": F.lit(1), "n_letters": F.col("n_capitals") + F.col("n_small")})
    found = written(found.withColumn("votes", F.array(*[r.vote().cast("int") for r in rules])).drop("one", "n_letters"), "votes")
    patterns = found.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** rules rows at most
    model = fit(np.array([r.votes for r in patterns], np.int64).reshape(len(patterns), len(rules)), np.array([r.n for r in patterns]))
    yes, no = (F.from_json(F.lit(json.dumps(w.tolist())), "array<double>") for w in model.weights())
    given = F.zip_with(F.zip_with("votes", yes, lambda v, w: F.when(v > 0, w).otherwise(0.0)), F.zip_with("votes", no, lambda v, w: F.when(v < 0, w).otherwise(0.0)), lambda a, b: a + b)
    odds = F.aggregate(given, F.lit(model.prior), lambda a, x: a + x)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumns({"quality": 1 / (1 + F.exp(-odds)), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
