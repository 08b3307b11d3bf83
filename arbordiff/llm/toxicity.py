"""Toxicity by weak supervision.

Voters: lexicon words, patterns (how a word begins) and style patterns; which words and beginnings vote is read off a bounded sample of
labelled rows: all that lean to label 1 beyond chance, however many they are. A generative label model takes every document's votes as drawn given its hidden class: expectation maximisation
estimates how accurate each voter is, the remaining correlation of voters given the class is measured, and voters that go together
share one vote. A linear classifier is then trained on the posteriors of the label model.

Empty and null texts get no votes; their score is that of a text without votes. Without a labelled row of both classes every score is
the share of label 1 (0 without any label). Texts are read whole, however long. An empty table gives an empty one, repeated rows repeat,
a tie of voters goes to the longer string; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arbordiff.llm.common import Shared, fold_of, map_arrow
from arbordiff.llm.labelled import SAMPLE_ROWS, Sample, training_sample

#: Lengths of word beginnings that may vote, and the chance below which a word's lean is no accident.
BEGINNINGS, CHANCE = (3, 4, 5, 6, 7, 8), 1e-6


def _log_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Upper bound of the log probability of k or more of n at rate p (Chernoff)."""
    q = np.clip(k / n, 1e-12, 1 - 1e-12)
    return np.where(q > p, -n * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))), 0.0)


def words_of(text: str) -> set[str]:
    """Runs of letters and digits of the lower-cased text."""
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


def mine_voters(sample: Sample) -> list[tuple[str, bool]]:
    """(string, whole word?) of the lexical voters: words and beginnings that lean to label 1 beyond chance. Of several nested ones the
    one that leans most clearly stands for all, at a tie the longest."""

    def keys_of(text: str) -> set[tuple[str, bool]]:
        words = words_of(text)
        out = {(w, True) for w in words if len(w) > 2}
        out.update((w[:n], False) for w in words for n in BEGINNINGS if len(w) > n)
        return out

    # only what some rows of label 1 have is counted among the others, so that memory follows the rows of label 1
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text in sample.texts(np.flatnonzero(sample.label == 1)):
        seen[1].update(keys_of(text))
    for k in [k for k, n in seen[1].items() if n < 3]:
        del seen[1][k]
    for text in sample.texts(np.flatnonzero(sample.label != 1)):
        seen[0].update(k for k in keys_of(text) if k in seen[1])
    base = min(max(float(sample.label.mean()), 1e-3), 1 - 1e-3)
    keys = list(seen[1])
    ones = np.array([seen[1][k] for k in keys], float)
    both = ones + [seen[0][k] for k in keys]
    lean = _log_tail(ones, both, base) if keys else np.zeros(0)
    good = [(lean[i], keys[i]) for i in np.flatnonzero((lean < np.log(CHANCE)) & (ones >= 0.5 * both))]
    kept: list[tuple[str, bool]] = []
    for _, (s, whole) in sorted(good, key=lambda g: (g[0], -len(g[1][0]), g[1])):
        if not any(s.startswith(k) or k.startswith(s) for k, _ in kept):
            kept.append((s, whole))
    return kept


class Votes:
    """How often each voter's pattern is in a text: the lexical voters; all of them together, at least two, at least four; the share of
    exclamation marks; shouting."""

    MORE = 5

    def __init__(self, voters: list[tuple[str, bool]]):
        self.voters = voters
        self.search = ahocorasick.Automaton()
        for i, (s, whole) in enumerate(voters):
            self.search.add_word(s, (*self.search.get(s, ()), (i, whole, len(s))))
        if voters:
            self.search.make_automaton()

    def count(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.voters) + self.MORE)
        low = text.lower()
        if self.voters and low:
            for end, hits in self.search.iter(low):
                for i, whole, n in hits:
                    begin = end - n + 1
                    if (begin == 0 or not low[begin - 1].isalnum()) and (not whole or end + 1 == len(low) or not low[end + 1].isalnum()):
                        out[i] += 1
        total = out.sum()
        out[-self.MORE :] = total, total >= 2, total >= 4, text.count("!") * 50 > len(text), low != text and text.upper() == text
        return out


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, P(vote | class) as (2, voters), and each voter's weight: 1 / (1 + sum of its correlations with
    others given the class). votes: 0 or 1. start: the labels of the training rows, which are the first posteriors and then a voter
    whose accuracy is estimated like any other's."""
    votes = np.column_stack([votes, start.astype(votes.dtype)])
    posterior = np.clip(start.astype(float), 0.02, 0.98)
    weight = np.ones(votes.shape[1])
    rate = np.zeros((2, votes.shape[1]))
    for _ in range(rounds):
        share = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        rate[1] = (posterior @ votes + 0.1) / (posterior.sum() + 1)
        rate[0] = ((1 - posterior) @ votes + 0.01) / ((1 - posterior).sum() + 1)
        both, total = np.zeros((votes.shape[1],) * 2), np.zeros(votes.shape[1])
        for lo in range(0, len(votes), 1024):  # what the class doesn't explain, a part of the rows at a time
            p = posterior[lo : lo + 1024, None]
            rest = votes[lo : lo + 1024] - (p * rate[1] + (1 - p) * rate[0])
            both += rest.T @ rest
            total += rest.sum(0)
        spread = np.sqrt(np.maximum(np.diag(both) / len(votes) - (total / len(votes)) ** 2, 0)) + 1e-9
        related = np.clip(both / len(votes) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(related, 0)
        weight = 1 / (1 + np.where(related > 0.3, related, 0).sum(1))
        weight[-1] = 1.0
        yes, no = weight * np.log(rate[1] / rate[0]), weight * np.log((1 - rate[1]) / (1 - rate[0]))
        odds = votes @ (yes - no) + no.sum()
        posterior = 1 / (1 + np.exp(-np.clip(odds + np.log(share / (1 - share)), -30, 30)))
    return posterior, rate[:, :-1], weight[:-1]


def _linear(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), float(np.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(y.mean(), 1e-3, 1 - 1e-3))))
    step = 4 / (np.square(x).sum(1).max() + 1)
    vw, vb = w.copy(), b
    for k in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ vw.astype(x.dtype) + vb, -30, 30))) - y
        nw, nb = vw - step * (x.T @ g.astype(x.dtype) / len(y) + decay * vw), vb - step * g.mean()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class Model:
    def __init__(self, voters: list[tuple[str, bool]], w: np.ndarray, b: float):
        self.voters, self.w, self.b = voters, w, b

    def scorer(self):
        votes = Votes(self.voters)
        return lambda text: float(1 / (1 + np.exp(-np.clip(np.log1p(votes.count(text)) @ self.w + self.b, -30, 30))))


def fit(sample: Sample) -> Model:
    if len(np.unique(sample.label)) < 2:
        share = float(np.clip(sample.label.mean(), 1e-6, 1 - 1e-6)) if len(sample) else 1e-6
        return Model([], np.zeros(Votes.MORE), float(np.log(share / (1 - share))))
    voters = mine_voters(sample)
    votes = Votes(voters)
    counts = np.stack([votes.count(t).astype(np.float32) for t in sample.texts()])
    posterior, _, _ = label_model((counts > 0).astype(np.float32), sample.label)
    return Model(voters, *_linear(np.log1p(counts, out=counts), posterior))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row."""
    shared = Shared(docs.sparkSession, model)

    def kernel(batches):
        of = shared.made(Model.scorer)
        for b in batches:
            scores = np.array([of(t or "") for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(id_col, (fold_of(id_col) == held_out).alias("held_out"), text_col)
    return map_arrow(rows, kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, fit(training_sample(docs, labels, "toxic", rows=rows)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    shared = Shared(docs.sparkSession, fit(training_sample(docs, labels, "toxic", rows=rows, text_col=text_col)))

    def kernel(batches):
        of = shared.made(Model.scorer)
        for b in batches:
            yield b.filter(pa.array([of(t or "") < threshold for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return map_arrow(docs, kernel, docs.schema)
