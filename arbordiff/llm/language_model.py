"""Scoring by a gated recurrent language model with a class-factored output.

Counts of all training tokens give the base score, the vocabulary, the classes and the first biases. Frequent words are in classes of
neighbouring ranks; a word's probability is that of its class times that within the class (two small softmax layers). Other words
belong to classes by their last two bytes; within these, a word has its smoothed share of the training tokens. The recurrent network is
trained by truncated backpropagation on all training rows, in every partition on its own, after which the partitions' weights are averaged.
Texts are looked up once and stored as symbols, which training and scoring read.
They all start from the same weights, which come from FIRST_TOKENS steps of a token on the driver, over training rows in the order of a hash.
Documents are scored in windows; the state is carried from window to window and starts anew with each document, so that a score is the
log-likelihood of the complete document, however long.

The SENT most frequent words go to every worker, whatever their length (long ones as a digest); the counts of all others are joined.
Null and empty texts hold one token, their end. Without training rows N and V are 0 and every token is as likely as any other unseen
one. A null id has the text '' for its fold; ids may be of any type. An empty table gives an empty one, repeated rows repeat, the order
of rows means nothing, words of one count are ranked by their bytes; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import Shared, batch, fold_of, map_arrow, numbered, utf8, written

#: Units of the network, frequent classes, words in each, classes of other words, words whose counts go to every worker, and the length
#: from which these go as digests.
UNITS, CLASSES, IN_CLASS, OTHERS, SENT, LONG = 16, 32, 64, 64, 1 << 17, 64
#: Tokens of training rows for the weights that the partitions start from, and passes over them.
FIRST_TOKENS, FIRST_PASSES = 250_000, 3
#: Weights in one row when they are averaged.
IN_ROW = 1 << 13
#: Steps of a window and documents side by side when scoring and when training.
STEPS, LANES, TRAIN_STEPS, TRAIN_LANES = 32, 192, 24, 48
#: In the partitions: the rate, documents side by side, and tokens that are held for that. The rate goes with how many are side by side.
RATE, WIDE, PORTION = 0.15, 256, 1 << 20
#: Tokens whose output is worked out at once.
ROWS = 512
#: A document's end; words are never empty.
END = b""


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() splits at 09-0D and 20, bytes.lower() maps A-Z only."""
    return [*text.lower().split(), END]


def other_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % OTHERS


def long_key(word: bytes) -> bytes:
    """What stands for a word of more than LONG bytes: no such word, and no other's (SHA-256)."""
    return b"\0" + hashlib.sha256(word).digest()


class Vocabulary:
    """Words by falling count, the end first, as far as they are sent; the first CLASSES * IN_CLASS are frequent."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, other_total: np.ndarray, other_distinct: np.ndarray, classes: np.ndarray | None = None):
        """classes: the other_class of each word, needed where keys stand for words."""
        classes = np.array([other_class(w) for w in words], np.int64) if classes is None else classes
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.frequent = min(len(words), CLASSES * IN_CLASS)
        self.number = dict(zip(words, range(len(words))))
        self.log_count = np.log10(counts + 0.5)
        self.log_total = float(np.log10(total + 0.5 * (distinct + 1)))
        self.log_other = np.log10(other_total + 0.5 * (other_distinct + 1))
        # what a word is to the network: itself if frequent, else its class
        self.symbol = np.concatenate([np.arange(self.frequent), CLASSES * IN_CLASS + classes[self.frequent :]]).astype(np.int64)
        self.other_total, self.other_distinct = other_total, other_distinct

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers (-1: not sent) and symbols of the words, and the words that aren't sent."""
        n = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(n < 0)
        for i in lost.tolist():
            if len(words[i]) > LONG:
                n[i] = self.number.get(long_key(words[i]), -1)
        symbols = self.symbol[n]
        lost = lost[n[lost] < 0]
        unsent = [words[i] for i in lost.tolist()]
        symbols[lost] = [CLASSES * IN_CLASS + other_class(w) for w in unsent]
        return n, symbols, unsent


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    SYMBOLS = CLASSES * IN_CLASS + OTHERS

    def __init__(self, vocabulary: Vocabulary | None = None):
        random = np.random.default_rng(17)
        f = np.float32
        self.p = {
            "input": (random.normal(0, 0.1, (self.SYMBOLS, 3 * UNITS))).astype(f), "state": (random.normal(0, 0.2, (UNITS, 3 * UNITS))).astype(f),
            "class": (random.normal(0, 0.05, (UNITS, CLASSES + OTHERS))).astype(f), "class_bias": np.zeros(CLASSES + OTHERS, f),
            "word": (random.normal(0, 0.05, (CLASSES, UNITS, IN_CLASS))).astype(f), "word_bias": np.full((CLASSES, IN_CLASS), -60, f),
        }
        if vocabulary:
            share = np.zeros(CLASSES * IN_CLASS)
            share[: vocabulary.frequent] = vocabulary.counts[: vocabulary.frequent] + 0.5
            share = share.reshape(CLASSES, IN_CLASS)
            real = share > 0
            self.p["word_bias"][real] = np.log((share / np.maximum(share.sum(1, keepdims=True), 1e-9))[real])
            mass = np.concatenate([share.sum(1), vocabulary.other_total + 0.5])
            self.p["class_bias"][:] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -60)
        self.squares = {k: np.full(x.shape, 1e-3, f) for k, x in self.p.items()}

    def states(self, symbols: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None = None) -> np.ndarray:
        """symbols, keep: (steps, lanes). The state before each step's token is predicted, (steps, lanes, UNITS); h: state so far."""
        p, u, out = self.p, UNITS, np.empty((*symbols.shape, UNITS), np.float32)
        given = p["input"][symbols]
        for t in range(len(symbols)):
            h0 = h * keep[t][:, None]
            hz = h0 @ p["state"]
            rz = _sigmoid(given[t][:, : 2 * u] + hz[:, : 2 * u])
            r, z = rz[:, :u], rz[:, u:]
            n = np.tanh(given[t][:, 2 * u :] + r * hz[:, 2 * u :])
            h = n + z * (h0 - n)
            out[t] = h
            if trace is not None:
                trace.append((h0, hz[:, 2 * u :], r, z, n))
        return out

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of the target symbols (of other words: of their class) after states h. With grads: adds to these,
        and returns the gradient by h as well."""
        p = self.p
        frequent = targets < CLASSES * IN_CLASS
        own = np.where(frequent, targets // IN_CLASS, targets - CLASSES * IN_CLASS + CLASSES)
        logits = h @ p["class"] + p["class_bias"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        rows = np.arange(len(h))
        out = logits[rows, own].astype(np.float64) - np.log(total)
        back = None
        if grads is not None:
            d = e / total[:, None]
            d[rows, own] -= 1
            grads["class"] += h.T @ d
            grads["class_bias"] += d.sum(0)
            back = d @ p["class"].T
        at = np.flatnonzero(frequent)
        at = at[np.argsort(own[at], kind="stable")]
        edges = np.searchsorted(own[at], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            if edges[c] == edges[c + 1]:
                continue
            part = at[edges[c] : edges[c + 1]]
            logits = h[part] @ p["word"][c] + p["word_bias"][c]
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            total = e.sum(1)
            k, rows = targets[part] % IN_CLASS, np.arange(len(part))
            out[part] += logits[rows, k] - np.log(total)
            if grads is not None:
                d = e / total[:, None]
                d[rows, k] -= 1
                grads["word"][c] += h[part].T @ d
                grads["word_bias"][c] += d.sum(0)
                back[part] += d @ p["word"][c].T
        return out, back

    def prepared(self) -> "Scorer":
        return Scorer(self)

    def output_gradients(self, h: np.ndarray, targets: np.ndarray, grads: dict) -> np.ndarray:
        """What log_probabilities() adds to grads and returns with them, without the probabilities: words of a class stand together,
        biases are one more row of the weights, and a softmax is divided by its total within the products, which are smaller."""
        p, u = self.p, UNITS
        x = np.ones((len(h), u + 1), np.float32)
        x[:, :u] = h
        room, ones = np.empty(ROWS * max(IN_CLASS, CLASSES + OTHERS), np.float32), np.ones(max(IN_CLASS, CLASSES + OTHERS), np.float32)
        row = np.arange(ROWS)

        def add(x: np.ndarray, weights: np.ndarray, own: np.ndarray, back: np.ndarray, grad: np.ndarray, grad_bias: np.ndarray) -> None:
            for i in range(0, len(x), ROWS):
                x_, own_ = x[i : i + ROWS], own[i : i + ROWS]
                d = np.matmul(x_, weights, out=room[: len(x_) * weights.shape[1]].reshape(len(x_), -1))
                if not abs(float(d.max())) < 60:  # far from what training gives
                    d -= d.max(1, keepdims=True)
                np.exp(d, out=d)
                total = d @ ones[: d.shape[1]]
                if not (total > 1e-30).all():
                    np.matmul(x_, weights, out=d)
                    d -= d.max(1, keepdims=True)
                    np.exp(d, out=d)
                    total = d @ ones[: d.shape[1]]
                d[row[: len(d)], own_] -= total
                total = (1 / total)[:, None]
                g = (x_ * total).T @ d
                grad += g[:u]
                grad_bias += g[u]
                b = back[i : i + ROWS]
                np.matmul(d, weights[:u].T, out=b)
                b *= total

        frequent = targets < CLASSES * IN_CLASS
        own = np.where(frequent, targets // IN_CLASS, targets - CLASSES * IN_CLASS + CLASSES)
        back = np.empty((len(h), u), np.float32)
        add(x, np.vstack([p["class"], p["class_bias"]]), own, back, grads["class"], grads["class_bias"])
        at = np.flatnonzero(frequent)
        at = at[np.argsort(own[at].astype(np.uint8), kind="stable")]
        edges = np.searchsorted(own[at], np.arange(CLASSES + 1)).tolist()
        x, k, by_word = x[at], targets[at] % IN_CLASS, np.empty((len(at), u), np.float32)
        weights = np.concatenate([p["word"], p["word_bias"][:, None, :]], axis=1)
        for c in range(CLASSES):
            if (i := edges[c]) < (j := edges[c + 1]):
                add(x[i:j], weights[c], k[i:j], by_word[i:j], grads["word"][c], grads["word_bias"][c])
        back[at] += by_word
        return back

    def train(self, texts: list[np.ndarray], passes: int = 1, rate: float = 0.08, most: int | None = None, most_lanes: int | None = None) -> None:
        """texts: the symbols of each document, its end last. most: tokens after which a pass ends. The documents are one stream, cut
        into lanes of one length; a document that goes on in the next lane goes on there without a state."""
        u, p = UNITS, self.p
        stream = np.concatenate(texts)[:most]
        n = len(stream)
        begins = np.cumsum([0, *map(len, texts)])
        lanes = max(1, min(most_lanes or TRAIN_LANES, n // TRAIN_STEPS))
        long = -(-n // lanes)
        padded = np.zeros(lanes * long + 1, np.int64)
        padded[1 : n + 1] = stream
        goes_on = np.ones(lanes * long, np.float32)
        goes_on[begins[begins < n]] = 0
        whole = (np.where(goes_on > 0, padded[:-1], 0), padded[1:], goes_on, np.arange(lanes * long) < n)  # a document begins after an end
        whole = [np.ascontiguousarray(x.reshape(lanes, long).T) for x in whole]
        # Tables of a window, made once: (steps, lanes, units).
        gates_, given_ = np.empty((TRAIN_STEPS, lanes, 2 * u), np.float32), np.empty((TRAIN_STEPS, lanes, 3 * u), np.float32)
        rooms = [np.empty((TRAIN_STEPS, lanes, u), np.float32) for _ in range(7)]
        gate, hidden, part = (np.empty((lanes, k * u), np.float32) for k in (2, 3, 1))
        for _ in range(passes):
            h = np.zeros((lanes, u), np.float32)
            for at in range(0, long, TRAIN_STEPS):
                symbols, targets, keep, live = (x[at : at + TRAIN_STEPS] for x in whole)
                steps, flat = len(symbols), symbols.ravel()
                gates, given, (new, before, hidden_new, states, by_new, by_reset, by_update) = gates_[:steps], given_[:steps], (x[:steps] for x in rooms)
                # forward; of r and z the logistic function is (1 + tanh(x / 2)) / 2
                (p["input"][:, : 2 * u] / 2).take(flat, 0, gates.reshape(-1, 2 * u), "clip")
                p["input"][:, 2 * u :].copy().take(flat, 0, new.reshape(-1, u), "clip")
                state_gates, state_new = p["state"][:, : 2 * u] / 2, p["state"][:, 2 * u :].copy()
                fresh = (keep == 0).any(1).tolist()
                for t in range(steps):
                    h0, g, n_, hn = before[t], gates[t], new[t], hidden_new[t]
                    if fresh[t]:
                        np.multiply(h, keep[t][:, None], out=h0)
                    else:
                        h0[:] = h
                    g += np.matmul(h0, state_gates, out=gate)
                    np.tanh(g, out=g)
                    g += 1
                    g *= 0.5
                    np.matmul(h0, state_new, out=hn)
                    n_ += np.multiply(hn, g[:, :u], out=part)
                    np.tanh(n_, out=n_)
                    h = np.subtract(h0, n_, out=states[t])
                    h *= g[:, u:]
                    h += n_
                h = h.copy()
                grads = {k: np.zeros_like(x) for k, x in p.items() if k != "input"}
                if full := bool(live.all()):
                    into = self.output_gradients(states.reshape(-1, u), targets.ravel(), grads).reshape(states.shape)
                else:
                    into = np.zeros_like(states)
                    into[live] = self.output_gradients(states[live], targets[live], grads)
                # backward
                r, z = gates[..., :u], gates[..., u:]
                np.subtract(1, z, out=by_reset)
                np.multiply(new, new, out=by_new)
                np.subtract(1, by_new, out=by_new)
                by_new *= by_reset
                np.subtract(before, new, out=by_update)
                by_update *= by_reset
                by_update *= z
                np.subtract(1, r, out=by_reset)
                by_reset *= r
                by_reset *= hidden_new
                back, later = p["state"].T.copy(), np.zeros((lanes, u), np.float32)
                for t in range(steps - 1, -1, -1):
                    d, g = into[t], given[t]
                    d += later
                    dn = np.multiply(d, by_new[t], out=part)
                    g[:, 2 * u :] = dn
                    np.multiply(dn, by_reset[t], out=g[:, :u])
                    np.multiply(d, by_update[t], out=g[:, u : 2 * u])
                    hidden[:, : 2 * u] = g[:, : 2 * u]
                    np.multiply(dn, r[t], out=hidden[:, 2 * u :])
                    grads["state"] += before[t].T @ hidden
                    d *= z[t]
                    np.matmul(hidden, back, out=later)
                    later += d
                    if fresh[t]:
                        later *= keep[t][:, None]
                scale = np.float32(1 / max(1, live.size if full else int(live.sum())))
                used = np.flatnonzero(np.bincount(flat, minlength=self.SYMBOLS))
                at_symbol = (flat[:, None] * (3 * u) + np.arange(3 * u)).ravel()
                by_symbol = np.bincount(at_symbol, given.ravel(), self.SYMBOLS * 3 * u).reshape(-1, 3 * u)[used]
                self._step("input", by_symbol.astype(np.float32), scale, rate, used)
                for k, g in grads.items():
                    self._step(k, g, scale, rate)

    def _step(self, name: str, gradient: np.ndarray, scale: np.float32, rate: float, used: np.ndarray | None = None) -> None:
        """A step of Adagrad; used: the rows that the gradient is of."""
        g = gradient
        g *= scale
        np.clip(g, -1, 1, out=g)
        at = slice(None) if used is None else used
        squares = self.squares[name][at] + g * g
        self.squares[name][at] = squares
        g *= rate
        g /= np.sqrt(squares, out=squares)
        self.p[name][at] -= g


class Scorer:
    """A network's weights laid out for scoring: biases beside the weights, work done in place. Gives what the network gives."""

    def __init__(self, network: Network):
        p, u = network.p, UNITS
        self.network = network
        self.gates, self.new = np.ascontiguousarray(p["input"][:, : 2 * u]) / 2, np.ascontiguousarray(p["input"][:, 2 * u :])
        self.state_gates, self.state_new = np.ascontiguousarray(p["state"][:, : 2 * u]) / 2, np.ascontiguousarray(p["state"][:, 2 * u :])
        self.classes = np.vstack([p["class"], p["class_bias"]])
        self.words = np.concatenate([p["word"], p["word_bias"][:, None, :]], axis=1)
        self.ones, self.row = np.ones(max(IN_CLASS, CLASSES + OTHERS), np.float32), np.arange(ROWS)
        self.room = np.empty(ROWS * max(IN_CLASS, CLASSES + OTHERS), np.float32)

    def states(self, symbols: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        u, out = UNITS, np.empty((*symbols.shape, UNITS), np.float32)
        gates, new = self.gates[symbols], self.new[symbols]
        fresh = (keep == 0).any(1)
        part, gate = np.empty_like(h), np.empty((len(h), 2 * u), np.float32)
        for t in range(len(symbols)):
            h0 = h * keep[t][:, None] if fresh[t] else h
            g, n = gates[t], new[t]
            np.matmul(h0, self.state_gates, out=gate)
            g += gate
            np.tanh(g, out=g)  # the logistic function is (1 + tanh(x / 2)) / 2
            g += 1
            g *= 0.5
            np.matmul(h0, self.state_new, out=part)
            part *= g[:, :u]
            n += part
            np.tanh(n, out=n)
            h = np.subtract(h0, n, out=out[t])
            h *= g[:, u:]
            h += n
        return out

    def _of_class(self, x: np.ndarray, weights: np.ndarray, own: np.ndarray, out: np.ndarray) -> None:
        """Adds to out the log probabilities of the columns own; x: states, and ones for the biases."""
        for i in range(0, len(x), ROWS):
            x_, own_, out_ = x[i : i + ROWS], own[i : i + ROWS], out[i : i + ROWS]
            logits = np.matmul(x_, weights, out=self.room[: len(x_) * weights.shape[1]].reshape(len(x_), -1))
            picked = logits[self.row[: len(x_)], own_]
            total = np.exp(logits, out=logits) @ self.ones[: weights.shape[1]]
            if not (np.isfinite(total).all() and (total > 1e-30).all()):  # far from what training gives; the slow way then
                far = (x_ @ weights).astype(np.float64)
                top = far.max(1)
                out_ += far[self.row[: len(x_)], own_] - top - np.log(np.exp(far - top[:, None]).sum(1))
            else:
                out_ += picked
                out_ -= np.log(total, out=total)

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        x = np.ones((len(h), UNITS + 1), np.float32)
        x[:, :UNITS] = h
        frequent = targets < CLASSES * IN_CLASS
        own = np.where(frequent, targets // IN_CLASS, targets - CLASSES * IN_CLASS + CLASSES)
        out = np.zeros(len(h))
        self._of_class(x, self.classes, own, out)
        at = np.flatnonzero(frequent)
        at = at[np.argsort(own[at].astype(np.uint8), kind="stable")]
        edges = np.searchsorted(own[at], np.arange(CLASSES + 1)).tolist()
        x, k, by_word = x[at], targets[at] % IN_CLASS, np.zeros(len(at))
        for c in range(CLASSES):
            if (i := edges[c]) < (j := edges[c + 1]):
                self._of_class(x[i:j], self.words[c], k[i:j], by_word[i:j])
        out[at] += by_word
        return out


class Lanes:
    """Documents side by side: each lane goes on with the next document when one ends. source: (name, symbols with the end last)."""

    def __init__(self, source: Iterator, lanes: int):
        self.source, self.more = source, True
        self.rows: list[list] = [[] for _ in range(lanes)]  # of a lane: [name, symbols, position]
        self.left = [0] * lanes

    def shrink(self, h: np.ndarray) -> np.ndarray:
        """When no documents are left to begin, lanes without work go; h: a row for each lane."""
        if self.more or all(self.rows):
            return h
        kept = [i for i, queue in enumerate(self.rows) if queue]
        self.rows, self.left = [self.rows[i] for i in kept], [self.left[i] for i in kept]
        return h[kept]

    def window(self, steps: int):
        """(given symbols, targets, keep, live, pieces): arrays of (steps, lanes); pieces: (name, lane, first step, end, whether the
        document ends). None when all is done."""
        n = len(self.rows)
        given, targets = np.zeros((steps, n), np.int64), np.zeros((steps, n), np.int64)
        keep, live, pieces = np.ones((steps, n), np.float32), np.zeros((steps, n), bool), []
        for lane, queue in enumerate(self.rows):
            while self.more and self.left[lane] < steps:
                if (new := next(self.source, None)) is None:
                    self.more = False
                    break
                queue.append([*new, 0])
                self.left[lane] += len(new[1])
            t = 0
            while queue and t < steps:
                name, symbols, at = queue[0]
                m = min(steps - t, len(symbols) - at)
                targets[t : t + m, lane] = symbols[at : at + m]
                if at:
                    given[t : t + m, lane] = symbols[at - 1 : at + m - 1]
                else:  # a document begins after an end, with no state
                    given[t + 1 : t + m, lane] = symbols[: m - 1]
                    keep[t, lane] = 0
                pieces.append((name, lane, t, t + m, at + m == len(symbols)))
                queue[0][2] += m
                t += m
                if at + m == len(symbols):
                    queue.pop(0)
            live[:t, lane] = True
            self.left[lane] -= t
        return (given, targets, keep, live, pieces) if pieces else None


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token binary, n): texts: one binary column."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def kernel(batches):
        total: Counter = Counter()
        for b in batches:
            for text in utf8(b.column(0)):
                total.update(words_of(text))
                if len(total) > 200_000:
                    yield batch(schema, [list(total), list(total.values())])
                    total = Counter()
        yield batch(schema, [list(total), list(total.values())])

    return map_arrow(texts, kernel, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """SENT words at most come to the driver, and sums."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words_only = counts.where(F.octet_length("token") > 0).withColumn("octave", F.floor(F.log2("n") * 8))
    # As many octaves of counts from the top as SENT words hold, and of the next one so many by a hash: the driver gets these words and no
    # more, whatever the number of tasks.
    least, room, part = None, SENT - 1, 0.0
    for r in sorted(words_only.groupBy("octave").count().collect(), key=lambda r: -r.octave):
        least = r.octave
        if r["count"] > room:
            part = 0.95 * room / r["count"]
            break
        room -= r["count"]
        part = 1.0
    digest = F.concat(F.unhex(F.lit("00")), F.unhex(F.sha2("token", 256)))
    key = F.when(F.octet_length("token") <= LONG, F.col("token")).otherwise(digest)
    chosen = words_only.where((F.col("octave") > F.lit(least)) | ((F.col("octave") == F.lit(least)) & (F.pmod(F.xxhash64("token"), F.lit(10_000)) < int(10_000 * part))))
    of_class = (F.crc32(F.substring("token", -2, 2)) % OTHERS).alias("c")
    rows = [] if least is None else sorted(chosen.select(key.alias("key"), "n", of_class).collect(), key=lambda r: (-r.n, bytes(r.key)))[: SENT - 1]
    ends = counts.where(F.octet_length("token") == 0).collect()
    words = [END, *(bytes(r.key) for r in rows)]
    numbers = np.array([ends[0].n if ends else 0, *(r.n for r in rows)], float)
    classes = np.array([other_class(END), *(r.c for r in rows)], np.int64)
    total, distinct = np.zeros(OTHERS), np.zeros(OTHERS)
    by_class = counts.groupBy(of_class).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    for r in by_class:
        total[r.c], distinct[r.c] = r.n, r.v
    for c, n in zip(classes[: CLASSES * IN_CLASS].tolist(), numbers[: CLASSES * IN_CLASS].tolist(), strict=True):
        total[c] -= n
        distinct[c] -= n > 0
    return Vocabulary(words, numbers, int(whole.n), int(whole.v), total, distinct, classes)


def score(docs: DataFrame, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; trained on rows of the other folds."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), (fold_of(id_col) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    counts = written(count_tokens(rows.where(~F.col("held_out")).select("text")), "tokens")
    words = vocabulary(counts)
    network = Network(words)
    # Training rows in the order of a hash until FIRST_TOKENS tokens are met: about so many rows as hold them.
    looked = numbered(_looked(rows, kind, Shared(spark, words)), "row", "looked")
    training = looked.where(~F.col("held_out"))
    part = max(1, words.total // (2 * FIRST_TOKENS))
    sample = training.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).orderBy(F.xxhash64(F.lit("first"), "id"), "id").select("symbols")
    texts, size = [], 0
    for r in sample.toLocalIterator():
        texts.append(np.frombuffer(r.symbols, np.uint16))
        if (size := size + len(texts[-1])) >= FIRST_TOKENS:
            break
    if texts:
        network.train(texts, FIRST_PASSES, most=FIRST_TOKENS)
        _average(training, network, Shared(spark, (words, network)))
    shared = Shared(spark, network)

    def kernel(batches):
        scorer = shared.made(Network.prepared)
        done: list[list] = []
        schema = None

        def documents():
            nonlocal schema
            for b in batches:
                schema = b.schema.remove(b.schema.get_field_index("symbols"))
                for *row, symbols in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                    yield row, np.frombuffer(symbols, np.uint16)

        lanes, h = Lanes(documents(), LANES), np.zeros((LANES, UNITS), np.float32)
        while (w := lanes.window(STEPS)) is not None:
            symbols, targets, keep, live, pieces = w
            states = scorer.states(symbols, keep, h)
            h = lanes.shrink(states[-1])
            if live.all():
                logs = scorer.log_probabilities(states.reshape(-1, UNITS), targets.ravel()).reshape(symbols.shape)
            else:
                logs = np.zeros(symbols.shape)
                logs[live] = scorer.log_probabilities(states[live], targets[live])
            sums = np.vstack([np.zeros(logs.shape[1]), np.cumsum(logs, 0)]) / np.log(10)
            for document, lane, begin, end, ends in pieces:
                document[-1] += float(sums[end, lane] - sums[begin, lane])
                if ends:
                    done.append(document)
            if len(done) >= 256:
                yield batch(schema, [*zip(*done, strict=True)])
                done.clear()
        if done:
            yield batch(schema, [*zip(*done, strict=True)])

    scored = written(map_arrow(looked.select("id", "held_out", "n_tokens", "known", "base", "row", "own", "symbols"), kernel, f"id {kind}, held_out boolean, n_tokens long, known long, base double, row long, own double"), "scored")
    tokens = looked.select("row", F.explode("unsent").alias("x")).select("row", F.col("x.token").alias("token"), F.col("x.n").alias("k"))
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = tokens.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("rest"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rest_known"))
    all_ = scored.join(rest, "row", "left")
    more = F.coalesce("rest", F.lit(0.0))
    return all_.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"))


def _looked(rows: DataFrame, kind: str, shared: Shared) -> DataFrame:
    """rows (id, held_out, text), the texts as symbols of two bytes, with what the sent words give to counts and scores, and the others."""
    pairs = pa.struct([("token", pa.binary()), ("n", pa.int32())])

    def kernel(batches):
        words = shared.made(lambda value: value)
        for b in batches:
            columns: list[list] = [[], [], [], [], []]
            tokens, numbers, edges = [], [], [0]
            for text in utf8(b.column(2)):
                found = words_of(text)
                n, symbols, unsent = words.look(found)
                sent = n[n >= 0]
                other = symbols[symbols >= CLASSES * IN_CLASS] - CLASSES * IN_CLASS
                base = float(words.log_count[sent].sum()) - len(found) * words.log_total
                own = float(words.log_count[sent[sent >= words.frequent]].sum()) - float(words.log_other[other].sum())
                for column, x in zip(columns, (len(found), int((words.counts[sent] > 0).sum()), base, own, symbols.astype(np.uint16).tobytes()), strict=True):
                    column.append(x)
                counted = Counter(unsent)
                tokens += counted
                numbers += counted.values()
                edges.append(len(tokens))
            unsent = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(numbers, pa.int32())], fields=[*pairs]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            arrays = [b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), unsent]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "held_out", "n_tokens", "known", "base", "own", "symbols", "unsent"])

    return map_arrow(rows, kernel, f"id {kind}, held_out boolean, n_tokens long, known long, base double, own double, symbols binary, unsent array<struct<token:binary,n:int>>")


def _average(training: DataFrame, network: Network, shared: Shared) -> int:
    """One round in every partition on all its training rows, from the same weights; then the mean of the weights, each partition by its
    tokens. A partition sends its weights as a few rows of IN_ROW, Spark adds them up, and the driver gets the sums. Gives the tokens trained on.
    training: rows with symbols, or else with a text."""
    coded = "symbols" in training.columns
    names = list(network.p)
    schema = pa.schema([("part", pa.int32()), ("w", pa.binary()), ("n", pa.float64())])

    def kernel(batches):
        words, given = shared.made(lambda value: value)
        own = Network.__new__(Network)
        own.p, own.squares = ({k: v.copy() for k, v in x.items()} for x in (given.p, given.squares))
        n, held, size = 0, [], 0
        for b in batches:
            for text in utf8(b.column(0)):
                symbols = np.frombuffer(text, np.uint16) if coded else words.look(words_of(text))[1].astype(np.uint16)
                held.append(symbols)
                size += len(symbols)
                if size > PORTION:
                    own.train(held, rate=RATE, most_lanes=WIDE)
                    n, held, size = n + size, [], 0
        if held:
            own.train(held, rate=RATE, most_lanes=WIDE)
        if n := n + size:
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype(float) * n
            rows = [flat[i : i + IN_ROW].tobytes() for i in range(0, len(flat), IN_ROW)]
            yield batch(schema, [np.arange(len(rows), dtype=np.int32), rows, np.full(len(rows), float(n))])

    def add(batches):
        sums: dict[int, tuple] = {}
        for b in batches:
            for part, w, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                old, met = sums.get(part, (0, 0.0))
                sums[part] = old + np.frombuffer(w, np.float64), met + n
        yield batch(schema, [list(sums), [w.tobytes() for w, _ in sums.values()], [n for _, n in sums.values()]])

    sent = map_arrow(training.select("symbols" if coded else "text"), kernel, "part int, w binary, n double").repartition("part")
    rows = sorted(map_arrow(sent, add, "part int, w binary, n double").collect(), key=lambda r: r.part)
    if rows:
        flat = np.concatenate([np.frombuffer(r.w, np.float64) / r.n for r in rows])
        at = 0
        for k in names:
            size = network.p[k].size
            network.p[k] = flat[at : at + size].reshape(network.p[k].shape).astype(np.float32)
            at += size
    return int(rows[0].n) if rows else 0
