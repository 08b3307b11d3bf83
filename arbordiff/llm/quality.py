"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word (lower-cased, whole) has a sparse random index vector, drawn from its hash. Its word vector is the sum of the index vectors of
its neighbours over all documents, less what any word would have got, of length 1. Sums are kept in SLOTS slots that words are dealt to
by their hash, so that memory is bounded whatever the vocabulary: a slot's vector is that of its frequent word, rare words share one.
A document's vector is the mean of its words' vectors, beside some measures of the whole text.

Null and empty texts have the zero vector and are scored like any other. Texts and words are read whole, however long. Without labelled
rows of both classes every score is the share of label 1 (0.5 without any label). An empty table gives an empty one, repeated rows
repeat; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from arbordiff.llm.common import Shared, batch, fold_of, map_arrow, utf8
from arbordiff.llm.labelled import SAMPLE_ROWS, Sample, training_sample

#: Slots of words, length of vectors, nonzero entries of an index vector, slots in one row of the sums, tokens summed at once, units of
#: the hidden layer, measures of the whole text.
SLOTS, DIMENSIONS, ENTRIES, IN_ROW, AT_ONCE, HIDDEN, MEASURES = 1 << 14, 64, 4, 64, 1 << 18, 24, 13
#: What a byte is: 0 other, 1 A-Z, 2 a-z, 3 digit, 4 mark, 5 white space, 6 beyond ASCII.
_KIND = np.array([1 if 65 <= b < 91 else 2 if 97 <= b < 123 else 3 if 48 <= b < 58 else 5 if b in b" \t\n\v\f\r" else 4 if 33 <= b < 127 else 6 if b > 127 else 0 for b in range(256)], np.uint8)


def hashes_of(text: bytes) -> np.ndarray:
    """The hash of each word; bytes.split() splits at 09-0D and 20."""
    words = text.decode().lower().encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of the index vectors, both (words, ENTRIES): six bits for a place and one for a sign."""
    bits = hashes[:, None] >> (np.uint64(14) + np.arange(ENTRIES, dtype=np.uint64) * np.uint64(7))
    return (bits & np.uint64(DIMENSIONS - 1)).astype(np.int64), 1 - 2 * ((bits >> np.uint64(6)) & np.uint64(1)).astype(np.int8)


def _add(sums: np.ndarray, counts: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
    """Adds to the words' slots the index vectors of the words before and after them. first: where a text begins."""
    slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
    places, signs = index_vectors(hashes)
    counts += np.bincount(slots, minlength=SLOTS)
    inner = np.ones(len(hashes), bool)
    inner[first] = False
    after = np.flatnonzero(inner)  # words with a word before them
    for own, other in ((after, after - 1), (after - 1, after)):
        at = slots[own, None] * DIMENSIONS + places[other]
        sums += np.bincount(at.ravel(), signs[other].ravel(), SLOTS * DIMENSIONS).astype(np.int32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(SLOTS, DIMENSIONS) over all documents. Each task sends its sums as SLOTS / IN_ROW rows, and so many rows come to the driver."""
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    width = IN_ROW * (DIMENSIONS + 1)

    def count(batches):
        sums, counts = np.zeros(SLOTS * DIMENSIONS, np.int32), np.zeros(SLOTS, np.int64)
        held, size, met = [], 0, False

        def flush():
            whole = np.concatenate(held)
            lengths = np.array([len(h) for h in held])
            _add(sums, counts, whole, (np.cumsum(lengths) - lengths)[lengths > 0])

        for b in batches:
            for text in utf8(b.column(0)):
                held.append(hashes_of(text))
                size += len(held[-1])
                if size >= AT_ONCE:
                    flush()
                    held, size, met = [], 0, True
        if size:
            flush()
            met = True
        if met:
            table = np.concatenate([sums.reshape(-1, IN_ROW * DIMENSIONS), counts.reshape(-1, IN_ROW)], axis=1, dtype=np.int64)
            yield batch(schema, [np.arange(SLOTS // IN_ROW, dtype=np.int32), [zlib.compress(row.tobytes(), 1) for row in table]])

    def total(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for part, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[part] = found.get(part, 0) + np.frombuffer(zlib.decompress(row), np.int64)
        yield batch(schema, [list(found), [zlib.compress(x.tobytes(), 1) for x in found.values()]])

    sums = map_arrow(docs.select(text_col), count, "part int, sums binary").repartition("part")
    table = np.zeros((SLOTS // IN_ROW, width))
    for r in map_arrow(sums, total, "part int, sums binary").collect():
        table[r.part] = np.frombuffer(zlib.decompress(r.sums), np.int64)
    contexts, counts = table[:, : IN_ROW * DIMENSIONS].reshape(SLOTS, DIMENSIONS), table[:, IN_ROW * DIMENSIONS :].reshape(SLOTS, 1)
    own = contexts / np.maximum(counts, 1) - contexts.sum(0) / max(1.0, counts.sum())
    own *= counts > 0
    return (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(text: bytes, vectors: np.ndarray) -> np.ndarray:
    hashes = hashes_of(text)
    n, size = max(1, len(hashes)), max(1, len(text))
    pooled = vectors[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)].sum(0, dtype=np.float64) / n
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / size
    lines = text.split(b"\n")
    again = np.count_nonzero(hashes[1:] == hashes[:-1]) / n
    extra = [np.log1p(len(hashes)) / 8, len(np.unique(hashes)) / n, again * 4, min(3.0, len(zlib.compress(text, 1)) / size) * 2, len(set(lines)) / len(lines), size / len(lines) / 500, *kinds]
    return np.concatenate([pooled * 4, np.minimum(extra, 5.0)])


class Network:
    """tanh layer, logistic unit, temperature."""

    def __init__(self, vectors: np.ndarray, share: float = 0.5):
        self.vectors, self.temperature = vectors, 1.0
        random = np.random.default_rng(11)
        self.p = [random.normal(0, 0.2, (DIMENSIONS + MEASURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
        self.mean, self.scale = np.zeros(DIMENSIONS + MEASURES), np.ones(DIMENSIONS + MEASURES)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4) -> None:
        random = np.random.default_rng(13)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        m, v, t = [0 * p for p in self.p], [0 * p for p in self.p], 0
        for epoch in range(epochs):
            for part in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
                h = np.tanh(z[part] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate([z[part].T @ back + decay * self.p[0], back.sum(0), h.T @ d + decay * self.p[2], d.sum()]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    self.p[i] = self.p[i] - rate / (1 + epoch / 10) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on rows that it wasn't trained on."""
        logits = self.logits(x)

        def loss(t: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-9, 1 - 1e-9)
            return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

        self.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)


def fit(sample: Sample, vectors: np.ndarray) -> Network:
    share = float(np.clip(sample.label.mean(), 1e-6, 1 - 1e-6)) if len(sample) else 0.5
    network = Network(vectors, share)
    if len(np.unique(sample.label)) == 2:
        x = np.stack([features(t.encode(), vectors) for t in sample.texts()])
        y = sample.label.astype(float)
        apart = np.arange(len(y)) % 5 == 0
        network.train(x[~apart], y[~apart])
        network.calibrate(x[apart], y[apart])
    return network


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row."""
    network = fit(training_sample(docs, labels, "quality", held_out, rows, id_col, text_col), word_vectors(docs, text_col))
    shared = Shared(docs.sparkSession, network)

    def kernel(batches):
        net = shared.made(lambda network: network)
        for b in batches:
            x = np.stack([features(t, net.vectors) for t in utf8(b.column(2))]) if len(b) else np.zeros((0, DIMENSIONS + MEASURES))
            p = net.probabilities(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows_ = docs.select(id_col, (fold_of(id_col) == held_out).alias("held_out"), text_col)
    return map_arrow(rows_, kernel, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")
