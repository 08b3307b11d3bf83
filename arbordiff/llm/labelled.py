"""A bounded sample of labelled training rows for fitting classifiers on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordiff.llm.common import fold_of, pack, unpack

#: Most labelled rows that a classifier is fitted on, and most characters of text they hold together.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 12_000, 40_000_000


class Sample:
    """Labelled texts; they stay compressed and are opened one at a time, so that the driver holds a fraction of their characters."""

    def __init__(self, packed: list[bytes], label: np.ndarray):
        self.packed, self.label = packed, label

    def __len__(self) -> int:
        return len(self.packed)

    def texts(self, rows: np.ndarray | None = None) -> Iterator[str]:
        """The texts, or those of the given rows (numbers)."""
        for i in range(len(self.packed)) if rows is None else rows.tolist():
            yield unpack(pa.array([self.packed[i]], pa.binary()))[0].decode()


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int = 0, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """Texts and labels of at most `rows` labelled documents outside the held-out fold, those with the least hash of their id, and of these
    at most SAMPLE_CHARACTERS: whole texts, in hash order. Null labels and ids are left out; of several labels of an id the largest counts,
    of several texts the least. No shuffle of texts: the sampled ids are few and are sent to the documents."""
    ids = labels.where((fold_of(id_col) != held_out) & F.col(id_col).isNotNull() & F.col(label).isNotNull())
    ids = ids.groupBy(id_col).agg(F.max(label).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    sizes = docs.select(F.col(id_col), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n")).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.max("n").alias("n"), F.max("label").alias("label")).toPandas()
    if not len(sizes):
        return Sample([], np.zeros(0, int))
    sizes["h"] = pd.util.hash_array(sizes[id_col].to_numpy())
    sizes = sizes.sort_values("h")
    kept = sizes[(sizes.n.cumsum() <= SAMPLE_CHARACTERS) | (sizes.n.cumsum() == sizes.n)]
    chosen = docs.sparkSession.createDataFrame(kept[[id_col, "label"]])
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).select(id_col, "text", "label")
    found: dict = {}
    for r in pack(texts, "text").collect():
        packed = bytes(r["text"])
        found[r[id_col]] = min(found.get(r[id_col], (packed, r["label"])), (packed, r["label"]))
    ordered = [found[i] for i in sorted(found)]
    return Sample([p for p, _ in ordered], np.array([y for _, y in ordered]))
