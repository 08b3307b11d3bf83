"""The pipeline's near duplicates come through SimHash and the pigeonhole join, and are checked exactly."""

import numpy as np

from arbordiff.llm import near_copies


def test_fingerprints_within_three_bits_are_candidates(spark):
    near = [0b1011, 0b1000, 0b1111000]  # 2 bits, then 3 bits apart: a chain
    rows = [(i, 10 + i, fp) for i, fp in enumerate([*near, 2**40 - 1])]
    found = near_copies.simhash_members(spark.createDataFrame(rows, "cls long, row long, fp long")).collect()
    assert sorted((r.cls, r.row) for r in found) == [(0, 10), (1, 11), (2, 12)] and len({r.key for r in found}) == 1


def test_fingerprint_of_a_set():
    sets = np.array([0b011, 0b001, 0b111], np.uint64)
    assert near_copies.simhash_of(sets) == 0b011


def test_only_what_is_similar_goes(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "nothing like it at all here"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1, 3, 4]
