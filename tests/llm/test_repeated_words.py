"""Passages of over 50 words that repeat go in the pipeline, also those of fewer than 400 bytes."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from arbordiff.llm import language_model, near_copies, repeats, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_passage_of_51_words(spark):
    r = random.Random(9)
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(90)) for _ in range(6)]
    passage = " ".join(r.choice("abcdefgh") * r.randint(1, 4) + str(i % 10) for i in range(51))
    part = " ".join(f"k{i}" for i in range(50))
    assert len(passage) < 300
    texts = [f"{own[0]}\n{passage}\n{own[1]}", f"{passage} {own[2]}", f"{own[3]} é {part}", f"{part}\n{own[4]}", own[5], None, "", passage]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_strings(spark, docs, "").collect()}
    want = [f"{own[0]}\n\n{own[1]}", f" {own[2]}", *texts[2:7]]
    assert {i: r.text for i, r in got.items()} == dict(enumerate(want))
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.values())


def words_brute(texts, n):
    """Words of each text within strings of n words that start at several places."""
    split = [(t or "").split() for t in texts]
    often = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    return [len({i + k for i in range(len(w) - n + 1) if often[tuple(w[i : i + n])] > 1 for k in range(n)}) for w in split]


@pytest.mark.parametrize("hot", [500, 3])
@pytest.mark.parametrize("n", [7, 9])
def test_repeated_words(spark, monkeypatch, n, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(4)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 60))) for _ in range(20)] + ["x " * 30, "a b c " * 9, "a\tb\n c" * 4, None, "", "p q r s t u v w x y", "p q r  s t u v w x y"]
    texts += ["own" + str(i) + " one two three four five six seven eight nine ten" + " end" * (i % 3) + str(i) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.n_repeated_words for x in repeats.remove_repeats(docs, length=40, gram=20, words=n).collect()}
    assert got == dict(enumerate(words_brute(texts, n)))


def test_rows_keep_their_numbers(spark, tmp_path):
    """The cut of the input into tasks changes between planning and running; results stay with their rows."""
    r = random.Random(6)
    passage = " ".join(f"s{r.randrange(10**5)}" for _ in range(60))
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(20, 60))) + (passage if i % 3 == 0 else "") for i in range(300)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "t"))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    try:
        read = spark.read.parquet(str(tmp_path / "t"))
        found = [repeats.remove_repeats(read, words=51), near_copies.near_copies(read), simhash.near_duplicates(read), language_model.score(read)]
        for k, v in zip(keys, ("4000", "3", "100"), strict=True):
            spark.conf.set(k, v)
        by_id = [{x.doc_id: x for x in f.collect()} for f in found]
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert all(x.keys() == set(range(300)) for x in by_id)
    for i, t in enumerate(texts):
        assert (by_id[0][i].n_bytes, by_id[0][i].n_removed > 0, by_id[0][i].n_repeated_words) == (len(t), i % 3 == 0 and len(passage) >= 400, 59 * (i % 3 == 0))
        assert by_id[1][i].component_id == i and by_id[1][i]["first"]
        assert by_id[2][i].fp == np.array(simhash.fingerprint(t.encode()), np.uint64).view(np.int64)
        assert by_id[3][i].n_tokens == len(t.split()) + 1
