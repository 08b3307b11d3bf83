"""Near copies of five-word similarity 0.8 go in the pipeline, also where SimHash differs by more than 3 bits."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from arbordiff.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def planted():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(3000)]
    texts = [None, "", "one", "One", "a b c d e", "a b c d f"]
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(80, 400))
        texts.append(" ".join(base))
        for share in (0.005, 0.012, 0.02, 0.03, 0.06):
            texts.append(" ".join(r.choice(vocabulary) if r.random() < share else w for w in base))
    return texts


@pytest.mark.parametrize("group", [1000, 2])
def test_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(near_copies, "GROUP", group)
    texts = planted()
    root = list(range(len(texts)))
    apart = 0
    for i, j in combinations(range(len(texts)), 2):
        if similar(texts[i], texts[j]):
            prints = [simhash.fingerprint((texts[k] or "").encode()) for k in (i, j)]
            apart += (prints[0] ^ prints[1]).bit_count() > 3
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert apart > 10
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(root))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root)


@pytest.mark.parametrize("group", [1000, 40])
def test_near_copies_of_a_large_group(spark, monkeypatch, group):
    monkeypatch.setattr(near_copies, "GROUP", group)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] + [" ".join(f"x{r.random()}" if i == at else w for i, w in enumerate(base)) for at in r.choices(range(120), k=400)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    assert [r.doc_id for r in near_copies.drop_near_copies(docs).collect()] == [0]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
