"""Quality rules, hard negatives and token alignment: brute force, odd rows, empty tables."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from arbordiff.llm import hard_negatives, quality_rules, queries, token_alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a  b", " a", "a ", "\nx y\n\nz\n", "tab\tb  c　d\r\ne", "<|endoftext|> <s> </s> f", "日本語テキスト 123 😀😀 é", "a▁b c", "x \x00 y \x1c z", "a a a a a a a a a a a a", "#!? " * 30, "w" * 4000 + " v", "one two three. " * 40 + "\n" * 3]


# Quality rules


def measures_brute(text):
    b = (text or "").encode()
    words, lines = b.split(), [x for x in b.split(b"\n") if x.split()]
    times = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_measures():
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["a", "bb", "é", "|", "c.\n", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a b c d e " * 70_000 + "f"]
    found = quality_rules.measure([(t or "").encode() for t in texts])
    at = [quality_rules.MEASURES.index(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert [tuple(r) for r in found[:, at].tolist()] == [measures_brute(t) for t in texts]


def test_windows_are_counted_in_their_own_text():
    words = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5])
    assert quality_rules.repeated(words, np.repeat([0, 1, 2], [5, 5, 6])).sum() == 0
    assert quality_rules.repeated(words, np.zeros(16, np.int64)).sum() == 15


def test_expectation_maximisation_finds_who_is_right():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right_good, right_bad, silent = np.array([0.95, 0.9, 0.99, 0.6, 0.97]), np.array([0.9, 0.7, 0.5, 0.5, 0.8]), 0.2
    says_good = np.where(good[:, None], rng.random((20_000, 5)) < right_good, rng.random((20_000, 5)) >= right_bad)
    votes = np.where(rng.random((20_000, 5)) < silent, 0, np.where(says_good, 1, -1))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, n)
    assert np.abs(model.good - right_good).max() < 0.05 and np.abs(model.bad - right_bad).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95
    yes, no = model.weights()
    assert (yes >= 0).all() and (no <= 0).all()


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op11_quality_rules"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        want = measures_brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_op11_keeps_the_clean_and_drops_the_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0").select("doc_id", "quality")
    rows = queries.queries()["op11_quality_rules"](spark, "/root/testdata/sf0.01").where("not base_failed").join(labels, "doc_id").collect()
    for quality, least in ((1, 0.98), (0, 0.9)):
        own = [r.kept == bool(quality) for r in rows if r[-1] == quality]
        assert len(own) > 5 and sum(own) >= least * len(own)


def test_quality_rules_odd_rows(spark):
    rows = [(i, t, "v") for i, t in enumerate(ODD)] + [(None, "x y", "v"), (3, "again", "v"), (3, "again", "v")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, votes string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert all(0 <= r.quality <= 1 for r in got) and all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Hard negatives


def brute_negatives(rows, every=4, positives=5, negatives=3, scale=256):
    """rows: (vec_id, vector, label)."""
    kept = sorted({(i, tuple(v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    whole = [(i, [int(np.floor(scale * x)) for x in v], y) for i, v, y in kept]
    out = Counter()
    for a, (i, v, y) in enumerate(whole):
        if i % every:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, z, b) for b, (j, w, z) in enumerate(whole) if b != a and len(w) == len(v)]
        for s, j, _, _ in sorted((x for x in scores if x[2] == y), key=lambda x: x[:2])[:positives]:
            fits = sorted((x for x in scores if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s), key=lambda x: x[:2])[:negatives]
            out.update((i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1))
    return out


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sizes", [{}, {"CELL": 20, "PART": 16, "QUERIES": 5, "LEAF": 3, "BUCKETS": 2}])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(hard_negatives, k, v)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 2
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=5) * 0.7], int(rng.integers(4))) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0, 1.0], i % 2) for i in range(24)]  # ties
    rows += [(2000, [1.0, 2.0], 0), (2004, [1.0, 1.0], 0), (2001, [1.0, 1.0], 1), (2002, [3.0, 0.0], 2)]
    rows += [(4, None, 1), (8, [], 1), (12, [1.0, None, 1.0, 1.0, 1.0], 1), (16, [float("nan")] * 5, 1), (20, [float("inf")] + [0.0] * 4, 1), (None, [1.0] * 5, 1), (24, [1.0] * 5, None), (28, [0.0] * 5, 2)]
    rows += rows[:7]  # equal rows count once
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "label")
    got = Counter(tuple(r[c] for c in NAMES) for r in hard_negatives.mine(frame, anchor_every=4).collect())
    assert got == brute_negatives(rows) and len(got) > 300


def test_hard_negatives_of_huge_vectors_and_empty_tables(spark):
    rows = [(i, [float(2 ** (18 + i % 3)), float(i), -float(2**17 + i)], i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(tuple(r[c] for c in NAMES) for r in hard_negatives.mine(frame, anchor_every=4).collect()) == brute_negatives(rows)
    assert hard_negatives.mine(frame.limit(0)).count() == 0
    beyond = spark.createDataFrame([(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [6e29, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(beyond).count() >= 0


def test_ball_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = np.floor(rng.normal(size=(400, 6)) * 300), np.floor(rng.normal(size=(20, 6)) * 300)
    tree = hard_negatives.BallTree(x, 10)
    low, high = tree.bounds(q)
    assert sorted(tree.order.tolist()) == list(range(400))
    for n, (begin, end, left, right) in enumerate(tree.nodes):
        s = q @ x[tree.order[begin:end]].T
        assert (low[:, n] <= s.min(1)).all() and (s.max(1) <= high[:, n]).all() and (left < 0) == (right < 0)


# Token alignment


def align_brute(texts):
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    byte = token_alignment.byte_of_character()
    rows = []
    for i, text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        spelled = [bytes(byte[c] for c in a_model.id_to_token(t)) for t in a], [bytes([int(p[3:5], 16)]) if b_model.is_byte(t) else p.replace("▁", " ").encode() for t, p in ((t, b_model.id_to_piece(t)) for t in b)]
        if any(b"".join(s) != (" " + (text or "")).encode() for s in spelled):
            rows.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        groups, p, q = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[p:m])) + "|" + ",".join(map(str, b[q:n])))
            p, q = m, n
        begin = [[0, *e[:-1]] for e in ends]
        links = []
        for u in range(len(a)):
            v = int(np.searchsorted(ends[1], begin[0][u], "right"))
            while v < len(b) and begin[1][v] < ends[0][u]:
                links.append((a[u], b[v]))
                v += 1
        rows.append((i, a, b, groups, links))
    held = Counter(x for _, _, _, _, links in rows for x in set(links))
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    return Counter((i, len(a), len(b), len(g), len(x), sum(held[y] == best[y[0]] for y in x), sum(held[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in rows), {i: ";".join(g) for i, _, _, g, _ in rows}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sizes", [{}, {"PORTION": 50, "REMEMBERED": 40, "LONGEST": 6, "TRANSITIONS": 10, "BLOCK_ROWS": 3, "BLOCK_LINKS": 25}])
def test_alignment_is_that_of_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(token_alignment, k, v)
    rng = random.Random(2)
    parts = ["the", " ", "  ", "\n", "token", "ization", "é", "naïve", "\t", "日本", "123", "'s", ".", " ", "end", "Über", "\r\n", "<s>", "😀"]
    texts = [*enumerate(ODD), *((100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(150)), (300, "again and again"), (300, "again and again"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, block int").repartition(3)
    got = token_alignment.align(frame, A, B).collect()
    want, groups = align_brute(texts)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == want
    assert all(r.groups == groups[r.doc_id] for r in got)


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_op13(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(i, t) for i, t in texts if len(t or "") < 6000]
    got = {r.doc_id: r for r in queries.queries()["op13_token_alignment"](spark, SF).collect()}
    assert set(got) == {i for i, _ in texts}
    _, groups = align_brute(short)
    for i, g in groups.items():
        assert got[i].groups_sha256 == (hashlib.sha256(g.encode()).hexdigest() if g else "") and got[i].n_groups == (len(g.split(";")) if g else 0)
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups and got[i].n_best <= got[i].n_links <= got[i].count_sum
