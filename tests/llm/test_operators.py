"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and
columns whose names the operators use inside."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from arbordiff.llm import bpe, decontaminate, language_model, neighbours, quality, queries, repeats, simhash, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = "doc_id long, text string, _r string, _spans string, _state int, _row string, row int, starts int, n_chars long, label int, leaf int, v string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, first)], DOCS)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "r", "i", 1, "k", 2, 3, 4, 5, 6, "v") for i, t in enumerate(texts)], CLASH)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


TEXTS = [None, "", " \t\n", "word", "Two Words", "É É é", "a" * 5000, "x y " * 3000, "same text here now", "same text here now"]


# 1


def items_brute(doc, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(doc))
    hit, met = set(), set()
    for i, text in items:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        k = min(window, len(ws))
        wins = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
        for p in range(len(words) - k + 1) if k else ():
            if tuple(words[p : p + k]) in wins:
                hit.update(range(p, p + k))
                met.add(str(i))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices("abcd", k=rng.choice([0, 1, 2, 5, 8])))) for i in range(8)] + [(20, None), (None, "d d d d"), (3, "a b a b")]
    texts = [*TEXTS, *(" ".join(rng.choices("abcde", k=30)) for _ in range(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.match_benchmark(docs(spark, texts), bench, window=4).collect()
    assert len(got) == len(texts)
    known = [("" if i is None else i, t) for i, t in items]
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == items_brute(texts[r.doc_id], known, 4)
    cleaned = decontaminate.decontaminate(docs(spark, texts), bench, window=4, max_coverage=0.9)
    for r in cleaned.collect():
        if r.text is not None:
            assert not items_brute(r.text, known, 4)[1] and r.n_chars == len(r.text)
        if not items_brute(texts[r.doc_id], known, 4)[1]:
            assert r.text == texts[r.doc_id]
    assert cleaned.columns == docs(spark, texts).columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.match_benchmark(clashing(spark, texts), empty).where("contaminated").count() == 0
    assert decontaminate.match_benchmark(docs(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(clashing(spark, texts), empty).count() == len(texts)


def cleaned_brute(text, items, window, most):
    """Rounds over all items together; None if the document goes."""
    total = hit = 0
    while True:
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))]
        words = [low(text)[a:b] for a, b in places]
        total = total or len(words)
        hits = set()
        for _, t in items:
            ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
            k = min(window, len(ws))
            wins = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
            hits.update(q for p in range(len(words) - k + 1) if k and tuple(words[p : p + k]) in wins for q in range(p, p + k))
        hit += len(hits)
        if hit > most * total:
            return None
        if not hits:
            return text
        spans, left, kept = decontaminate._union((q, q + 1) for q in hits), 0, []
        for a, b in spans:
            kept.append(text[left : places[a][0]])
            left = places[b - 1][1]
        text = " ".join([*kept, text[left:]])


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_coverage_counts_all_blocks_together(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    items = [(1, "one two three four five six seven eight nine ten"), (2, "red blue green pink grey black white gold brown lime"), (3, "a b a b"), (4, "c"), (5, None)]
    word = [f"w{i}" for i in range(50)]
    texts = [items[0][1] + " " + " ".join(word[:15]) + " " + items[1][1], items[0][1] + " " + " ".join(word[:15]), *TEXTS]
    texts += [" ".join(rng.choices(["a", "b", *word[:3]], k=25)) + rng.choice(["", " " + items[0][1], " c"]) for _ in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs(spark, texts), bench, window=10, max_coverage=0.5).collect()}
    want = {i: t and cleaned_brute(t, items, 10, 0.5) for i, t in enumerate(texts)}
    assert got == {i: t for i, t in want.items() if t is not None or texts[i] is None}
    assert 0 not in got and 1 in got


# 2


def repeats_brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int(np.sum(np.diff(gone.astype(int), prepend=0) == 1)), kept))
    return out


@pytest.mark.parametrize("hot", [8000, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(25))
    texts = [*TEXTS, "ab" * 200, "abc" * 60 + "x" + "abc" * 60]
    for k in range(24):
        own = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(2)]
        texts.append(f"{own[0]}{passage[k % 5:] if k % 3 else passage[: 40 + k]}{own[1]}")
    texts += texts[-3:]
    want = repeats_brute(texts, 40)
    got = repeats.remove_repeats(docs(spark, texts), length=40, gram=20).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    cut = {r.doc_id: r for r in repeats.drop_repeats(docs(spark, texts), length=40, gram=20).collect()}
    for i, t in enumerate(texts):
        if not want[i][1]:
            assert cut[i].text == t
        elif i in cut:
            assert cut[i].text == want[i][3].decode("utf8", "ignore") and cut[i].n_chars == len(cut[i].text)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    assert repeats.remove_repeats(clashing(spark, texts), length=40, gram=20).count() == len(texts)
    assert repeats.drop_repeats(clashing(spark, texts), length=40, gram=20).columns == clashing(spark, texts).columns


def test_interval_expansion():
    rng = random.Random(5)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab\0\xff") if rng.random() < 0.3 else 97 for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        n = rng.choice([14, 15, 20, 30])
        seen = Counter(s[i : i + n] for s in parts for i in range(len(s) - n + 1))
        for s, found in zip(parts, repeats.repeated_starts(parts, n), strict=True):
            assert found.tolist() == [seen[s[i : i + n]] > 1 for i in range(len(s) - n + 1)]


# 3


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?x=1", "http://example.com/en/8#t", "http://xexample.com/en/7", "https://a.net/de/8", "https://a.example.net/de/8/z", "https://example.net?/de/8",
            "ftp://x.org/es/1", "http://com/en/", "a://b://c.com/en/", "http://bad-site.example.org/q", "http://bad-site.example.org/q"]
    frame = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    labels = spark.createDataFrame([(f"http://bad-site.example.org/{i}", True) for i in range(30)] + [(f"http://good{i % 3}.example.org/{i}", False) for i in range(30)] + [(None, True)], "url string, bad boolean")
    got = url_filter.filter_urls(frame, labels, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        best = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[2] if best else "block" if "bad-site" in host else "allow")
    none = spark.createDataFrame([], "url string, bad boolean")
    assert {r.verdict for r in url_filter.filter_urls(frame.limit(3), none, rules).collect()} == {"allow"}
    assert url_filter.filter_urls(frame.limit(0), labels, rules).count() == 0
    clash = frame.withColumnRenamed("host", "_fits").withColumnRenamed("path", "mined")
    assert url_filter.filter_urls(clash, labels, rules).columns == ["page_id", "url", "_fits", "mined", "rule", "host", "path", "verdict"]


def test_mined_rules(spark):
    """All rules of up to three tokens, against counting every combination."""
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        tokens = sorted(rng.sample("abcdefgh", rng.randint(0, 6)))
        rows.append((tokens, {"a", "b"} <= set(tokens) or "c" in tokens and "d" in tokens and "e" in tokens or rng.random() < 0.02))
    rows += [([f"s{i}" for i in range(25)], True)] * 30 + [(["x", *(f"s{i}" for i in range(1, 25))], False)] * 30  # long urls, many times
    got = {tuple(r["tokens"]): (r["count"], r["confidence"]) for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))}
    n, bad = Counter(), Counter()
    for tokens, is_bad in rows:
        for size in (1, 2, 3):
            for c in combinations(sorted(tokens), size):
                n[c] += 1
                bad[c] += is_bad
    want = {}
    for c in sorted(n, key=lambda c: (len(c), c)):
        if bad[c] >= 10 and bad[c] >= 0.9 * n[c]:
            if not any(p in want and want[p][1] >= bad[c] / n[c] for size in range(1, len(c)) for p in combinations(c, size)):
                want[c] = (n[c], bad[c] / n[c])
    assert got == want and ("a", "b") in got and ("s0",) in got and ("s1",) not in got


def test_page_labels(spark):
    """A host whose pages' documents are bad is blocked."""
    pages = spark.createDataFrame([(i, f"http://{'ill' if i % 3 == 0 else 'well'}.example.net/en/{i}?a=1") for i in range(90)] + [(900, None), (901, "http://ill.example.net/x")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)] + [(1, None, None), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    marked = queries.page_labels(pages, labels)
    assert Counter((r.url.split(".")[0][7:], r.bad) for r in marked.collect()) == {("ill", True): 20, ("well", False): 40}
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, marked, []).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(90)} | {900: "allow", 901: "block"}


# 4


def test_language_model(spark):
    rng = random.Random(4)
    tongues = [["aa", "ab", "ac", "ad"], ["ba", "bb", "bc", "bd"]]
    texts = [*TEXTS, *(" ".join(rng.choices(tongues[k % 2], k=rng.randint(5, 60))) for k in range(200))]
    texts += ["w" * 100 + " " + "v" * 64 + " u" * k for k in range(9)] + [" ".join(rng.choices("pqrs", k=30_000))]  # long words, a long text
    got = language_model.score(docs(spark, texts)).collect()
    counts: Counter = Counter()
    words = lambda t: [*(w for w in re.split(r"[\x20\x09-\x0d]+", low(t)) if w), ""]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        ws = words(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got if r.held_out and r.doc_id >= len(TEXTS)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score(docs(spark, [])).count() == 0
    assert language_model.score(clashing(spark, TEXTS)).count() == len(TEXTS)
    for kind in ("int", "string"):
        again = language_model.score(docs(spark, texts).withColumn("doc_id", language_model.F.col("doc_id").cast(kind)))
        assert dict(again.dtypes)["doc_id"] == kind and {(int(r.doc_id), r.n_tokens, r.n_known) for r in again.collect()} == {(r.doc_id, r.n_tokens, r.n_known) for r in got}


@pytest.mark.parametrize("sent", [3, 1 << 17])
def test_vocabulary_has_a_bound(spark, monkeypatch, sent):
    """However many words there are of one count, as many go to the workers as have room; what they count doesn't change."""
    monkeypatch.setattr(language_model, "SENT", sent)
    texts = [f"{a}{b} {a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    got = language_model.score(docs(spark, texts)).collect()
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    n, v = 3 * len(train), len(train) + 1
    for r in got:
        c = [2 * (texts[r.doc_id] in train)] * 2 + [len(train)]
        assert r.n_known == 2 * (texts[r.doc_id] in train) + 1
        assert r.base_score == pytest.approx(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c))


def test_language_model_gives_probabilities():
    """What follows a text has a total probability of 1: all symbols, other words by their class."""
    vocabulary = language_model.Vocabulary([b"", b"a", b"b"], np.array([2.0, 3, 1]), 8, 5, np.ones(language_model.OTHERS), np.ones(language_model.OTHERS))
    network = language_model.Network(vocabulary)
    texts = [np.array([1, 2, 1, 0]), np.array([2, 2050, 0])] * 20
    network.train(texts, 2)
    h = network.states(np.array([[0], [1], [2]]), np.zeros((3, 1), np.float32), np.zeros((1, language_model.UNITS), np.float32))[-1]
    symbols = np.arange(language_model.Network.SYMBOLS)
    logs, _ = network.log_probabilities(np.repeat(h, len(symbols), 0), symbols)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


# 5 and 8


def test_bpe(spark, monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = [*TEXTS, "it's we'll 12 345!!  a  b\n\n c\t", " " * 700 + "x", "ab" * 900, "<|endoftext|>", "日本語のテキスト" * 40, "a\u00a0b \u3000c\x1c d", *("".join(rng.choices("abcdef é!1\n '", k=rng.randint(0, 400))) for _ in range(60))]
    monkeypatch.setattr(bpe, "PORTION", 300)
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for t, runs in zip(texts, encoder.encode([t or "" for t in texts]), strict=True):
        assert [int(i) for r in runs for i in r] == ref.encode_ordinary(t or "")
    got = bpe.digests(docs(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, raw = ref.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert bpe.digests(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.digests(clashing(spark, texts), RANKS, public_tokenizers.PATTERN).count() == len(texts)


def greedy(word, vocabulary):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocabulary), None)
        if j is None:
            return -1
        i, n = j, n + 1
    return n


def test_longest_match():
    rng = random.Random(8)
    for _ in range(400):
        vocabulary = {bytes(rng.choices(b"abcd", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
        word = bytes(rng.choices(b"abcde", k=rng.randint(0, 14)))
        assert token_counts.LongestMatch(list(vocabulary)).count(word) == greedy(word, vocabulary)


def test_token_counts(spark):
    vocabulary = set(bpe.read_ranks(RANKS))
    got = token_counts.count_pieces(clashing(spark, TEXTS), RANKS).collect()
    for r in got:
        words = (TEXTS[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(greedy(b" " + w, vocabulary) for w in words), 0)
    assert len(got) == len(TEXTS) and token_counts.count_pieces(docs(spark, []), RANKS).count() == 0


# 6 and 7


def labelled(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(700):
        toxic, good = i % 6 == 0, i % 5 != 0
        ws = [word() for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vile", "zqx" + word()]))
        if not good:
            ws = [w for w in ws[:8] for _ in range(9)] + (["vile"] * 2 if toxic else [])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), labels[0]]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark):
    rows, labels, known = labelled(spark, 1)
    got = toxicity.toxicity(rows, labels).collect()
    truth = {i: t for i, _, t in known if t is not None}
    held = [r for r in got if r.held_out]
    assert len(got) == 700 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}
    none = labels.limit(0)
    out = toxicity.toxicity(clashing(spark, TEXTS), none).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    assert toxicity.toxicity(rows.limit(0), labels).count() == 0


def test_quality(spark):
    rows, labels, known = labelled(spark, 2)
    got = quality.quality(rows, labels).collect()
    truth = {i: q for i, q, _ in known if q is not None}
    held = [r for r in got if r.held_out]
    assert len(got) == 700 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    out = quality.quality(clashing(spark, TEXTS), labels.limit(0)).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert quality.quality(rows.limit(0), labels).count() == 0


# 9


def nearest_brute(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        out[q] = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:k]
    return out


@pytest.mark.parametrize("n,chunk", [(12, 4096), (900, 64)])
def test_neighbours(spark, monkeypatch, n, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.4, 8)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(i, [1.0] * 8) for i in range(n, n + n // 3)]  # equal vectors
    rows += [(100_000, None), (100_020, [0.0] * 8), (100_040, [math.nan] * 8), (100_060, [None] * 8), (None, [1.0] * 8), (100_080, [1.0]), (100_100, [math.inf] * 8), rows[0]]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, leaf int, v string")
    want, got = nearest_brute(rows, 20), {}
    for r in neighbours.search(frame, 20, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert neighbours.search(frame.limit(0)).count() == 0


def test_neighbours_of_each_length(spark):
    """Vectors of several lengths, and several vectors of one id, all take part."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(90)] + [(20, rng.normal(size=3).tolist()), (7, rng.normal(size=4).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r.vec_id, r.score) for r in neighbours.search(frame, 20, 5, recall=1.0).collect())
    want = Counter()
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))
            want.update((q, i, s) for s, i in ((-s, i) for s, i in near[:5]))
    assert Counter((q, i, round(s, 9)) for (q, i, s), c in got.items() for _ in range(c)) == Counter((q, i, round(s, 9)) for (q, i, s), c in want.items() for _ in range(c))


# 10


def print_brute(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low(text)) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(prints))]


def test_simhash(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    texts = list(TEXTS)
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(400)] = "zz"
        texts.append(" ".join(t))
    texts += [" ".join(rng.choices(base, k=rng.randint(1, 40))) for _ in range(60)]
    frame = docs(spark, texts).repartition(3)
    got = sorted(simhash.near_duplicates(frame).collect(), key=lambda r: r.doc_id)
    prints = [print_brute(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == components_brute(prints, list(range(len(texts))))
    assert sorted(r.doc_id for r in got if r["first"]) == sorted({r.component_id for r in got})
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(clashing(spark, TEXTS)).count() == len(set(components_brute(prints[: len(TEXTS)], list(range(len(TEXTS))))))
    twice = docs(spark, ["one row of text"] * 2).withColumn("doc_id", simhash.F.lit(7).cast("long"))
    assert simhash.drop_near_duplicates(twice).count() == 1


@pytest.mark.parametrize("refine,dense", [(2048, 50_000), (2, 50_000), (2, 6)])
def test_links_of_close_fingerprints(spark, monkeypatch, refine, dense):
    """Many fingerprints around a few centres: whatever the partitions, the components are those of all pairs."""
    monkeypatch.setattr(simhash, "REFINE", refine)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(refine)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    from arbordiff.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    assert [roots.get(p, p) for p in signed] == components_brute(prints, signed)
