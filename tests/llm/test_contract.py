"""The contract queries on the smallest tables: against their SQL where there is one, against brute force or the contract's figures else."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_operators import components_brute, greedy, print_brute

from arbordiff.llm import bpe, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
RUN = queries.queries()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql_gives_the_same(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = RUN[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


def test_op3(spark):
    got = RUN["op3_url_filter"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id for r in got} == set(urls)
    for r in got:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        best = max(((len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]) and r.verdict == (best[2] if best else "allow")


def test_op4(spark, texts):
    words = {i: [*low(t).encode().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in RUN["op4_language_model"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(words[i]), sum(counts[w] > 0 for w in words[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[i]))
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op5(spark, texts):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(queries.RANKS))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in RUN["op5_byte_bpe"](spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert tuple(r) == (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


@pytest.mark.parametrize("name,threshold", [("op6_toxicity", 0.5), ("op7_quality", 0.3)])
def test_op6_and_op7(spark, texts, name, threshold):
    got = RUN[name](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)


def test_op8(spark, texts):
    vocabulary = set(bpe.read_ranks(queries.RANKS))
    for r in RUN["op8_token_counts"](spark, SF).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_pieces) == (len(words), sum(greedy(b" " + w, vocabulary) for w in words))


def test_op9(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got: dict = {}
    for r in RUN["op9_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in (i for i in rows if i % 20 == 0):
        near = sorted((-float((rows[q] * v).sum()), i) for i, v in rows.items() if i != q)[:20]
        assert sorted(got[q]) == [*range(1, len(near) + 1)] and all(s == float((rows[q] * rows[i]).sum()) for i, s in got[q].values())
        hits += len({i for _, i in near} & {i for i, _ in got[q].values()})
        total += len(near)
    assert hits >= 0.9 * total


def test_op10(spark, texts):
    ids = sorted(texts)
    prints = [print_brute(texts[i]) for i in ids]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in RUN["op10_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, components_brute(prints, ids), strict=True)}
