"""The pipeline against a brute-force version of each stage, on the smallest tables and on odd rows."""

import hashlib
import os
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from arbordiff.llm import bpe, decontaminate, toxicity
from test_operators import cleaned_brute

SF = "/root/testdata/sf0.001"


def similar_brute(rows):
    """The first row (smallest id, then as it comes) of each component of 5-word similarity 0.8 or more."""
    sets = []
    for r in rows:
        words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", (r["text"] or "").encode().lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    firsts = {}
    for i in order:
        firsts.setdefault(find(i), i)
    return [rows[i] for i in sorted(firsts.values())]


def repeats_brute(texts, length=400, n=51):
    """What is left of each text without strings of `length` bytes or n words that occur more than once; None where only blanks are left."""
    raw = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t)] for t in raw]
    words = [[t[a:b] for a, b in p] for t, p in zip(raw, places, strict=True)]
    strings = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    runs = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for text, t, p, w in zip(texts, raw, places, words, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if strings[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for i in range(len(w) - n + 1):
            if runs[tuple(w[i : i + n])] > 1:
                a, b = p[i][0], p[i + n - 1][1]
                gone[a:b] = b"\1" * (b - a)
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf8", "ignore")
        out.append(text if not any(gone) else left if left.strip() else None)
    return out, [o is None and t is not None for o, t in zip(out, texts, strict=True)]


def check_stages(spark, sf_dir, tmp_path):
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [("" if r.item_id is None else r.item_id, r.text) for r in bench.collect()]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        toxic = Counter(r.doc_id for r in toxicity.toxicity(docs, labels).where("score >= 0.5").collect()) if name == "toxicity" else None
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / f"{n}"))
        docs = spark.read.parquet(path)
        after = [r.asDict() for r in docs.collect()]
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == read.columns
        if name == "toxicity":
            want = [r for r in before if r["doc_id"] not in toxic]
        elif name == "near_duplicates":
            want = similar_brute(before)
        elif name == "repeated_strings":
            texts, emptied = repeats_brute([r["text"] for r in before])
            want = [{**r, "text": t, "n_chars": r["n_chars"] if t == r["text"] else len(t)} for r, t, e in zip(before, texts, emptied, strict=True) if not e]
        elif name == "benchmark":
            texts = [r["text"] and cleaned_brute(r["text"], items, 10, 0.5) for r in before]
            want = [{**r, "text": t, "n_chars": r["n_chars"] if t == r["text"] else len(t)} for r, t in zip(before, texts, strict=True) if t is not None or r["text"] is None]
        else:
            ids = [reference.encode_ordinary(r["text"] or "") for r in before]
            want = [{"doc_id": r["doc_id"], "ids": i, "n_tokens": len(i), "ids_sha256": hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256((r["text"] or "").encode()).hexdigest()} for r, i in zip(before, ids, strict=True)]
        assert sorted(map(repr, want)) == sorted(map(repr, after)), name
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, (r.asDict() for r in whole.collect()))) == sorted(map(repr, after))
    return after


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    assert len(check_stages(spark, SF, tmp_path)) > 100


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, copies, passages, and columns whose names the operators use inside."""
    passage = " ".join(f"p{i}" for i in range(60))
    item = "one two three four five six seven eight nine ten eleven"
    own = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(12)]
    texts = [None, "", " \n", "word", own[0], own[0], own[1] + " " + passage, passage + "\n" + own[2], own[3] + " " + item + " " + own[4], item + " short", "é" * 300_000 + " " + own[5], own[6].replace("w6x40 ", ""), own[6], None]
    rows = [(i, t, None if i % 4 == 0 else "en", None, None if t is None else len(t), i, "s", None, "x") for i, t in enumerate(texts)] + [(4, own[0], None, None, 1, 4, "s", None, "x"), (None, own[7], "en", "s", None, 1, None, 2, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, _r string, _spans int, _state string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.createDataFrame([(0, 1, None), (None, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf/labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, ""), (1, item)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    after = check_stages(spark, str(tmp_path / "sf"), tmp_path)
    assert {r["doc_id"] for r in after} >= {3, 4, 6, 7, 8, 10, 11, None} and 9 not in {r["doc_id"] for r in after}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_passage_is_left(spark):
    """What the pipeline keeps of a contaminated document has no window of the benchmark."""
    docs = spark.createDataFrame([(1, "a b c d e f g h " + " ".join(f"i{k}" for k in range(30)), "", "", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, "b c d e f g h i0 i1 i2")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench, window=10)
    assert decontaminate.match_benchmark(left, bench).where("contaminated").count() == 0 and left.count() == 1
