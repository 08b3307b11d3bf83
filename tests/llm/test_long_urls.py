"""Mined rules of very long urls."""

import time

from arbordiff.llm import url_filter


def test_long_urls_are_mined_in_seconds(spark):
    long = "http://bad.example.org/" + "/".join(f"s{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzABCD'[i // 100]}" for i in range(1000))
    rows = [(long, True)] * 30 + [(f"http://ok.example.org/x{chr(97 + i % 26)}", False) for i in range(60)] + [("http://one.example.net/" + "/".join(f"q{i}z" for i in range(300)), True)]
    labels = spark.createDataFrame(rows, "url string, bad boolean")
    began = time.time()
    rules, alike = url_filter.mine(labels.select(url_filter.tokens_of(labels.url).alias("tokens"), "bad"))
    assert time.time() - began < 60
    assert {tuple(r["tokens"]) for r in rules} >= {("p:saku",)} and all(len(r["tokens"]) == 1 and r["confidence"] >= 0.9 for r in rules) and not alike


def test_tokens_on_the_same_urls_stand_for_each_other(spark):
    """Two groups of 40 tokens, harmless alone and bad together."""
    left, right = [f"l{i:02}" for i in range(40)], [f"r{i:02}" for i in range(40)]
    rows = [(left + right, True)] * 30 + [(left, False)] * 30 + [(right, False)] * 30
    rules, alike = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert rules == [{"tokens": ["l00", "r00"], "count": 30, "confidence": 1.0}]
    assert alike == {t: "l00" for t in left[1:]} | {t: "r00" for t in right[1:]}
    names = [a + b for a in "abcdefgh" for b in "vwxyz"]
    both, one, two = (["u" + n for n in names] + ["v" + n for n in names], ["u" + n for n in names], ["v" + n for n in names])
    frame = spark.createDataFrame([(i, "http://h.org/" + "/".join(t)) for i, t in enumerate((both, one, two, ["uav", "vhz"], ["uav", "ubv"]))], "page_id long, url string")
    labels = spark.createDataFrame([("http://h.org/" + "/".join(both), True)] * 30 + [("http://h.org/" + "/".join(one), False)] * 30 + [("http://h.org/" + "/".join(two), False)] * 30, "url string, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(frame, labels, []).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow"}
