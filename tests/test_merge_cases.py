"""Merges of several cases of one base: the results of merge_experiment, with each difference from the base made once."""

from pyspark.sql import functions as F

from arbordiff.operators import merging
from arbordiff.operators.terms import Space
from arbordiff.plans import experiments
from arbordiff.sources.grammars import grammar

CASES = [
    ("disjoint", "[9, 2, 3]", "[1, 2, 8]", "[9, 2, 8]"), ("conflict", "[9, 2, 3]", "[8, 2, 3]", "[9, 2, 3]"), ("same", "[9, 2, 3]", "[9, 2, 3]", "[9, 2, 3]"), ("other", "[9, 2, 3]", "[1, 2, 3]", "[1]"),
    ("broken", "[9, 2", "[1, 2, 3]", None), ("none", None, "[1, 2, 3]", None), ("free", "[9, 2, 3]", "[1, 2, 8]", None),
]


def test_cases_are_the_merges_of_their_triples(spark):
    bases = spark.createDataFrame([(i, o, CASES) for i, o in enumerate(["[1, 2, 3]", "[4, 2, 3]", "[", None])] + [(9, "[1]", None)], "id int, o string, cases array<struct<kind:string,a:string,b:string,m:string>>")
    found = experiments.merge_cases(bases, "o", "cases", "json", min_height=0)
    triples = bases.select("o", F.explode("cases").alias("x")).select("o", "x.*")
    alone = experiments.merge_experiment(triples, "json", min_height=0, columns=["status"]).select("kind", "result")
    key = lambda r: (r.kind, r.result)
    assert sorted(map(key, found.collect())) == sorted(map(key, alone.collect()))
    assert {r.result for r in found.where("kind = 'conflict'").collect()} >= {"conf", "parse-error"}


def test_a_difference_is_made_once(monkeypatch):
    made, diff = [], merging.diff
    monkeypatch.setattr(merging, "diff", lambda *x: made.append(x) or diff(*x))
    space, known = Space(), {}
    o, a, b = (grammar("lines")(space, t) for t in ("x\ny\nz", "1\ny\nz", "x\ny\n2"))
    assert merging.merge3(space, a, o, b, known=known)[0] == "success"
    assert merging.merge3(space, a, o, a, known=known)[0] == "success"
    assert len(made) == 2
