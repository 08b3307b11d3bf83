"""Merges of texts that differ in names alone are worked out once a task, with the results of each by itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arbordiff import api
from arbordiff.functions import kernels
from arbordiff.operators.patches import MODES, Options
from arbordiff.operators.terms import Space
from arbordiff.plans.golden import CASES, CONFLICTS
from arbordiff.sources import grammars

WANTED = frozenset({"status", "labels"})


def own(key: int, *texts: str) -> list[str]:
    return [re.sub("([a-z])", rf"\g<1>{key}", t) for t in texts]


@pytest.mark.parametrize("label,name,mode,a,o,b", CONFLICTS)
def test_names_alone_are_merged_once(monkeypatch, label, name, mode, a, o, b):
    merged = []
    monkeypatch.setattr(kernels, "merge_row", lambda *args, real=kernels.merge_row: merged.append(args) or real(*args))
    work = kernels.merges(name, Options(0, mode), WANTED)
    rows = [work(Space(), *own(k, a, o, b)) for k in range(5)]
    assert len(merged) == 1 and all(r["status"] == "conflicting" and label in r["labels"] for r in rows)


@pytest.mark.parametrize("mode", MODES)
def test_as_each_by_itself(mode):
    """Trees of few names, so that outlines meet, of which some are no trees."""
    draw = random.Random(4)

    def tree(height: int) -> str:
        kids = [tree(height - 1) for _ in range(draw.randrange(3))] if height else []
        return draw.choice("abc") + (f"[{','.join(kids)}]" if kids else "")

    triples = [[tree(2) for _ in range(3)] for _ in range(1500)] + [[a, o, b] for _, a, o, b, *_ in CASES] + [["a", "b]", "c"], ["b", "a]", "c"], [None, "a", "a"], ["a b", "a", "a"]]
    work = kernels.merges("rtree", Options(0, mode), WANTED)
    for t in triples:
        want = kernels.merge_row(Space(), "rtree", *t, None, Options(0, mode), WANTED)
        got = work(Space(), *t)
        assert (got["status"], got.get("labels")) == (want["status"], want.get("labels")), t
    again = [kernels.merge_row(Space(), "rtree", a, o, b, b, Options(0, mode), WANTED)["status"] for a, o, b in triples]
    assert [work(Space(), a, o, b, b)["status"] for a, o, b in triples] == again


def test_outlines():
    same = grammars.outline("rtree", "a[b,c]", "a", "b[c]")
    assert same == grammars.outline("rtree", "b[a,dd]", "b", "a[dd]")
    others = [("a[b,b]", "a", "b[b]"), ("a[b,c]", "b", "b[c]"), ("a[b,c]", "a", "b[d]"), ("a[b,c]", "a", None), ("a[b,c]\na", "b[c]"), ("a[b,c]", "a\nb[c]"), ("a[b, c]", "a", "b[c]"), ("0[1,2]", "0", "2[1]")]
    assert len({same, *(grammars.outline("rtree", *o) for o in others)}) == 1 + len(others)
    program = grammars.outline("while", "x := y + 1;")
    assert program == grammars.outline("while", "ab1 := c + 1;")
    assert program not in [grammars.outline("while", t) for t in ("x := y + 2;", "x := x + 1;", "skip := y + 1;", "x := true + 1;")]
    assert grammars.outline("lines", "a") is None


def test_whatever_holds_names_is_worked_out():
    work = kernels.merges("rtree", Options(), frozenset({"status", "merged"}))
    assert [work(Space(), f"x{k}[u]", f"x{k}[u,v]", f"x{k}[u,v]")["merged"] for k in range(3)] == [f"x{k}[u]" for k in range(3)]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(kernels, "OUTLINES", 3)
    work = kernels.merges("rtree", Options(0), WANTED)
    [known] = [c.cell_contents for c in work.__closure__ if isinstance(c.cell_contents, dict)]
    for n in range(9):
        assert work(Space(), "z", "b", f"y[{','.join('y' * n)}]" if n else "y")["status"] == "conflicting" and len(known) <= 3
    before = len(known)
    assert work(Space(), "z", "b", "y" * kernels.OUTLINED)["status"] == "conflicting" and len(known) == before


def test_another_parser_of_the_name_tells_no_names(monkeypatch):
    monkeypatch.setitem(grammars._parsers, "rtree", lambda space, text: grammars.rtree(space, text.lower()))
    assert grammars.outline("rtree", "a", "A") is None


def test_rows_dealt_before_and_columns_kept(spark):
    rows = spark.range(50).select("id", *[F.concat(F.lit(x), "id").alias(c) for x, c in zip("zby", "aob")])
    out = api.merge_triples(rows, "a", "o", "b", "rtree", min_height=0, columns=["labels"], deal=False, keep=["id"])
    assert out.columns == ["id", "status", "labels"] and "RoundRobin" not in out._jdf.queryExecution().toString()
    assert {(r.id, r.status, *r.labels) for r in out.collect()} == {(i, "conflicting", "not-eq") for i in range(50)}
