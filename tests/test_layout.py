"""Layout over lines: fixed texts, widths kept, one line as before."""

import random
import re

import pytest

from arbordiff import api
from arbordiff.operators import layout, merging, patches
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import Space, render
from arbordiff.sources import grammars


def random_tree(rng, depth):
    name = rng.choice(["a", "bb", "ccc"])
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return name + (f"[{','.join(kids)}]" if kids else "")


def test_fixed_texts():
    space = Space()
    t = grammars.while_(space, "if a < 1 then x := a + 2; else skip;")
    assert layout.pretty(t, 200) == render(t)
    tree = grammars.rtree(space, "root[leaf,leaf]")
    assert layout.pretty(tree, 40) == '(:>:\n  "root"\n  (:\n    (:>: "leaf" [])\n    (: (:>: "leaf" []) [])))'
    change = patches.Change(space.hole(0, "RTree"), space.roll("RTree", ":>:", [space.prim("String", "a rather long label"), space.hole(1, "[RTree]")]))
    assert layout.pretty(change, 30) == '{{-\n  #0\n  -}\n  {+\n  (:>:\n    "a rather long label"\n    #1)\n  +}}'
    assert layout.pretty(change) == '{{- #0 -} {+ (:>: "a rather long label" #1) +}}' == patches.show_change(change)


@pytest.mark.parametrize("seed", range(20))
def test_breaks_are_the_only_difference(seed):
    rng, space = random.Random(seed), Space()
    a, b = (grammars.rtree(space, random_tree(rng, 4)) for _ in range(2))
    patch = patches.diff(space, a, b, Options())
    for tree, flat in ((a, render(a)), (patch, patches.show(patch))):
        assert layout.pretty(tree, 10**9) == flat
        for width in (1, 20, 80):
            text = layout.pretty(tree, width)
            assert re.sub(r"\n *", " ", text) == flat
            # a line that is too long holds nothing that could have been broken
            assert all(len(line) <= width or " " not in re.sub(r'"[^"]*"', "", line.strip()) for line in text.split("\n"))


def test_conflicts_and_long_lists():
    space = Space()
    a, o, b = (grammars.rtree(space, t) for t in ("z", "b", "y"))
    both = merging.merge(space, *(patches.diff(space, o, t, Options()) for t in (a, b)))
    [conflict] = merging.conflicts(both)
    assert re.sub(r"\n *", " ", layout.pretty(both, 20)).count(merging.show_conflict(conflict)) == 1
    long = layout.pretty(grammars.lines(space, "x\n" * 20_000))
    assert max(map(len, long.split("\n")[:-1])) < 80 and long.count("Line") == 20_000


def test_pairs_are_shown(spark):
    frame = spark.createDataFrame([(1, "a[b]", "a[c]"), (2, "a[", "a"), (3, "a", None)], "id int, src string, dst string")
    got = {r.id: r for r in api.show_pairs(frame, "src", "dst", "rtree", 30).collect()}
    assert got[1].tree_text.startswith("(:>:") and "\n" in got[1].patch_text and got[2].parse_error and got[3].patch_text is None
