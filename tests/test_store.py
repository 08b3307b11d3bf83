"""The content-addressed store and line trees without Python workers, against the kernel."""

import random

from arbordiff import api
from arbordiff.functions import kernels
from arbordiff.operators import patches, sharing, store
from arbordiff.operators.patches import MODES, Options
from arbordiff.operators.terms import HOLE, Space, digests, preorder
from arbordiff.sources import grammars

LINES = ["a\nb\nc", "", "\n", "x", None, "a\nb\nc\n", "q\n" * 37, "é\n\n😀\nz", "b\nc", "\r\n", "\0\n\0"]


def test_line_trees_are_those_of_the_kernel(spark):
    grammars.register_grammar("lines-by-kernel", lambda space, text: grammars.lines(space, text))
    frame = spark.createDataFrame(list(enumerate(LINES)), "tree_id long, text string")
    columns = [*kernels.NODE]
    native, kernel = (kernels.node_table(frame, "text", g, columns) for g in ("lines", "lines-by-kernel"))
    plan = native._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    assert sorted(map(str, native.collect())) == sorted(map(str, kernel.collect()))
    only = ["digest", "height"]
    assert sorted(map(str, kernels.node_table(frame, "text", "lines", only).collect())) == sorted(map(str, kernels.node_table(frame, "text", "lines-by-kernel", only).collect()))
    assert kernels.node_table(frame.limit(0), "text", "lines", only).count() == 0


def random_tree(rng, depth):
    name = rng.choice("abc")
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return name + (f"[{','.join(kids)}]" if kids else "")


def test_each_subtree_is_stored_once(spark):
    rng = random.Random(5)
    texts = [random_tree(rng, 4) for _ in range(25)]
    found = store.build(spark.createDataFrame([*enumerate(texts)], "tree_id long, text string"), "text", "rtree", with_content=True)
    space, want, kids = Space(), set(), {}
    for t in texts:
        tree = grammars.rtree(space, t)
        names = digests(tree)
        for x in preorder(tree):
            want.add(names[id(x)])
            kids[names[id(x)]] = [names[id(k)] for k in x.kids]
    rows = found.subtrees.collect()
    assert {r.digest for r in rows} == want and len(rows) == len(want)
    assert all(r.kids == kids[r.digest] for r in rows)
    assert found.roots.count() == 25


def test_holes_of_pairs_meet_by_digest(spark):
    rng = random.Random(6)
    texts = [random_tree(rng, 4) for _ in range(20)] + ["a[b,c]", "a[b,c]"]
    pairs = [(f"{i}-{j}", i, j) for i in range(len(texts)) for j in range(i) if rng.random() < 0.3] + [("same", 20, 21), ("itself", 3, 3)]
    trees = store.build(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "text", "rtree", "doc_id")
    frame = spark.createDataFrame(pairs, "pair_id string, src_id long, dst_id long")
    shares = trees.sharing(frame)
    for mode in MODES:
        got: dict = {}
        for r in sharing.holes(trees.candidates(shares), mode).collect():
            got.setdefault((r.pair_id, r.side), []).append((r.node_id, r.height))
        for name, i, j in pairs:
            if i == j:
                continue  # a tree against itself has twice its own arity, whatever the collection
            space = Space()
            x, y = grammars.rtree(space, texts[i]), grammars.rtree(space, texts[j])
            _, d, s = patches.extract(space, x, y, Options(mode=mode))
            for side, whole, cut in (("src", x, d), ("dst", y, s)):
                want, stack = [], [(whole, cut, 0)]
                while stack:
                    w, c, n = stack.pop()
                    if c.kind == HOLE:
                        want.append((n, w.height))
                    else:
                        n += 1
                        for k, m in zip(w.kids, c.kids, strict=True):
                            stack.append((k, m, n))
                            n += k.size
                assert sorted(got.get((name, side), [])) == sorted(want)


def test_store_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, "a[b"), (None, "a[b]"), (2, None), (3, "a[b]"), (3, "a[b]")], "tree_id long, text string")
    found = store.build(frame, "text", "rtree", with_content=True)
    assert {r.tree_id for r in found.roots.collect()} == {3}
    assert found.subtrees.where("kind = 'prim'").count() == 2
    empty = store.build(frame.limit(0), "text", "rtree", with_content=True)
    assert empty.subtrees.count() == 0 and empty.shared_subtrees().count() == 0
    assert api.tree_nodes(frame, "text", "rtree").columns == ["tree_id", *kernels.PLAIN]
