"""Canonical patches, and the index of patches, against pairwise tests."""

import random

from arbordiff import api
from arbordiff.operators import patch_index, patches
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import Space
from arbordiff.sources import grammars


def random_tree(rng, depth):
    name = rng.choice("ab")
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 2))] if depth else []
    return name + (f"[{','.join(kids)}]" if kids else "")


def some_patches(rng, n):
    out = []
    for _ in range(n):
        space = Space()
        a, b = (grammars.rtree(space, random_tree(rng, 3)) for _ in range(2))
        out.append(patches.encode_patch(patches.diff(space, a, b, Options(min_height=rng.choice([0, 1]), mode=rng.choice(patches.MODES), global_scope=rng.random() < 0.4))))
    return out


def test_all_that_applies_is_found(spark):
    rng = random.Random(9)
    texts = [random_tree(rng, 3) for _ in range(60)] + ["a", "b", "a[b,b]"]
    made = some_patches(rng, 40)
    space = Space()
    x, y = space.hole(0, "RTree"), space.hole(1, "RTree")

    def tree(label, *kids):
        return space.roll("RTree", ":>:", [space.prim("String", label), space.list("RTree", kids)])

    made += [patches.encode_patch(c) for c in (patches.Change(x, x), patches.Change(tree("a", x, x), tree("b", x)), patches.Change(tree("a", x, y), tree("a", y, x)), patches.Change(tree("a", x), tree("b", y)))]
    changes = spark.createDataFrame([*enumerate(made)] + [(1000, None), (1001, "not a patch")], "patch_id long, patch string")
    trees = spark.createDataFrame([*enumerate(texts)] + [(500, None), (501, "a[")], "tree_id long, text string")
    for levels in (1, 3):
        got = {(r.patch_id, r.tree_id): (r.status, r.result) for r in patch_index.applicable(changes, trees, "rtree", levels).collect()}
        want = {}
        for i, p in enumerate(made):
            for j, t in enumerate(texts):
                space = Space()
                try:
                    out = patches.apply(space, patches.decode_patch(space, p), grammars.rtree(space, t))
                except ValueError:
                    want[i, j] = "error", None
                else:
                    if out is not None:
                        want[i, j] = "success", grammars.unparse_rtree(out)
        assert got == want and len(want) > 63


def test_empty_index(spark):
    changes, trees = spark.createDataFrame([], "patch_id long, patch string"), spark.createDataFrame([(1, "a")], "tree_id long, text string")
    assert patch_index.applicable(changes, trees, "rtree").count() == 0


def test_a_tree_offers_what_a_fitting_patch_demands():
    rng = random.Random(3)
    for p in some_patches(rng, 30):
        space = Space()
        change = patches.distribute(space, patches.decode_patch(space, p))
        for _ in range(20):
            t = grammars.rtree(space, random_tree(rng, 3))
            try:
                fits = patches.apply_change(space, change, t) is not None
            except ValueError:
                fits = True
            if fits:
                assert set(patch_index.demands(change.delete)) <= set(patch_index.offers(t))


def test_equal_up_to_names_is_equal_by_digest(spark):
    rng = random.Random(12)
    made = some_patches(rng, 30)
    renamed = []
    for p in made:
        space = Space()
        q = patches.decode_patch(space, p)
        names = sorted(patches.variables(q))
        other = dict(zip(names, rng.sample(range(100, 200), len(names)), strict=True))
        renamed.append(patches.encode_patch(patches.map_leaves(q, lambda c: patches.Change(*(space.replace(t, lambda h: space.hole(other[h.con], h.dtype)) for t in (c.delete, c.insert))))))
    frame = spark.createDataFrame([*enumerate(made + renamed)], "id int, patch string")
    rows = {r.id: r for r in api.canonical_patches(frame, "patch").collect()}
    for i in range(30):
        assert rows[i].patch_digest == rows[30 + i].patch_digest and rows[i].edit_digests == rows[30 + i].edit_digests and rows[i].edits == rows[30 + i].edits
    space = Space()
    whole = [patches.decode_patch(space, p) for p in made]
    for i in range(30):
        for j in range(i):
            if rows[i].patch_digest == rows[j].patch_digest:
                assert patches.patch_equal(space, whole[i], whole[j])
    assert api.canonical_patches(spark.createDataFrame([(1, None)], "id int, patch string"), "patch").first().parse_error
