"""Laws of differences and patches on random similar trees."""

import random

import pytest

from arbordiff.operators import alignment, patches
from arbordiff.operators.patches import MODES, Change, Options, apply, compose, diff, patch_equal
from arbordiff.operators.terms import Space, encode, holes, node_columns, render


def node(space, name, kids):
    return space.roll("RTree", ":>:", [space.prim("String", name), space.list("RTree", kids)])


def tree(space, rng, height):
    return node(space, rng.choice("abcdefghijklm"), [tree(space, rng, height - 1) for _ in range(rng.randint(0, 4))] if height else [])


def parts(t):
    name, kids = t.kids
    out = []
    while kids.con == ":":
        out.append(kids.kids[0])
        kids = kids.kids[1]
    return name.con, out


def mutate(space, rng, t):
    name, kids = parts(t)
    act = rng.random()
    if act < 0.15:
        return node(space, rng.choice("abcdefghijklm"), kids)
    if act < 0.25:
        return node(space, rng.choice("abcdefghijklm"), [t])
    if act < 0.35 and kids:
        return rng.choice(kids)
    return node(space, name, [mutate(space, rng, k) if rng.random() < 0.6 else k for k in kids])


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("seed", range(60))
def test_laws(mode, seed):
    rng, space = random.Random(seed), Space()
    a = tree(space, rng, rng.randint(0, 4))
    b, c = mutate(space, rng, a), mutate(space, rng, a)
    d = mutate(space, rng, c)
    options = Options(mode=mode)
    _, deleted, inserted = patches.extract(space, a, b, options)
    assert {h.con for h in holes(deleted)} == {h.con for h in holes(inserted)}
    ab, bc, cd = diff(space, a, b, options), diff(space, b, c, options), diff(space, c, d, options)
    assert apply(space, ab, a) is b
    assert apply(space, diff(space, a, b, Options(mode=mode, global_scope=True)), a) is b
    copy = Change(space.hole(0, a.dtype), space.hole(0, a.dtype))
    assert compose(space, ab, copy) is not None and compose(space, copy, ab) is not None
    both = compose(space, bc, ab)
    assert apply(space, both, a) is c
    assert patch_equal(space, compose(space, compose(space, cd, bc), ab), compose(space, cd, both))
    assert patch_equal(space, ab, ab) and patch_equal(space, ab, patches.map_leaves(ab, lambda x: patches.shift(space, x, 7)))
    aligned, _ = alignment.align(space, ab)
    back = patches.map_leaves(aligned, lambda x: alignment.disalign(space, x))
    assert apply(space, back, a) is b
    assert alignment.patch_align_cost(aligned) <= patches.cost(ab) + 2 * (a.size + b.size)
    again = patches.decode_patch(space, patches.encode_patch(ab))
    assert patches.encode_patch(again) == patches.encode_patch(ab) and apply(space, again, a) is b
    assert space.decode(encode(a)) is a and render(a)


def test_long_lists_need_no_recursion():
    space = Space()
    a = space.list("Line", [space.prim("String", str(i)) for i in range(30_000)])
    b = space.list("Line", [space.prim("String", str(i + (i == 20_000))) for i in range(30_000)])
    patch = diff(space, a, b)
    aligned, _ = alignment.align(space, patch)
    assert apply(space, patch, a) is b and alignment.patch_align_cost(aligned) > 0
    assert len(node_columns(a, frozenset(["digest"]))["digest"]) == a.size == 60_001


def test_composition_with_itself_need_not_be_defined():
    space = Space()
    a, b = node(space, "a", []), node(space, "b", [node(space, "c", [])])
    ab = diff(space, a, b)
    assert compose(space, ab, ab) is None
