"""Changes and patches: difference of two trees, application, composition, equality, names and cost.

A change is a pair of contexts: what it deletes binds metavariables, what it inserts uses them. A patch is a spine, constructors that
both trees have, with changes at its leaves.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass

from arbordiff.operators.terms import HOLE, PRIM, ROLL, Space, Term, holes, preorder, render

MODES = ("proper", "nonest", "patience")


@dataclass(frozen=True, eq=False)
class Change:
    delete: Term
    insert: Term


@dataclass(frozen=True, eq=False)
class Spine:
    """A constructor of the spine; kids are Spines, leaves (changes, alignments, conflicts) or opaque terms."""

    dtype: str
    con: str
    kids: tuple


@dataclass(frozen=True)
class Options:
    """max_nodes: nodes of a row's trees together beyond which it isn't worked on (0: no limit)."""

    min_height: int = 1
    mode: str = "nonest"
    global_scope: bool = False
    max_nodes: int = 0


def fold(tree, leaf, prim, node):
    """Bottom-up over a spine, without recursion: node(spine, results of its kids)."""
    if not isinstance(tree, Spine):
        return prim(tree) if isinstance(tree, Term) else leaf(tree)
    out: list = []
    stack: list = [(tree, False)]
    while stack:
        x, ready = stack.pop()
        if not isinstance(x, Spine):
            out.append(prim(x) if isinstance(x, Term) else leaf(x))
        elif ready:
            n = len(x.kids)
            kids = out[len(out) - n :]
            del out[len(out) - n :]
            out.append(node(x, kids))
        else:
            stack.append((x, True))
            stack.extend((k, False) for k in reversed(x.kids))
    return out[0]


def map_leaves(tree, f):
    return fold(tree, f, lambda p: p, lambda s, kids: Spine(s.dtype, s.con, tuple(kids)))


def leaves(tree) -> list:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, Spine):
            stack.extend(reversed(x.kids))
        elif not isinstance(x, Term):
            out.append(x)
    return out


# Sharing and extraction


def occurrences(t: Term, min_height: int) -> dict[int, int]:
    """How often each subtree higher than min_height occurs, by identity."""
    out: dict[int, int] = {}
    stack = [t]
    while stack:
        x = stack.pop()
        if x.height > min_height and x.kind == ROLL:
            out[id(x)] = out.get(id(x), 0) + 1
            stack.extend(x.kids)
    return out


def shared(source: Term, target: Term, min_height: int) -> dict[int, tuple[int, int]]:
    """Identity -> (metavariable, occurrences in both together) of the subtrees that both have, numbered as the source has them."""
    a, b = occurrences(source, min_height), occurrences(target, min_height)
    out: dict[int, tuple[int, int]] = {}
    for x in preorder(source):
        if id(x) in a and id(x) in b and id(x) not in out:
            out[id(x)] = len(out), a[id(x)] + b[id(x)]
    return out


def _cut(space: Space, t: Term, wanted) -> Term:
    """t with holes for the topmost subtrees that are wanted; wanted(subtree) gives a number or None."""
    done: dict[int, Term] = {}
    stack = [(t, False)]
    while stack:
        x, ready = stack.pop()
        if id(x) in done:
            continue
        if ready:
            done[id(x)] = space.like(x, [done[id(k)] for k in x.kids])
        elif x.kind != ROLL:
            done[id(x)] = x
        elif (n := wanted(x)) is not None:
            done[id(x)] = space.hole(n, x.dtype)
        else:
            stack.append((x, True))
            stack.extend((k, False) for k in x.kids)
    return done[id(t)]


def _proper(t: Term, found: dict[int, tuple[int, int]]) -> set[int]:
    """Subtrees that occur at least as often as anything below them."""
    most: dict[int, int] = {}
    out: set[int] = set()
    stack = [(t, False)]
    while stack:
        x, ready = stack.pop()
        if id(x) in most:
            continue
        if ready or not x.kids:
            own, below = found.get(id(x), (0, 0))[1], max([most[id(k)] for k in x.kids], default=0)
            most[id(x)] = max(own, below)
            if own >= below:
                out.add(id(x))
        else:
            stack.append((x, True))
            stack.extend((k, False) for k in x.kids)
    return out


def extract(space: Space, source: Term, target: Term, options: Options) -> tuple[int, Term, Term]:
    """(first free metavariable, deletion context, insertion context)."""
    found = shared(source, target, options.min_height)
    number = {i: n for i, (n, _) in found.items()}
    if options.mode == "patience":
        twice = {i: n for i, (n, times) in found.items() if times == 2}
        return len(found), _cut(space, source, lambda x: twice.get(id(x))), _cut(space, target, lambda x: twice.get(id(x)))
    if options.mode == "proper":
        out = []
        for t in (source, target):
            proper = _proper(t, found)
            out.append(_cut(space, t, lambda x, proper=proper: number.get(id(x)) if id(x) in proper else None))
        return len(found), *out
    if options.mode != "nonest":
        raise ValueError(f"no such mode: {options.mode}")
    whole = {n: x for t in (source, target) for x in preorder(t) if (n := number.get(id(x))) is not None}
    cut = [_cut(space, t, lambda x: number.get(id(x))) for t in (source, target)]
    both = {h.con for h in holes(cut[0])} & {h.con for h in holes(cut[1])}
    # what became a hole on one side only is put back whole
    return len(found), *(space.replace(c, lambda h: None if h.con in both else whole[h.con]) for c in cut)


# Closing a change


def _uses(*terms: Term) -> dict[int, int]:
    """How often each variable stands in the terms."""
    out: dict[int, int] = {}
    for t in terms:
        if not t.rigid:
            for h in holes(t):
                out[h.con] = out.get(h.con, 0) + 1
    return out


def close(change: Change):
    """The spine that both contexts of the change have, with the changes at the smallest scopes that hold all uses of their variables.

    A variable is open in a part of the tree while some of its occurrences are elsewhere. Parts carry only their open variables; the
    smaller of two such maps is poured into the larger."""
    total = _uses(change.delete, change.insert)

    def settle(counts: dict[int, int]) -> dict[int, int]:
        for v in [v for v, n in counts.items() if n == total[v]]:
            del counts[v]
        return counts

    out: list[tuple[object, dict[int, int]]] = []
    stack: list[tuple[Term, Term, bool]] = [(change.delete, change.insert, False)]
    while stack:
        d, i, ready = stack.pop()
        if ready:
            n = len(d.kids)
            kids = out[len(out) - n :]
            del out[len(out) - n :]
            if not any(c for _, c in kids):
                out.append((Spine(d.dtype, d.con, tuple([k for k, _ in kids])), {}))
                continue
            counts = max([c for _, c in kids], key=len)
            for _, c in kids:
                if c is not counts:
                    for v, m in c.items():
                        counts[v] = counts.get(v, 0) + m
            out.append((Change(d, i), settle(counts)))
        elif d.kind == ROLL and i.kind == ROLL and (d.dtype, d.con, len(d.kids)) == (i.dtype, i.con, len(i.kids)):
            stack.append((d, i, True))
            stack.extend((x, y, False) for x, y in zip(reversed(d.kids), reversed(i.kids), strict=True))
        elif d.kind == PRIM and d is i:
            out.append((d, {}))
        else:
            out.append((Change(d, i), settle(_uses(d, i))))
    [(patch, opened)] = out
    if opened:
        raise ValueError("the change is not closed")
    return patch


def diff(space: Space, source: Term, target: Term, options: Options = Options()):
    free, d, i = extract(space, source, target, options)
    if options.global_scope:
        return Change(d, i)
    numbers = iter(range(free, free + source.size + target.size))

    def copy(_: Term) -> Change:
        h = space.hole(next(numbers), None)
        return Change(h, h)

    return fold(close(Change(d, i)), lambda c: c, copy, lambda s, kids: Spine(s.dtype, s.con, tuple(kids)))


# Algebra


def distribute(space: Space, patch) -> Change:
    """The patch as one change."""
    return fold(patch, lambda c: c, lambda p: Change(p, p), lambda s, kids: Change(space.roll(s.dtype, s.con, [k.delete for k in kids]), space.roll(s.dtype, s.con, [k.insert for k in kids])))


def change_variables(c: Change) -> Counter:
    return Counter(h.con for t in (c.delete, c.insert) for h in holes(t))


def variables(patch) -> Counter:
    out: Counter = Counter()
    for c in leaves(patch):
        out.update(change_variables(c))
    return out


def max_variable(patch) -> int | None:
    return max([h.con for c in leaves(patch) for t in (c.delete, c.insert) if not t.rigid for h in holes(t)], default=None)


def shift(space: Space, c: Change, by: int) -> Change:
    def moved(h: Term) -> Term:
        return space.hole(h.con + by, h.dtype)

    return Change(space.replace(c.delete, moved), space.replace(c.insert, moved))


def fresh_from(space: Space, p, q):
    """p with names that q doesn't use."""
    top = max_variable(q)
    return p if top is None else map_leaves(p, lambda c: shift(space, c, top + 1))


def change_cost(c: Change) -> int:
    return c.delete.size + c.insert.size


def cost(patch) -> int:
    return sum(change_cost(c) for c in leaves(patch))


def pairs_where_apart(a: Term, b: Term):
    """Anti-unification: (x, y) wherever a and b stop agreeing, and at every hole."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is y and x.rigid:
            continue
        if x.kind == ROLL and y.kind == ROLL and (x.dtype, x.con, len(x.kids)) == (y.dtype, y.con, len(y.kids)):
            stack.extend(zip(reversed(x.kids), reversed(y.kids), strict=True))
        else:
            yield x, y


def change_equal(a: Change, b: Change) -> bool:
    """Equal up to names. Deletions fix which name stands for which (a later occurrence overrides an earlier one); in insertions the
    same name always passes."""
    names: dict[int, int] = {}
    for x, y in pairs_where_apart(a.delete, b.delete):
        if x.kind != HOLE or y.kind != HOLE:
            return False
        names[x.con] = y.con
    return all(x.kind == y.kind == HOLE and (x.con == y.con or names.get(x.con) == y.con) for x, y in pairs_where_apart(a.insert, b.insert))


def patch_equal(space: Space, p, q) -> bool:
    return change_equal(distribute(space, p), distribute(space, q))


def canonical(space: Space, c: Change) -> Change:
    """The change with its variables numbered by their first place, in the deletion and then in the insertion: changes that differ in
    names alone become the same."""
    number: dict[int, int] = {}
    for h in (*holes(c.delete), *holes(c.insert)):
        number.setdefault(h.con, len(number))

    def named(h: Term) -> Term:
        return space.hole(number[h.con], h.dtype)

    return Change(space.replace(c.delete, named), space.replace(c.insert, named))


def change_digest(space: Space, c: Change) -> str:
    """SHA-256 of the canonical change: equal for changes that are equal up to names."""
    from arbordiff.operators.terms import encode

    c = canonical(space, c)
    return hashlib.sha256(f"{encode(c.delete)}\0{encode(c.insert)}".encode("utf8", "surrogatepass")).hexdigest()


class Clash(Exception):
    """Two terms have no common instance."""


def unify(space: Space, a: Term, b: Term) -> dict[int, Term]:
    """The most general substitution that makes a and b equal, resolved; of two variables the second is bound to the first."""
    bound: dict[int, Term] = {}

    def resolve(x: Term) -> Term:
        while x.kind == HOLE and x.con in bound:
            x = bound[x.con]
        return x

    stack = [(a, b)]
    while stack:
        x, y = map(resolve, stack.pop())
        if x is y:
            continue
        if y.kind == HOLE:
            bound[y.con] = x
        elif x.kind == HOLE:
            bound[x.con] = y
        elif x.kind == y.kind == ROLL and (x.dtype, x.con, len(x.kids)) == (y.dtype, y.con, len(y.kids)):
            stack.extend(zip(reversed(x.kids), reversed(y.kids), strict=True))
        else:
            raise Clash
    return minimize(space, bound)


class Cycle(Clash):
    """A variable would have to hold itself. args: the variables."""


def minimize(space: Space, bound: dict[int, Term]) -> dict[int, Term]:
    """The substitution with every variable resolved as far as it goes. Variables that only name each other keep one name."""
    out: dict[int, Term] = {}
    loops = set()
    for v in bound:  # break circles of names at their smallest
        seen, x = [v], bound[v]
        while x.kind == HOLE and x.con in bound and x.con not in seen:
            seen.append(x.con)
            x = bound[x.con]
        if x.kind == HOLE and x.con in seen:
            loops.add(min(seen[seen.index(x.con) :]))
    rest = {v: t for v, t in bound.items() if v not in loops}
    state: dict[int, int] = {}
    for root in rest:
        stack = [(root, False)]
        while stack:
            v, ready = stack.pop()
            if ready:
                out[v] = space.replace(rest[v], lambda h: out.get(h.con))
                state[v] = 2
            elif state.get(v) != 2:
                state[v] = 1
                stack.append((v, True))
                for n in {h.con for h in holes(rest[v])}:
                    if n in rest:
                        if state.get(n) == 1:
                            raise Cycle(n)
                        stack.append((n, False))
    return out


def substitute(space: Space, bound: dict[int, Term], t: Term) -> Term:
    return space.replace(t, lambda h: bound.get(h.con))


def apply_change(space: Space, c: Change, t: Term) -> Term | None:
    """The tree that the change makes of t; None if its deletion context doesn't match. A free variable is an error."""
    try:
        bound = unify(space, c.delete, t)
    except Clash:
        return None
    out = substitute(space, bound, c.insert)
    if not out.rigid:
        raise ValueError(f"variable without a value: #{holes(out)[0].con}")
    return out


def apply(space: Space, patch, t: Term) -> Term | None:
    return apply_change(space, distribute(space, patch), t)


def compose_changes(space: Space, q: Change, p: Change) -> Change | None:
    """q after p; their names must differ."""
    try:
        bound = unify(space, q.delete, p.insert)
    except Clash:
        return None
    return Change(substitute(space, bound, p.delete), substitute(space, bound, q.insert))


def compose(space: Space, q, p):
    """The patch that does p, then q; None if they don't fit."""
    both = compose_changes(space, distribute(space, q), distribute(space, fresh_from(space, p, q)))
    return None if both is None else close(both)


def patch_composes(space: Space, q, p) -> bool:
    """Whether q can follow p."""
    return compose(space, q, p) is not None


# Text


def show_change(c: Change) -> str:
    return f"{{{{- {render(c.delete)} -}} {{+ {render(c.insert)} +}}}}"


def show(patch, leaf=show_change) -> str:
    return fold(patch, leaf, render, lambda s, kids: f"({s.con} {' '.join(kids)})" if kids else s.con)


def encode_patch(patch) -> str:
    """JSON array in preorder: ["S", datatype, constructor, kids], ["P", type, value], ["C", deletion, insertion] with encoded terms."""
    from arbordiff.operators.terms import encode

    out, stack = [], [patch]
    while stack:
        x = stack.pop()
        if isinstance(x, Spine):
            out.append(["S", x.dtype, x.con, len(x.kids)])
            stack.extend(reversed(x.kids))
        elif isinstance(x, Term):
            out.append(["P", x.dtype, x.con])
        else:
            out.append(["C", encode(x.delete), encode(x.insert)])
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def decode_patch(space: Space, text: str):
    stack: list = []
    for n in reversed(json.loads(text)):
        if n[0] == "S":
            kids = [stack.pop() for _ in range(n[3])]
            stack.append(Spine(n[1], n[2], tuple(kids)))
        else:
            stack.append(space.prim(n[1], n[2]) if n[0] == "P" else Change(space.decode(n[1]), space.decode(n[2])))
    [out] = stack
    return out
