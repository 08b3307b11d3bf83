"""Alignment of changes: what of a change is deleted, inserted, kept, copied, permuted or really modified."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import count

from arbordiff.operators.patches import Change, Spine, _uses, change_cost, fold, leaves, map_leaves, max_variable, show_change
from arbordiff.operators.terms import HOLE, PRIM, ROLL, Space, Term, render


@dataclass(frozen=True, eq=False)
class Frame:
    """A constructor with one child taken out: before and after are its other children, which have no variables."""

    dtype: str
    con: str
    before: tuple
    after: tuple

    def fits(self, other: "Frame") -> bool:
        """Same constructor and same place."""
        return (self.dtype, self.con, len(self.before), len(self.after)) == (other.dtype, other.con, len(other.before), len(other.after))

    def same(self, other: "Frame") -> bool:
        return self.fits(other) and all(x is y for x, y in zip((*self.before, *self.after), (*other.before, *other.after), strict=True))

    def plug(self, space: Space, t: Term) -> Term:
        return space.roll(self.dtype, self.con, (*self.before, t, *self.after))


@dataclass(frozen=True, eq=False)
class Del:
    frame: Frame
    rest: object


@dataclass(frozen=True, eq=False)
class Ins:
    frame: Frame
    rest: object


@dataclass(frozen=True, eq=False)
class Spn:
    dtype: str
    con: str
    kids: tuple

    def fits(self, other: "Spn") -> bool:
        return (self.dtype, self.con, len(self.kids)) == (other.dtype, other.con, len(other.kids))


@dataclass(frozen=True, eq=False)
class Cpy:
    hole: Term


@dataclass(frozen=True, eq=False)
class Prm:
    source: Term
    target: Term


@dataclass(frozen=True, eq=False)
class Mod:
    body: object


def visit(al, leaf, order):
    """Results bottom-up, without recursion. leaf(x) for Cpy, Prm and Mod; order(x, results) for Del, Ins and Spn."""
    if not isinstance(al, (Spn, Del, Ins)):
        return leaf(al)
    out: list = []
    stack: list = [(al, False)]
    while stack:
        x, ready = stack.pop()
        if isinstance(x, Spn):
            if ready:
                n = len(x.kids)
                kids = out[len(out) - n :]
                del out[len(out) - n :]
                out.append(order(x, kids))
            else:
                stack.append((x, True))
                stack.extend((k, False) for k in reversed(x.kids))
        elif isinstance(x, (Del, Ins)):
            if ready:
                out.append(order(x, [out.pop()]))
            else:
                stack += [(x, True), (x.rest, False)]
        else:
            out.append(leaf(x))
    return out[0]


def rebuilt(x, kids):
    return Spn(x.dtype, x.con, tuple(kids)) if isinstance(x, Spn) else type(x)(x.frame, kids[0])


def refine(al, f):
    """al with f(body) in place of each Mod."""
    return visit(al, lambda x: f(x.body) if isinstance(x, Mod) else x, rebuilt)


def rigid_frame(t: Term) -> tuple[Frame, Term] | None:
    """The one child of the same datatype that has variables, and the rest, if no other child has any."""
    if t.kind != ROLL:
        return None
    open_ = [i for i, k in enumerate(t.kids) if not k.rigid]
    if len(open_) != 1:
        return None
    i = open_[0]
    if t.kids[i].dtype != t.dtype or t.kids[i].kind == PRIM:
        return None
    return Frame(t.dtype, t.con, t.kids[:i], t.kids[i + 1 :]), t.kids[i]


def align_change(c: Change):
    """Deletions first, then insertions, until a constructor is on both sides; at the leaves copies, permutations or modifications."""
    arity = _uses(c.delete, c.insert)

    def leaf(d: Term, i: Term):
        if d.kind == i.kind == HOLE and arity[d.con] == 2 and arity[i.con] == 2:
            return Cpy(d) if d.con == i.con else Prm(d, i)
        return Mod(Change(d, i))

    # A worklist of ("go", d, i, phase) and of builders that take finished results off `out`.
    out: list = []
    stack: list = [("go", c.delete, c.insert, "delete")]
    while stack:
        op, d, i, phase = stack.pop()
        if op == "wrap":
            out.append(d(out.pop()))
            continue
        if op == "spine":
            n = len(d.kids)
            kids = out[len(out) - n :]
            del out[len(out) - n :]
            out.append(Spn(d.dtype, d.con, tuple(kids)))
            continue
        of_insert = rigid_frame(i)
        if phase == "delete" and (of_delete := rigid_frame(d)):
            frame, rest = of_delete
            if of_insert is None:
                stack += [("wrap", lambda x, f=frame: Del(f, x), None, None), ("go", rest, i, "delete")]
            elif frame.fits(of_insert[0]):
                around = [[Mod(Change(x, y)) for x, y in zip(a, b, strict=True)] for a, b in ((frame.before, of_insert[0].before), (frame.after, of_insert[0].after))]
                stack += [("wrap", lambda x, f=frame, a=around: Spn(f.dtype, f.con, (*a[0], x, *a[1])), None, None), ("go", rest, of_insert[1], "delete")]
            else:
                stack += [("wrap", lambda x, f=frame, g=of_insert[0]: Del(f, Ins(g, x)), None, None), ("go", rest, of_insert[1], "delete")]
        elif of_insert:
            stack += [("wrap", lambda x, f=of_insert[0]: Ins(f, x), None, None), ("go", d, of_insert[1], "insert")]
        elif d.kind == ROLL and i.kind == ROLL and (d.dtype, d.con, len(d.kids)) == (i.dtype, i.con, len(i.kids)):
            stack.append(("spine", d, None, None))
            stack.extend(("go", x, y, "delete") for x, y in zip(reversed(d.kids), reversed(i.kids), strict=True))
        else:
            out.append(leaf(d, i))
    return out[0]


def align(space: Space, patch, before: int = 0):
    """(patch with alignments at its leaves, first free variable). Equal values that meet become copies with fresh names."""
    top = max_variable(patch)
    fresh = count(1 + (before if top is None else top))
    used = [next(fresh)]

    def copied(c: Change):
        if c.delete.kind == PRIM and c.delete is c.insert:
            n = used[0]
            used[0] = next(fresh)
            return Cpy(space.hole(n, None))
        return Mod(c)

    out = map_leaves(patch, lambda c: refine(align_change(c), copied))
    return out, used[0]


def disalign(space: Space, al) -> Change:
    def leaf(x):
        if isinstance(x, Cpy):
            return Change(x.hole, x.hole)
        return Change(x.source, x.target) if isinstance(x, Prm) else x.body

    def order(x, kids):
        if isinstance(x, Spn):
            return Change(space.roll(x.dtype, x.con, [k.delete for k in kids]), space.roll(x.dtype, x.con, [k.insert for k in kids]))
        [k] = kids
        return Change(x.frame.plug(space, k.delete), k.insert) if isinstance(x, Del) else Change(k.delete, x.frame.plug(space, k.insert))

    return visit(al, leaf, order)


def align_distribute(tree):
    """A spine of alignments as one alignment."""
    return fold(tree, lambda a: a, lambda p: Mod(Change(p, p)), lambda s, kids: Spn(s.dtype, s.con, tuple(kids)))


def align_cost(al) -> int:
    """Nodes deleted and inserted; constructors of the spine, copies and permutations cost nothing."""

    def order(x, kids):
        return sum(kids) + (0 if isinstance(x, Spn) else 1 + sum(k.size for k in (*x.frame.before, *x.frame.after)))

    return visit(al, lambda x: change_cost(x.body) if isinstance(x, Mod) else 0, order)


def patch_align_cost(patch) -> int:
    return sum(align_cost(a) for a in leaves(patch))


def operations(patch) -> Counter:
    """How many of each kind of edit an aligned patch has."""
    out: Counter = Counter()

    def leaf(x):
        out[type(x).__name__.lower()] += 1

    def order(x, _):
        out[type(x).__name__.lower()] += 1

    for a in leaves(patch):
        visit(a, leaf, order)
    return out


def show_alignment(al) -> str:
    def leaf(x):
        if isinstance(x, Cpy):
            return f"[Cpy {render(x.hole)} ]"
        return f"[Prm {render(x.source)} <=> {render(x.target)} ]" if isinstance(x, Prm) else show_change(x.body)

    def order(x, kids):
        if isinstance(x, Spn):
            return f"({x.con} {' '.join(kids)})" if kids else x.con
        a, b = ("[-", "-]") if isinstance(x, Del) else ("[+", "+]")
        return f"({a} {' '.join([x.frame.con, *map(render, x.frame.before), '[#]', *map(render, x.frame.after)])} {b} # = {kids[0]})"

    return "{-# " + visit(al, leaf, order) + " #-}"
