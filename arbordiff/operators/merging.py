"""Three-way merge of two patches of one tree.

Both patches are aligned, the second with names of its own. Where their spines part, the two alignments are merged in two phases: the
first walks both and notes what each variable's subtree became (`became`) and which variables are the same (`equal`); the second
rewrites what the first left to do. A pair that can't be reconciled gives a conflict with a label.
"""

from __future__ import annotations

from dataclasses import dataclass

from arbordiff.operators.alignment import Cpy, Del, Frame, Ins, Mod, Prm, Spn, align, align_distribute, disalign, refine, show_alignment, visit
from arbordiff.operators.patches import Change, Clash, Cycle, Options, Spine, apply, change_equal, diff, leaves, map_leaves, minimize, shift, substitute, unify
from arbordiff.operators.terms import HOLE, PRIM, Space, Term, holes

LABELS = ("failed-contr", "ins-ins", "prm-chg", "chg-dup", "del-del", "del-mod", "del-spn", "inst-contr", "inst-mod", "inst-perm", "inst-ins", "inst-del", "mov-mov", "not-eq")


@dataclass(frozen=True, eq=False)
class Conflict:
    label: str
    left: object
    right: object


class NotASpan(Exception):
    """The patches aren't of one tree."""


class Disagreement(Exception):
    """args: a label."""


@dataclass(frozen=True, eq=False)
class Instantiate:
    change: Change
    apart_from: Term | None = None


@dataclass(frozen=True, eq=False)
class TestEqual:
    left: Change
    right: Change


class Merger:
    def __init__(self, space: Space):
        self.space = space
        self.became: dict[int, Change] = {}
        self.equal: dict[int, Term] = {}

    def note(self, label: str, v: Term, c: Change) -> None:
        """v's subtree became c; a second, different answer is a conflict."""
        if (old := self.became.setdefault(v.con, c)) is not c and not change_equal(c, old):
            raise Disagreement(label)

    def merge(self, p, q):
        out = self.first(p, q)
        try:
            maps = self.maps()
        except Cycle:
            raise Disagreement("failed-contr") from None
        return refine(out, lambda todo: Mod(self.second(maps, todo)))

    # First phase

    def first(self, p, q):
        out: list = []
        stack: list = [(None, p, q)]
        while stack:
            build, p, q = stack.pop()
            if build is not None:
                n = p
                kids = out[len(out) - n :]
                del out[len(out) - n :]
                out.append(build(kids))
                continue
            for kind in (Ins, Del):  # kept on either side, one after the other
                if isinstance(p, (Cpy, Prm)) or isinstance(q, (Cpy, Prm)) or not (isinstance(p, kind) or isinstance(q, kind)):
                    continue
                if kind is Ins and isinstance(p, Ins) and isinstance(q, Ins):
                    if not p.frame.same(q.frame):
                        raise Disagreement("ins-ins")
                    frame, p, q = p.frame, p.rest, q.rest
                elif kind is Ins:
                    frame, p, q = (p.frame, p.rest, q) if isinstance(p, Ins) else (q.frame, p, q.rest)
                elif isinstance(p, Del):
                    frame = p.frame
                    p, q = self.without(p, q)
                else:
                    frame = q.frame
                    p, q = self.without(q, p)
                stack += [(lambda kids, k=kind, f=frame: k(f, kids[0]), 1, None), (None, p, q)]
                break
            else:
                if isinstance(p, Spn) and isinstance(q, Spn):
                    if not p.fits(q):
                        raise NotASpan
                    stack.append((lambda kids, s=p: Spn(s.dtype, s.con, tuple(kids)), len(p.kids), None))
                    stack.extend((None, x, y) for x, y in zip(reversed(p.kids), reversed(q.kids), strict=True))
                    # children are merged from the first to the last
                else:
                    out.append(Mod(self.leaf(p, q)))
        return out[0]

    def leaf(self, p, q):
        if isinstance(p, Cpy):
            return Instantiate(disalign(self.space, q))
        if isinstance(q, Cpy):
            return Instantiate(disalign(self.space, p))
        if isinstance(p, Prm) and isinstance(q, Prm):
            self.equal[p.source.con] = q.source
            return TestEqual(Change(p.source, p.target), Change(q.source, q.target))
        if isinstance(p, Prm) or isinstance(q, Prm):
            prm, other = (p, q) if isinstance(p, Prm) else (q, p)
            self.note("prm-chg", prm.source, disalign(self.space, other))
            return Instantiate(Change(prm.source, prm.target))
        if isinstance(p, Spn) or isinstance(q, Spn):
            change, spine = (q.body, p) if isinstance(p, Spn) else (p.body, q)
            self.instantiate(change.delete, spine)
            return Instantiate(change, disalign(self.space, spine).insert)
        a, b = p.body, q.body
        for dup, other in ((a, b), (b, a)):
            if dup.delete.kind == dup.insert.kind == HOLE:
                self.note("chg-dup", dup.delete, other)
                return Instantiate(dup)
        try:
            found = unify(self.space, a.delete, b.delete)
        except Clash:
            raise NotASpan from None
        self.equal = {**self.equal, **found}
        return TestEqual(a, b)

    def without(self, gone: Del, other):
        """(what follows the deletion, what the other side does there), if the other side leaves alone what is deleted."""
        if isinstance(other, Del):
            if not gone.frame.same(other.frame):
                raise Disagreement("del-del")
            return gone.rest, other.rest
        if isinstance(other, Mod):
            raise Disagreement("del-mod")
        frame: Frame = gone.frame
        at = len(frame.before)
        if (frame.dtype, frame.con, at + 1 + len(frame.after)) != (other.dtype, other.con, len(other.kids)):
            raise NotASpan
        if not all(copies_only(k) for i, k in enumerate(other.kids) if i != at):
            raise Disagreement("del-spn")
        return gone.rest, other.kids[at]

    def instantiate(self, pattern: Term, al) -> None:
        """Notes what al does to the variables of the pattern."""
        stack = [(pattern, al)]
        while stack:
            x, a = stack.pop()
            if isinstance(a, Cpy):
                continue
            if x.kind == HOLE:
                self.note("inst-contr", x, disalign(self.space, a))
            elif isinstance(a, Mod):
                raise Disagreement("inst-mod")
            elif isinstance(a, Prm):
                raise Disagreement("inst-perm")
            elif x.kind == PRIM:
                if disalign(self.space, a).delete is not x:
                    raise NotASpan
            elif isinstance(a, (Ins, Del)):
                raise Disagreement("inst-ins" if isinstance(a, Ins) else "inst-del")
            elif (x.dtype, x.con, len(x.kids)) != (a.dtype, a.con, len(a.kids)):
                raise NotASpan
            else:
                stack.extend(zip(reversed(x.kids), reversed(a.kids), strict=True))

    # Second phase

    def maps(self) -> tuple[dict[int, Term], dict[int, Term]]:
        """What variables stand for in deletions and in insertions: decisions first, then equations that no decision contradicts."""
        out = []
        for side in ("delete", "insert"):
            bound = {v: t for v, t in self.equal.items() if t.rigid}
            bound.update((v, getattr(c, side)) for v, c in self.became.items())
            for v in sorted((v for v, t in self.equal.items() if not t.rigid), reverse=True):
                t = self.equal[v]
                if v not in bound and not (t.kind == HOLE and t.con in bound):
                    bound[v] = t
            out.append(minimize(self.space, bound))
        return out[0], out[1]

    def second(self, maps, todo) -> Change:
        def refined(c: Change) -> Change:
            return Change(substitute(self.space, maps[0], c.delete), substitute(self.space, maps[1], c.insert))

        if isinstance(todo, TestEqual):
            left = refined(todo.left)
            if not change_equal(left, refined(todo.right)):
                raise Disagreement("not-eq")
            return left
        if todo.apart_from is not None:
            a, b = (substitute(self.space, self.equal, t) for t in (todo.change.insert, todo.apart_from))
            if {h.con for h in holes(a)} & {h.con for h in holes(b)}:
                raise Disagreement("mov-mov")
        return refined(todo.change)


def copies_only(al) -> bool:
    return visit(al, lambda x: isinstance(x, Cpy), lambda x, kids: isinstance(x, Spn) and all(kids))


def merge(space: Space, oa, ob):
    """The patch that does what both do, with Conflicts among its leaves. Raises NotASpan."""
    a, free = align(space, oa)
    b, _ = align(space, map_leaves(ob, lambda c: shift(space, c, free)), free)

    def meet(p, q):
        p, q = align_distribute(p), align_distribute(q)
        try:
            return disalign(space, Merger(space).merge(p, q))
        except Disagreement as e:
            return Conflict(e.args[0], p, q)

    out: list = []
    stack: list = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        if ready:
            n = len(x.kids)
            kids = out[len(out) - n :]
            del out[len(out) - n :]
            out.append(Spine(x.dtype, x.con, tuple(kids)))
        elif isinstance(x, Spine) and isinstance(y, Spine) and (x.dtype, x.con, len(x.kids)) == (y.dtype, y.con, len(y.kids)):
            stack.append((x, y, True))
            stack.extend((k, m, False) for k, m in zip(reversed(x.kids), reversed(y.kids), strict=True))
        elif isinstance(x, Term) and x is y:
            out.append(x)
        else:
            out.append(meet(x, y))
    return out[0]


def conflicts(patch) -> list[Conflict]:
    """In the order of the tree."""
    return [c for c in leaves(patch) if isinstance(c, Conflict)]


def show_conflict(c: Conflict) -> str:
    return f"{{!! >>>>>>> {c.label} <<<<<<< {show_alignment(c.left)} =========== {show_alignment(c.right)} >>>>>>> {c.label} <<<<<<< !!}}"


def merge3(space: Space, a: Term, o: Term, b: Term, options: Options = Options(), expected: Term | None = None, known: dict | None = None) -> tuple[str, Term | None, list[Conflict]]:
    """(status, merged tree, conflicts). status: success, conflicting, not-a-span, apply-fail, or merge-diff if not the expected tree.
    known: the patches from o by the identity of their targets, kept for further merges of o."""
    known = {} if known is None else known
    for side in (a, b):
        if id(side) not in known:
            known[id(side)] = diff(space, o, side, options)
    try:
        both = merge(space, known[id(a)], known[id(b)])
    except NotASpan:
        return "not-a-span", None, []
    if found := conflicts(both):
        return "conflicting", None, found
    merged = apply(space, both, o)
    if merged is None:
        return "apply-fail", None, []
    return ("success" if expected is None or merged is expected else "merge-diff"), merged, []


