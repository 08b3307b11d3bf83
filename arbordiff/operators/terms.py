"""Trees: opaque values, constructors and metavariables.

Terms are interned: within one `Space` equal terms are the same object, so that comparing subtrees, counting how often they occur and
finding what two trees share need no walk. A space lives as long as the work on one row.

Encoded, a term is a JSON array of its nodes in preorder: ["R", datatype, constructor, children], ["P", type, value] or ["H", number,
datatype]. It doesn't nest, so that no tree is too deep for it.
"""

from __future__ import annotations

import hashlib
import json

ROLL, PRIM, HOLE = "R", "P", "H"


class Term:
    """kind ROLL: dtype, con, kids. PRIM: dtype (primitive type), con (value). HOLE: con (number), dtype (None for a primitive)."""

    __slots__ = ("kind", "dtype", "con", "kids", "height", "size", "rigid")

    def __init__(self, kind: str, dtype: str | None, con, kids: tuple):
        self.kind, self.dtype, self.con, self.kids = kind, dtype, con, kids
        if not kids:
            self.height, self.size, self.rigid = kind == ROLL and 1 or 0, 1, kind != HOLE
            return
        height, size, rigid = 0, 1, kind != HOLE
        for k in kids:
            size += k.size
            if k.height > height:
                height = k.height
            if not k.rigid:
                rigid = False
        self.height = height + 1 if kind == ROLL else 0
        self.size, self.rigid = size, rigid

    def __repr__(self) -> str:
        return render(self)


class Space:
    #: Terms that a space for many rows holds before it begins anew.
    MOST = 1 << 15

    def __init__(self):
        self.known: dict = {}

    def next_row(self) -> "Space":
        """This space for one more row: terms that rows have in common are made once, and there is a bound to what is held."""
        return self if len(self.known) < self.MOST else Space()

    def _term(self, kind: str, dtype: str | None, con, kids: tuple) -> Term:
        key = (kind, dtype, con, *map(id, kids)) if kids else (kind, dtype, con)
        if (t := self.known.get(key)) is None:
            t = self.known[key] = Term(kind, dtype, con, kids)
        return t

    def roll(self, dtype: str, con: str, kids) -> Term:
        kids = tuple(kids)
        key = (ROLL, dtype, con, *map(id, kids)) if kids else (ROLL, dtype, con)
        if (t := self.known.get(key)) is None:
            t = self.known[key] = Term(ROLL, dtype, con, kids)
        return t

    def prim(self, dtype: str, value: str) -> Term:
        return self._term(PRIM, dtype, value, ())

    def hole(self, number: int, dtype: str | None) -> Term:
        return self._term(HOLE, dtype, number, ())

    def list(self, element: str, items) -> Term:
        """A cons list; its datatype names the element's."""
        dtype = f"[{element}]"
        out = self.roll(dtype, "[]", ())
        for x in reversed(list(items)):
            out = self.roll(dtype, ":", (x, out))
        return out

    def like(self, t: Term, kids) -> Term:
        return self.roll(t.dtype, t.con, kids)

    def replace(self, t: Term, holes) -> Term:
        """t with holes(hole) for each hole (None: as it is)."""
        if t.rigid:
            return t
        done: dict[int, Term] = {}
        stack = [(t, False)]
        while stack:
            x, ready = stack.pop()
            if id(x) in done:
                continue
            if x.rigid:
                done[id(x)] = x
            elif x.kind == HOLE:
                new = holes(x)
                done[id(x)] = x if new is None else new
            elif ready:
                done[id(x)] = self.like(x, [done[id(k)] for k in x.kids])
            else:
                stack.append((x, True))
                stack.extend((k, False) for k in x.kids)
        return done[id(t)]

    def decode(self, text: str) -> Term:
        return self.build(json.loads(text))

    def build(self, nodes: list) -> Term:
        stack: list[Term] = []
        for n in reversed(nodes):
            if n[0] == ROLL:
                kids = [stack.pop() for _ in range(n[3])]
                stack.append(self.roll(n[1], n[2], kids))
            else:
                stack.append(self.prim(n[1], n[2]) if n[0] == PRIM else self.hole(n[1], n[2]))
        [out] = stack
        return out


def preorder(t: Term):
    stack = [t]
    while stack:
        x = stack.pop()
        yield x
        if x.kids:
            stack.extend(x.kids[::-1])


def encode(t: Term) -> str:
    return json.dumps([[ROLL, x.dtype, x.con, len(x.kids)] if x.kind == ROLL else [PRIM, x.dtype, x.con] if x.kind == PRIM else [HOLE, x.con, x.dtype] for x in preorder(t)], ensure_ascii=False, separators=(",", ":"))


def holes(t: Term) -> list[Term]:
    """The holes of a term in preorder, each as often as it occurs."""
    out, stack = [], [t]
    while stack:
        x = stack.pop()
        if x.kind == HOLE:
            out.append(x)
        elif not x.rigid:
            stack.extend(reversed(x.kids))
    return out


def digests(t: Term) -> dict[int, str]:
    """SHA-256 of every subtree, by the term's identity: of a value's text, or of datatype, constructor and the children's digests."""
    out: dict[int, str] = {}
    stack = [(t, False)]
    while stack:
        x, ready = stack.pop()
        if id(x) in out:
            continue
        if ready or not x.kids:
            own = x.con if x.kind == PRIM else f"{x.dtype}\0{x.con}\0" + "".join([out[id(k)] for k in x.kids])
            out[id(x)] = hashlib.sha256(str(own).encode("utf8", "surrogatepass")).hexdigest()
        else:
            stack.append((x, True))
            stack.extend((k, False) for k in x.kids)
    return out


#: Columns of a node table that the walk to a node tells.
PLACED = frozenset({"parent_id", "ord", "depth"})


def node_columns(t: Term, wanted: frozenset, kinds: frozenset | None = None) -> dict[str, list]:
    """The node table of a tree, as lists: numbers in preorder, the last number of each subtree, and so on. What isn't wanted isn't
    worked out. kinds: of ROLL, PRIM and HOLE those whose nodes are wanted (None: all)."""
    terms, parents, places, depths = [], [], [], []
    stack = [(t, None, 0, 0)] if wanted & PLACED else []
    if not stack:
        terms.extend(preorder(t))
    while stack:
        x, parent, place, depth = stack.pop()
        n = len(terms)
        terms.append(x)
        parents.append(parent)
        places.append(place)
        depths.append(depth)
        for i in range(len(x.kids) - 1, -1, -1):
            stack.append((x.kids[i], n, i, depth + 1))
    digest = digests(t) if wanted & {"digest", "kids"} else {}
    names = {ROLL: "roll", PRIM: "prim", HOLE: "hole"}
    at = range(len(terms))
    if kinds is not None:
        at = [n for n, x in enumerate(terms) if x.kind in kinds]
        terms, parents, places, depths = ([x[n] for n in at] if x else x for x in (terms, parents, places, depths))
    given = {
        "node_id": lambda: [*at], "parent_id": lambda: parents, "ord": lambda: places, "depth": lambda: depths, "last_id": lambda: [n + x.size - 1 for n, x in zip(at, terms)],
        "kind": lambda: [names[x.kind] for x in terms], "dtype": lambda: [x.dtype if x.kind == ROLL else None for x in terms], "con": lambda: [x.con if x.kind == ROLL else None for x in terms],
        "prim_type": lambda: [None if x.kind == ROLL else x.dtype for x in terms], "prim_val": lambda: [None if x.kind == ROLL else str(x.con) for x in terms],
        "height": lambda: [x.height for x in terms], "size": lambda: [x.size for x in terms], "digest": lambda: [digest[id(x)] for x in terms],
        "kids": lambda: [[digest[id(k)] for k in x.kids] for x in terms],
    }
    return {c: f() for c, f in given.items() if c in wanted}


def render(t: Term) -> str:
    """On one line: constructors as (Con a b), values quoted, metavariables as #n."""
    out: list[str] = []
    stack: list = [t]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == HOLE:
            out.append(f"#{x.con}")
        elif x.kind == PRIM:
            out.append(json.dumps(x.con, ensure_ascii=False))
        elif not x.kids:
            out.append(x.con)
        else:
            out.append(f"({x.con}")
            stack.append(")")
            for k in reversed(x.kids):
                stack += [k, " "]
    return "".join(out)
