"""Merged programs in the layout of their sources.

A source text is a sequence of units (statements, or expressions at the top) with gaps of blanks and comments between them; a statement with
blocks holds sequences of its own. A unit of the merged tree that a source has, too, is taken over as it stands there; gaps are those that the
sources have between the same two units. Where the three sources write the same thing differently, what one side has changed wins,
and side A if both have. Only units that no source has are written anew, and of these only what lies outside their blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from arbordiff.operators.terms import Space, Term
from arbordiff.sources import writers
from arbordiff.sources.grammars import _Clojure, _While, clojure, deep, while_

#: Grammars whose texts are sequences of units.
GRAMMARS = {"while": while_, "clj": clojure}


@dataclass
class Unit:
    """text[begin:end] of a term, and the sequences of units in it."""

    term: Term
    begin: int
    end: int
    blocks: list[list[Unit]] = field(default_factory=list)


class _Statements(_While):
    """The parser, with where its statements and blocks are."""

    def __init__(self, space: Space, text: str):
        super().__init__(space, text)
        self.open: list[list] = [[]]

    def program(self) -> Term:
        self.open.append([])
        out = super().program()
        # what was begun after the last whole statement is no part of the program
        self.open[-2].append(("block", self.open.pop()))
        return out

    def block(self) -> Term:
        braces = self.peek()[1] == "{"
        if not braces:
            self.open.append([])
        out = super().block()
        if not braces:
            self.open[-2].append(("block", self.open.pop()))
        return out

    def statement(self) -> Term:
        first, depth = self.at, len(self.open)
        self.open.append([])
        try:
            out = super().statement()
        except ValueError:
            del self.open[depth:]
            raise
        blocks = [[x for kind, x in units if kind == "unit"] for kind, units in self.open.pop() if kind == "block"]
        self.open[-1].append(("unit", Unit(out, self.places[first][0], self.places[self.at - 1][1], blocks)))
        return out

    @property
    def places(self) -> list[tuple[int, int]]:
        if not hasattr(self, "_places"):
            self._places, at = [], 0
            while (at := self.BLANK.match(self.text, at).end()) < len(self.text) and (m := self.TOKEN.match(self.text, at)):
                self._places.append(m.span(m.lastgroup))
                at = m.end()
        return self._places


class _Forms(_Clojure):
    """The parser, with where the expressions of the top begin and end."""

    def __init__(self, space: Space, text: str):
        super().__init__(space, text)
        self.frames: list = []
        self.begins: list[int] = []
        self.ends: list[int] = []

    def begin(self, frames: list[tuple]) -> Term | None:
        self.frames = frames
        if len(frames) == 1:
            self.begins.append(self.at)
        return super().begin(frames)

    def blank(self) -> None:
        if len(self.frames) == 1 and len(self.frames[0][2]) > len(self.ends):
            self.ends.append(self.at)
        super().blank()


def units_of(name: str, space: Space, text: str) -> list[Unit]:
    """The units of a text of the grammar (while or clj) at its top."""
    with deep():
        if name == "while":
            parser = _Statements(space, text)
            parser.text = text
            parser.program()
            return [x for kind, x in parser.open[0][0][1] if kind == "unit"]
        parser = _Forms(space, text)
        tree = parser.top()
        return [Unit(*x) for x in zip(forms(tree), parser.begins, parser.ends, strict=True)]


def forms(t: Term) -> list[Term]:
    out = []
    while t.con == "Seq":
        out.append(t.kids[0])
        t = t.kids[1]
    return out


def _pick(o: str | None, a: str | None, b: str | None) -> str | None:
    """What one side has changed; side A's if both have."""
    if o is None:
        return b if a is None else a
    return a if a is not None and a != o else b if b is not None else a if a is not None else o


class Keeper:
    def __init__(self, name: str, space: Space, texts: list[str], write: Callable[[Term], str]):
        """texts: of the base, side A and side B, which parse."""
        self.name, self.write, self.texts = name, write, texts
        self.tops = [units_of(name, space, t) for t in texts]
        self.snippets: list[dict[int, str]] = [{}, {}, {}]
        self.gaps: list[dict[tuple[int, int], str]] = [{}, {}, {}]
        for k, (text, top) in enumerate(zip(texts, self.tops, strict=True)):
            todo = [top]
            while todo:
                units = todo.pop()
                for u in units:
                    self.snippets[k].setdefault(id(u.term), text[u.begin : u.end])
                    todo += u.blocks
                for u, v in zip(units, units[1:]):
                    self.gaps[k].setdefault((id(u.term), id(v.term)), text[u.end : v.begin])

    def text(self, merged: Term) -> str:
        terms = writers.statements(merged) if self.name == "while" else forms(merged)
        edges = [[t[: u[0].begin], t[u[-1].end :]] if u else [t, ""] for t, u in zip(self.texts, self.tops, strict=True)]
        return _pick(*(e[0] for e in edges)) + self.sequence(terms, self.tops[0]) + _pick(*(e[1] for e in edges))

    def sequence(self, terms: list[Term], like: list[Unit], default: str = "\n") -> str:
        """The terms one after another; like: the base's units in their place."""
        pairs: list[Unit | None] = [None] * len(terms)
        for kind, i, m, j, n in SequenceMatcher(None, [id(u.term) for u in like], [id(t) for t in terms], autojunk=False).get_opcodes():
            if kind in ("equal", "replace"):
                for x, y in zip(range(i, m), range(j, n)):
                    pairs[y] = like[x]
        out: list[str] = []
        last = None
        for t, u in zip(terms, pairs, strict=True):
            if last is not None:
                names = [{id(x.term) if x else id(s), id(s)} for s, x in (last, (t, u))]
                found = [next((g[p, q] for p in names[0] for q in names[1] if (p, q) in g), None) for g in self.gaps]
                gap = _pick(*found)
                out.append(default if gap is None else gap)
            out.append(self.unit(t, u))
            last = t, u
        return "".join(out)

    def unit(self, t: Term, like: Unit | None) -> str:
        if any(id(t) in s for s in self.snippets):
            return _pick(*(s.get(id(t)) for s in self.snippets))
        base = self.texts[0]
        if self.name == "while" and like and t.con == like.term.con and t.con in ("If", "While") and t.kids[0] is like.term.kids[0] and all(like.blocks):
            out, at = [], like.begin
            for block, units in zip(t.kids[1:], like.blocks, strict=True):
                out += [base[at : units[0].begin], self.sequence(writers.statements(block), units)]
                at = units[-1].end
            return "".join(out) + base[at : like.end]
        return self.write(t) if self.name == "while" else writers.expressions(t)


def keep(name: str, space: Space, merged: Term, texts: list[str], write: Callable[[Term], str]) -> str:
    """merged as text, in the layout of the three texts; if a text's layout can't be told apart, as the grammar writes it."""
    try:
        return Keeper(name, space, texts, write).text(merged)
    except (ValueError, RecursionError, IndexError):
        return write(merged)
