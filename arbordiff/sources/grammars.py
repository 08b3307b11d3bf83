"""Grammars: text to trees. Each takes a space and a text and returns a term, or raises ParseError."""

from __future__ import annotations

import ast
import json
import re
import sys
from collections.abc import Callable
from contextlib import contextmanager

from arbordiff.operators.terms import PRIM, Space, Term, preorder


class ParseError(ValueError):
    pass


@contextmanager
def deep(frames: int = 20_000):
    """For parsers by recursive descent: so many frames may be open; a text that needs more has no tree."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, frames))
    try:
        yield
    except RecursionError:
        raise ParseError("nested too deeply") from None
    finally:
        sys.setrecursionlimit(before)


def lines(space: Space, text: str) -> Term:
    """A statement of lines. A newline at the very end begins no further line; an empty text has none."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return space.roll("Stmt", "Stmt", [space.list("Line", [space.roll("Line", "Line", [space.prim("String", x)]) for x in parts])])


def unparse_lines(t: Term) -> str:
    """The lines, joined by newlines (one at the end of the text is not kept)."""
    return "\n".join(x.con for x in preorder(t) if x.kind == PRIM)


_RTREE = re.compile(r"[^\[\],\s]+|[\[\],]")


def rtree(space: Space, text: str) -> Term:
    """Labelled trees: a[b,c[d]]."""
    tokens = _RTREE.findall(text)
    stack: list[tuple[str, list[Term]]] = []
    done: Term | None = None
    label: str | None = None

    def finish(name: str, kids: list[Term]) -> None:
        nonlocal done
        t = space.roll("RTree", ":>:", [space.prim("String", name), space.list("RTree", kids)])
        if stack:
            stack[-1][1].append(t)
        elif done is None:
            done = t
        else:
            raise ParseError("more than one tree")

    for token in tokens:
        if token == "[":
            if label is None:
                raise ParseError("children without a label")
            stack.append((label, []))
            label = None
        elif token in ",]":
            if label is not None:
                finish(label, [])
                label = None
            if token == "]":
                if not stack:
                    raise ParseError("unexpected ]")
                finish(*stack.pop())
        elif label is not None:
            raise ParseError("two labels in a row")
        else:
            label = token
    if label is not None:
        finish(label, [])
    if stack or done is None:
        raise ParseError("unexpected end")
    return done


def unparse_rtree(t: Term) -> str:
    out: list[str] = []
    stack: list = [t]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        name, kids = x.kids
        out.append(name.con)
        items = []
        while kids.con == ":":
            items.append(kids.kids[0])
            kids = kids.kids[1]
        if items:
            stack.append("]")
            for i, k in enumerate(reversed(items)):
                stack += [k, "," if i < len(items) - 1 else "["]
    return "".join(out)


_CLOSING = {"(": ")", "[": "]", "{": "}"}
_SORT = {"(": "Paren", "[": "Brace", "{": "Curly"}
_DYCK = re.compile(r"(?P<ws>\s*)(?:(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[^\n \t\r(\[{}\])]+)|$)")


def dyck(space: Space, text: str, keep_space: bool = False) -> Term:
    """Bracketed text: a sequence of words and of bracketed sequences. The white space before each is kept or dropped."""

    def white(s: str) -> Term:
        return space.prim("String", s) if keep_space else space.roll("()", "()", [])

    lex = "WS" if keep_space else "()"
    seq, atom = f"Dyck {lex}", f"DyckAtom {lex}"
    stack: list[tuple[str, str, list]] = [("", "", [])]
    at = 0
    while True:
        m = _DYCK.match(text, at)
        if m is None:
            raise ParseError(f"at {at}")
        ws, at = m["ws"], m.end()
        if m["open"]:
            stack.append((m["open"], ws, []))
        elif m["word"]:
            stack[-1][2].append((ws, space.roll(atom, "Word", [space.prim("String", m["word"])])))
        else:
            kind, before, items = stack.pop()
            if m["close"] != _CLOSING.get(kind) and (m["close"] or kind):
                raise ParseError(f"unmatched bracket at {at}")
            out = space.roll(seq, "Done", [white(ws)])
            for w, x in reversed(items):
                out = space.roll(seq, "Lexeme", [white(w), x, out])
            if not kind:
                return out
            stack[-1][2].append((before, space.roll(atom, "Enclose", [space.roll("Sep", _SORT[kind], []), out])))


def dyck_loc(space: Space, text: str) -> Term:
    return dyck(space, text, keep_space=True)


class _While:
    """Recursive descent for a small imperative language."""

    TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<name>[^\W\d_][^\W_]*)|(?P<op>:=|==|[-+*/%^<>;(){}]))")
    BLANK = re.compile(r"(?:\s+|//[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)
    #: Reserved words, and operators of each precedence, tightest first.
    RESERVED = frozenset(("if", "then", "else", "while", "do", "skip", "true", "false", "not", "and", "or", "range"))
    LEVELS = ({"^": "Power"}, {"*": "Multiply", "/": "Divide", "%": "Reminder"}, {"+": "Add", "-": "Subtract"})
    RELATIONS = {">": "Greater", "<": "Less", "==": "Equal"}

    def __init__(self, space: Space, text: str):
        self.space, self.tokens, at = space, [], 0
        while (at := self.BLANK.match(text, at).end()) < len(text):
            m = self.TOKEN.match(text, at)
            if m is None:
                break  # what can't be read ends the program
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind != "end" and text in texts:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ParseError(f"expected {text}, found {self.peek()[1] or 'the end'}")

    def program(self) -> Term:
        """At least one statement; a single one stands for itself; what follows the last is ignored."""
        out = []
        while True:
            begin = self.at
            try:
                out.append(self.statement())
            except ParseError:
                if not out or self.at > begin and self.started(begin):
                    raise
                self.at = begin
                break
        return out[0] if len(out) == 1 else self.space.roll("Stmt", "Seq", [self.space.list("Stmt", out)])

    def started(self, begin: int) -> bool:
        """Whether a token of a statement was read, so that its failure is the program's."""
        kind, text = self.tokens[begin] if begin < len(self.tokens) else ("end", "")
        return kind == "name" and (text in ("if", "while", "skip") or text not in self.RESERVED)

    def block(self) -> Term:
        if self.take("{"):
            out = self.program()
            self.need("}")
            return out
        return self.statement()

    def statement(self) -> Term:
        roll = self.space.roll
        if self.take("if"):
            test = self.boolean()
            self.need("then")
            yes = self.block()
            self.need("else")
            return roll("Stmt", "If", [test, yes, self.block()])
        if self.take("while"):
            test = self.boolean()
            self.need("do")
            return roll("Stmt", "While", [test, self.block()])
        if self.take("skip"):
            self.need(";")
            return roll("Stmt", "Skip", [])
        name = self.name()
        self.need(":=")
        value = self.arithmetic(2)
        self.need(";")
        return roll("Stmt", "Assign", [self.space.prim("String", name), value])

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name" or text in self.RESERVED:
            raise ParseError(f"expected a name, found {text or 'the end'}")
        self.at += 1
        return text

    def arithmetic(self, level: int) -> Term:
        roll = self.space.roll
        if level < 0:
            return roll("AExpr", "Neg", [self.term()]) if self.take("-") else self.term()
        left = self.arithmetic(level - 1)
        while op := self.take(*self.LEVELS[level]):
            left = roll("AExpr", "ABinary", [roll("ABinOp", self.LEVELS[level][op], []), left, self.arithmetic(level - 1)])
        return left

    def term(self) -> Term:
        roll, prim = self.space.roll, self.space.prim
        kind, text = self.peek()
        if self.take("("):
            out = self.arithmetic(2)
            self.need(")")
            return out
        if kind == "int":
            self.at += 1
            return roll("AExpr", "IntConst", [prim("Integer", str(int(text)))])
        if self.take("range"):
            return roll("AExpr", "ARange", [self.term(), self.term()])
        return roll("AExpr", "Var", [prim("String", self.name())])

    def boolean(self) -> Term:
        left = self.boolean_not()
        while op := self.take("and", "or"):
            left = self.space.roll("BExpr", "BBinary", [self.space.roll("BBinOp", op.capitalize(), []), left, self.boolean_not()])
        return left

    def boolean_not(self) -> Term:
        return self.space.roll("BExpr", "Not", [self.boolean_term()]) if self.take("not") else self.boolean_term()

    def boolean_term(self) -> Term:
        roll = self.space.roll
        if word := self.take("true", "false"):
            return roll("BExpr", "BoolConst", [self.space.prim("Bool", word.capitalize())])
        begin = self.at
        if self.take("("):
            try:
                out = self.boolean()
                self.need(")")
                if self.peek()[1] not in self.RELATIONS:
                    return out
            except ParseError:
                pass
            self.at = begin  # an arithmetic term in brackets
        left = self.arithmetic(2)
        op = self.take(*self.RELATIONS)
        if not op:
            raise ParseError("expected a relation")
        return roll("BExpr", "RBinary", [roll("RBinOp", self.RELATIONS[op], []), left, self.arithmetic(2)])


def while_(space: Space, text: str) -> Term:
    with deep():
        return _While(space, text).program()


class _Clojure:
    """Expressions with the separators between them."""

    #: Prefixes of special forms, brackets, and what a name may begin and go on with beside letters, digits and symbols.
    SPECIAL = {"'": "Quote", "`": "SQuote", "~": "UnQuote", "@": "DeRef", "^": "Meta"}
    BRACKETS = {"(": (")", "Parens"), "[": ("]", "Vec"), "{": ("}", "Set")}
    BEGIN = frozenset(":!#$%&*+./<=>?@\\^|-~_',")
    REST = frozenset(":!?#$%&*+-/.<=>'?@^|~_'^\"\\")
    STRING = re.compile(r'"((?:\\\\|\\"|[^"])*)"')

    def __init__(self, space: Space, text: str):
        self.space, self.text, self.at = space, text, 0

    def char(self) -> str:
        return self.text[self.at : self.at + 1]

    def blank(self) -> None:
        text, at = self.text, self.at
        while text[at : at + 1].isspace():
            at += 1
        self.at = at

    def top(self) -> Term:
        """All expressions of the text. Open brackets and prefixes are held on a stack; a prefix whose expression can't be read is a
        name's first character instead."""
        roll = self.space.roll
        frames: list[tuple] = [("top", "", [])]
        self.blank()
        while True:
            kind, close, items = frames[-1]
            value = None
            try:
                if kind == "top" and not self.char():
                    out = roll("Expr", "Empty", [])
                    for x in reversed(items):
                        out = roll("Expr", "Seq", [x, out])
                    return out
                if kind in self.BRACKETS and self.char() == close:
                    self.at += 1
                    value = self.collection(*frames.pop())
                elif kind in self.BRACKETS and not self.char():
                    raise ParseError(f"{close} is missing")
                else:
                    value = self.begin(frames)
            except ParseError:
                while value is None:
                    kind, begin, _ = frames.pop()
                    if kind == "top":
                        raise
                    if kind == "prefix":
                        self.at = begin
                        try:
                            value = roll("Expr", "Term", [self.tagged()])
                        except ParseError:
                            if not any(f[0] == "prefix" for f in frames):
                                raise
            while value is not None and frames[-1][0] == "prefix":
                _, _, form = frames.pop()
                value = roll("Expr", "Special", [roll("FormTy", form, []), value]) if form else roll("Expr", "Dispatch", [value])
            if value is not None and frames[-1][0] == "top":
                frames[-1][2].append(value)
                self.blank()
            elif value is not None:
                frames[-1][2].append((value, self.separator()))

    def begin(self, frames: list[tuple]) -> Term | None:
        """The expression that begins here, or None if it goes on with what is in a new frame."""
        roll, c = self.space.roll, self.char()
        if c and (c in self.SPECIAL or c == "#"):
            frames.append(("prefix", self.at, self.SPECIAL.get(c)))
            self.at += 1
            return None
        if c and c in self.BRACKETS:
            frames.append((c, self.BRACKETS[c][0], []))
            self.at += 1
            self.blank()
            return None
        if c == ";":
            end = self.text.find("\n", self.at)
            end = len(self.text) if end < 0 else end
            out = self.text[self.at + 1 : end]
            self.at = end + 1
            return roll("Expr", "Comment", [self.space.prim("Text", out)])
        return roll("Expr", "Term", [self.tagged()])

    def tagged(self) -> Term:
        roll, prim, c = self.space.roll, self.space.prim, self.char()
        if c == '"':
            m = self.STRING.match(self.text, self.at)
            if not m:
                raise ParseError(f"string without an end at {self.at}")
            self.at = m.end()
            return roll("Term", "TaggedString", [roll("Tag", "String", []), prim("Text", m[1])])
        if not c or not (c.isalnum() or c in self.BEGIN):
            raise ParseError(f"unexpected {c or 'end'} at {self.at}")
        begin, text, rest = self.at, self.text, self.REST
        at = begin + 1
        while (c := text[at : at + 1]) and (c.isalnum() or c in rest or _symbol(c)):
            at += 1
        self.at = at
        return roll("Term", "TaggedString", [roll("Tag", "Var", []), prim("Text", text[begin:at])])

    def collection(self, kind: str, close: str, items: list) -> Term:
        roll = self.space.roll
        out = roll("SepExprList", "Nil", [])
        for x, sep in reversed(items):
            out = roll("SepExprList", "Cons", [x, roll("Sep", sep, []), out])
        return roll("Expr", "Collection", [roll("CollTy", self.BRACKETS[kind][1], []), out])

    def separator(self) -> str:
        c = self.char()
        if c == ",":
            self.at += 1
            sep = "Comma"
        elif c == "\n":
            sep = "NewLine"
        elif c and c.isspace():
            sep = "Space"
        else:
            return "EmptySep"
        self.blank()
        return sep


def _symbol(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] == "S"


def clojure(space: Space, text: str) -> Term:
    return _Clojure(space, text).top()


def _bottom_up(root, kids_of, make) -> Term:
    """make(x, terms of its kids) from the leaves on, without recursion."""
    out: list[Term] = []
    stack = [(root, False)]
    while stack:
        x, ready = stack.pop()
        kids = kids_of(x)
        if ready or not kids:
            n = len(out) - len(kids)
            out[n:] = [make(x, out[n:])]
        else:
            stack.append((x, True))
            stack.extend((k, False) for k in reversed(kids))
    return out[0]


def _whole(text: str) -> str:
    """The text, if it can be stored: half a surrogate pair can't."""
    if not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text):
        raise ParseError("half a surrogate pair")
    return text


def python(space: Space, text: str) -> Term:
    """Python's own syntax trees without locations."""

    def kids(x) -> list:
        return [v for _, v in ast.iter_fields(x)] if isinstance(x, ast.AST) else x if isinstance(x, list) else []

    def make(x, terms: list[Term]) -> Term:
        if isinstance(x, ast.AST):
            base = type(x).__mro__[1]
            return space.roll((type(x) if base is ast.AST else base).__name__, type(x).__name__, terms)
        if isinstance(x, list):
            return space.list("node", terms)
        return space.prim(type(x).__name__, _whole(x) if isinstance(x, str) else repr(x))

    try:
        return _bottom_up(ast.parse(text), kids, make)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ParseError(str(e)) from None


def json_(space: Space, text: str) -> Term:
    """JSON values; members of objects keep their order."""

    def kids(x) -> list:
        return [*x.values()] if isinstance(x, dict) else x if isinstance(x, list) else []

    def make(x, terms: list[Term]) -> Term:
        if isinstance(x, dict):
            members = [space.roll("Member", "Member", [space.prim("String", _whole(k)), v]) for k, v in zip(x, terms, strict=True)]
            return space.roll("Value", "Object", [space.list("Member", members)])
        if isinstance(x, list):
            return space.roll("Value", "Array", [space.list("Value", terms)])
        return space.roll("Value", "Scalar", [space.prim("Null" if x is None else type(x).__name__, _whole(json.dumps(x, ensure_ascii=False)))])

    try:
        return _bottom_up(json.loads(text), kids, make)
    except (ValueError, RecursionError) as e:
        raise ParseError(str(e)) from None


Parser = Callable[[Space, str], Term]


def _language(name: str) -> Parser:
    """A parser of the module languages, which is loaded when it is first used."""

    def parse(space: Space, text: str) -> Term:
        from arbordiff.sources import languages

        return getattr(languages, name)(space, text)

    return parse


def _writer(name: str) -> Callable[[Term], str]:
    def write(t: Term) -> str:
        from arbordiff.sources import writers

        with deep():
            return getattr(writers, name)(t)

    return write


_parsers: dict[str, Parser] = {"while": while_, "lines": lines, "dyck": dyck, "dyck-loc": dyck_loc, "clj": clojure, "py": python, "json": json_, "rtree": rtree}
_parsers |= {"java": _language("java"), "js": _language("javascript"), "lua": _language("lua"), "sh": _language("shell")}
_unparsers: dict[str, Callable[[Term], str]] = {"lines": unparse_lines, "rtree": unparse_rtree, "while": _writer("program"), "clj": _writer("expressions")}
#: Of parsers that take names as values and ask nothing of a name but whether it is another's: what a name is (a group) and what only looks like one.
_NAMES: dict[Parser, tuple[re.Pattern, frozenset]] = {rtree: (re.compile(r"([^\[\],\s]+)"), frozenset()), while_: (re.compile(r"([^\W\d_][^\W_]*)"), _While.RESERVED)}


def register_grammar(name: str, parser: Parser, unparse: Callable[[Term], str] | None = None) -> None:
    """Adds a grammar; it goes to the executors with the functions that use it."""
    _parsers[name] = parser
    if unparse:
        _unparsers[name] = unparse


def registry() -> tuple[dict, dict]:
    return dict(_parsers), dict(_unparsers)


def install(parsers: dict, unparsers: dict) -> None:
    """On an executor: the grammars that the driver knows."""
    _parsers.update(parsers)
    _unparsers.update(unparsers)


def grammar(name: str) -> Parser:
    if name not in _parsers:
        raise KeyError(f"no grammar {name!r}; there are {', '.join(sorted(_parsers))}")
    return _parsers[name]


def outline(name: str, *texts: str | None) -> tuple | None:
    """The texts with names numbered by their first place in all of them: equal for texts that differ in names alone, one for one. None if
    the grammar doesn't tell names."""
    if (found := _NAMES.get(grammar(name))) is None:
        return None
    names, reserved = found
    number: dict[str, int] = {}
    out = []
    for t in texts:
        if t is not None:
            parts = names.split(t)
            for i in range(1, len(parts), 2):
                if (x := parts[i]) not in reserved:
                    parts[i] = number.setdefault(x, len(number))
            t = tuple(parts)
        out.append(t)
    return tuple(out)


def unparser(name: str) -> Callable[[Term], str] | None:
    return _unparsers.get(name)


def grammar_of_path(path: str) -> str | None:
    """The grammar that the suffix names; the suffix begins after the first dot."""
    suffix = path.partition(".")[2]
    return suffix if suffix in _parsers else None
