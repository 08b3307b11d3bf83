"""Parsers for Lua, JavaScript, Java and shell: tokens by a regular expression, then recursive descent with binding powers for operators.

Trees have a datatype for each kind of construct (Stat, Exp, ...), values for names and literals as they are written, and neither
comments nor places. What a grammar doesn't know is a ParseError.
"""

from __future__ import annotations

import re

from arbordiff.operators.terms import Space, Term
from arbordiff.sources.grammars import ParseError, deep


class Parser:
    """Tokens are (kind, text, whether a line ends before)."""

    TOKEN: re.Pattern
    #: Binding power of binary operators on their left, and those that bind more weakly on their right.
    BINARY: dict[str, int] = {}
    RIGHT: frozenset = frozenset()
    RESERVED: frozenset = frozenset()

    def __init__(self, space: Space, text: str):
        self.space, self.at = space, 0
        self.tokens: list[tuple[str, str, bool]] = []
        self.lex(text)

    def lex(self, text: str) -> None:
        at, broken = 0, False
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if m is None or m.end() == at:
                raise ParseError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup == "blank":
                broken |= "\n" in m[0]
            else:
                kind = "word" if m.lastgroup == "name" and m[0] in self.RESERVED else m.lastgroup
                self.tokens.append((kind, m[0], broken))
                broken = False
            at = m.end()
        self.tokens.append(("end", "", True))

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def is_(self, *texts: str, ahead: int = 0) -> bool:
        i = min(self.at + ahead, len(self.tokens) - 1)
        return self.tokens[i][0] in ("op", "word") and self.tokens[i][1] in texts

    def take(self, *texts: str) -> str | None:
        if self.is_(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> str:
        if not self.take(text):
            raise ParseError(f"expected {text}, found {self.text or 'the end'}")
        return text

    def name(self) -> Term:
        if self.kind != "name":
            raise ParseError(f"expected a name, found {self.text or 'the end'}")
        self.at += 1
        return self.roll("Name", "Name", self.space.prim("Text", self.tokens[self.at - 1][1]))

    def literal(self, con: str) -> Term:
        self.at += 1
        return self.roll("Exp", con, self.space.prim("Text", self.tokens[self.at - 1][1]))

    def roll(self, dtype: str, con: str, *kids: Term) -> Term:
        return self.space.roll(dtype, con, kids)

    def list(self, element: str, items) -> Term:
        return self.space.list(element, items)

    def maybe(self, element: str, x: Term | None) -> Term:
        return self.roll(f"Maybe {element}", "Nothing") if x is None else self.roll(f"Maybe {element}", "Just", x)

    def several(self, item, end: str, between: str = ",") -> list[Term]:
        """Items up to the token `end`, which goes, too; one more separator may stand before it."""
        out = []
        while not self.take(end):
            out.append(item())
            if not self.take(between):
                self.need(end)
                break
        return out

    def attempt(self, read):
        """What read() gives, or None and nothing read."""
        begin = self.at
        try:
            return read()
        except ParseError:
            self.at = begin
            return None

    def operand(self) -> Term:
        raise NotImplementedError

    def binary(self, least: int = 0) -> Term:
        left = self.operand()
        while self.kind in ("op", "word") and (power := self.BINARY.get(self.text, -1)) >= least:
            op = self.take(self.text)
            right = self.binary(power if op in self.RIGHT else power + 1)
            left = self.roll("Exp", "Binop", self.roll("Binop", op), left, right)
        return left


class Lua(Parser):
    TOKEN = re.compile(
        r"(?P<blank>\s+|\A\#[^\n]*|--\[(?P<l1>=*)\[.*?\](?P=l1)\]|--[^\n]*)|(?P<name>[A-Za-z_]\w*)|(?P<number>0[xX][\da-fA-F.]+(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
        r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\[(?P<l2>=*)\[.*?\](?P=l2)\])|(?P<op>\.\.\.|\.\.|::|==|~=|<=|>=|<<|>>|//|[-+*/%^#&~|<>=(){}\[\];:,.])",
        re.S,
    )
    #: Reserved words and the binding powers of operators.
    RESERVED = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
    BINARY = {"or": 1, "and": 2, "<": 3, ">": 3, "<=": 3, ">=": 3, "~=": 3, "==": 3, "|": 4, "~": 5, "&": 6, "<<": 7, ">>": 7, "..": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "^": 12}
    RIGHT = frozenset(("..", "^"))

    def lex(self, text: str) -> None:
        super().lex(text)
        self.tokens = [("string" if k in ("l2",) else k, t, b) for k, t, b in self.tokens if k != "l1"]

    def program(self) -> Term:
        out = self.block()
        if self.kind != "end":
            raise ParseError(f"unexpected {self.text}")
        return out

    def block(self) -> Term:
        stats, result = [], None
        while self.kind != "end" and not self.is_("end", "else", "elseif", "until"):
            if self.take(";"):
                continue
            if self.take("return"):
                stop = self.kind == "end" or self.is_("end", "else", "elseif", "until", ";")
                result = self.list("Exp", [] if stop else self.expressions())
                self.take(";")
                break
            stats.append(self.statement())
        return self.roll("Block", "Block", self.list("Stat", stats), self.maybe("[Exp]", result))

    def ended(self) -> Term:
        out = self.block()
        self.need("end")
        return out

    def expressions(self) -> list[Term]:
        out = [self.binary()]
        while self.take(","):
            out.append(self.binary())
        return out

    def names(self) -> list[Term]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def statement(self) -> Term:
        roll = self.roll
        if self.take("if"):
            arms = [self.arm()]
            while self.take("elseif"):
                arms.append(self.arm())
            other = self.block() if self.take("else") else None
            self.need("end")
            return roll("Stat", "If", self.list("(Exp, Block)", arms), self.maybe("Block", other))
        if self.take("while"):
            test = self.binary()
            self.need("do")
            return roll("Stat", "While", test, self.ended())
        if self.take("do"):
            return roll("Stat", "Do", self.ended())
        if self.take("repeat"):
            body = self.block()
            self.need("until")
            return roll("Stat", "Repeat", body, self.binary())
        if self.take("for"):
            names = self.names()
            if len(names) == 1 and self.take("="):
                bounds = self.expressions()
                if len(bounds) not in (2, 3):
                    raise ParseError("a loop has two or three bounds")
                self.need("do")
                return roll("Stat", "ForRange", names[0], bounds[0], bounds[1], self.maybe("Exp", bounds[2] if len(bounds) > 2 else None), self.ended())
            self.need("in")
            over = self.expressions()
            self.need("do")
            return roll("Stat", "ForIn", self.list("Name", names), self.list("Exp", over), self.ended())
        if self.take("function"):
            path = [self.name()]
            while self.take("."):
                path.append(self.name())
            method = self.name() if self.take(":") else None
            return roll("Stat", "FunAssign", roll("FunName", "FunName", self.list("Name", path), self.maybe("Name", method)), self.function())
        if self.take("local"):
            if self.take("function"):
                return roll("Stat", "LocalFunAssign", self.name(), self.function())
            names = []
            while True:
                names.append(self.name())
                if self.take("<"):  # an attribute
                    names[-1] = roll("Name", "Attributed", names[-1], self.name())
                    self.need(">")
                if not self.take(","):
                    break
            return roll("Stat", "LocalAssign", self.list("Name", names), self.maybe("[Exp]", self.list("Exp", self.expressions()) if self.take("=") else None))
        if self.take("goto"):
            return roll("Stat", "Goto", self.name())
        if self.take("break"):
            return roll("Stat", "Break")
        if self.take("::"):
            out = roll("Stat", "Label", self.name())
            self.need("::")
            return out
        targets = [self.prefixed()]
        if self.is_("=", ","):
            while self.take(","):
                targets.append(self.prefixed())
            self.need("=")
            if any(t.con not in ("Var", "Select", "SelectName") for t in targets):
                raise ParseError("what is assigned to is no variable")
            return roll("Stat", "Assign", self.list("Exp", targets), self.list("Exp", self.expressions()))
        if targets[0].con not in ("Call", "MethodCall"):
            raise ParseError("an expression is no statement")
        return roll("Stat", "FunCall", targets[0])

    def arm(self) -> Term:
        test = self.binary()
        self.need("then")
        return self.roll("(Exp, Block)", "(,)", test, self.block())

    def function(self) -> Term:
        self.need("(")
        names, more = [], False
        while not self.take(")"):
            more = bool(self.take("..."))
            if not more:
                names.append(self.name())
            if more or not self.take(","):
                self.need(")")
                break
        return self.roll("FunBody", "FunBody", self.list("Name", names), self.space.prim("Bool", str(more)), self.ended())

    def operand(self) -> Term:
        if self.is_("not", "#", "-", "~"):
            op = self.take(self.text)
            return self.roll("Exp", "Unop", self.roll("Unop", op), self.binary(11))
        if self.kind in ("number", "string"):
            return self.literal("Number" if self.kind == "number" else "String")
        if word := self.take("nil", "true", "false", "..."):
            return self.roll("Exp", {"nil": "Nil", "...": "Vararg"}.get(word, "Bool"), *([self.space.prim("Bool", word)] if word in ("true", "false") else []))
        if self.take("function"):
            return self.roll("Exp", "Function", self.function())
        return self.table() if self.is_("{") else self.prefixed()

    def prefixed(self) -> Term:
        roll = self.roll
        if self.take("("):
            out = roll("Exp", "Paren", self.binary())
            self.need(")")
        else:
            out = roll("Exp", "Var", self.name())
        while True:
            if self.take("."):
                out = roll("Exp", "SelectName", out, self.name())
            elif self.take("["):
                out = roll("Exp", "Select", out, self.binary())
                self.need("]")
            elif self.take(":"):
                out = roll("Exp", "MethodCall", out, self.name(), self.arguments())
            elif self.is_("(", "{") or self.kind == "string":
                out = roll("Exp", "Call", out, self.arguments())
            else:
                return out

    def arguments(self) -> Term:
        if self.kind == "string":
            return self.roll("FunArg", "StringArg", self.literal("String"))
        if self.is_("{"):
            return self.roll("FunArg", "TableArg", self.table())
        self.need("(")
        return self.roll("FunArg", "Args", self.list("Exp", self.several(self.binary, ")")))

    def table(self) -> Term:
        self.need("{")
        fields = []
        while not self.take("}"):
            if self.take("["):
                key = self.binary()
                self.need("]")
                self.need("=")
                fields.append(self.roll("TableField", "ExpField", key, self.binary()))
            elif self.kind == "name" and self.is_("=", ahead=1):
                key = self.name()
                self.need("=")
                fields.append(self.roll("TableField", "NamedField", key, self.binary()))
            else:
                fields.append(self.roll("TableField", "Field", self.binary()))
            if not self.take(",", ";"):
                self.need("}")
                break
        return self.roll("Exp", "TableConst", self.list("TableField", fields))


class JavaScript(Parser):
    TOKEN = re.compile(
        r"(?P<blank>\s+|\A\#![^\n]*|//[^\n]*|/\*.*?\*/)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>0[xXbBoO][\da-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
        r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<op>>>>=|\.\.\.|===|!==|>>>|<<=|>>=|=>|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|[-+*/%&|^~!<>=?:;,.(){}\[\]])",
        re.S,
    )
    REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
    #: Reserved words, assignments and the binding powers of operators.
    RESERVED = frozenset("break case catch const continue debugger default delete do else false finally for function if in instanceof new null return switch this throw true try typeof var void while with".split())
    ASSIGN = frozenset("= += -= *= /= %= <<= >>= >>>= &= ^= |=".split())
    BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    VALUES = {"this": "ThisRef", "null": "NullLit", "true": "BoolLit", "false": "BoolLit"}

    def lex(self, text: str) -> None:
        at, broken = 0, False
        while at < len(text):
            before = self.tokens[-1][:2] if self.tokens else ("op", "")
            value = before[0] in ("name", "number", "string", "regex") or before[1] in (")", "]", "}", "this", "null", "true", "false")
            m = self.TOKEN.match(text, at)
            kind = m.lastgroup if m else ""
            if m and kind == "op" and text[at] == "/" and not value and (r := self.REGEX.match(text, at)):
                m, kind = r, "regex"
            if m is None:
                raise ParseError(f"unexpected {text[at]!r} at {at}")
            if kind == "blank":
                broken |= "\n" in m[0]
            else:
                self.tokens.append(("word" if kind == "name" and m[0] in self.RESERVED else kind, m[0], broken))
                broken = False
            at = m.end()
        self.tokens.append(("end", "", True))
        self.plain_in = True

    def program(self) -> Term:
        out = []
        while self.kind != "end":
            out.append(self.statement())
        return self.roll("JavaScript", "Script", self.list("Statement", out))

    def ended(self) -> None:
        """A semicolon, or where one may be left out."""
        if not self.take(";") and not self.is_("}") and not self.tokens[self.at][2]:
            raise ParseError(f"unexpected {self.text}")

    def block(self) -> Term:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.kind == "end":
                raise ParseError("} is missing")
            out.append(self.statement())
        return self.list("Statement", out)

    def in_brackets(self) -> Term:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def statement(self) -> Term:
        roll = self.roll
        if self.is_("{"):
            return roll("Statement", "BlockStmt", self.block())
        if self.take(";"):
            return roll("Statement", "EmptyStmt")
        if self.is_("var", "const") or self.kind == "name" and self.text == "let" and self.tokens[self.at + 1][0] == "name":
            out = self.variables()
            self.ended()
            return out
        if self.is_("function"):
            self.take("function")
            return roll("Statement", "FunctionStmt", self.name(), *self.function())
        if self.take("if"):
            test, yes = self.in_brackets(), self.statement()
            return roll("Statement", "IfStmt", test, yes, self.maybe("Statement", self.statement() if self.take("else") else None))
        if self.take("while"):
            return roll("Statement", "WhileStmt", self.in_brackets(), self.statement())
        if self.take("do"):
            body = self.statement()
            self.need("while")
            out = roll("Statement", "DoWhileStmt", body, self.in_brackets())
            self.take(";")
            return out
        if self.take("for"):
            return self.loop()
        if word := self.take("break", "continue"):
            label = self.name() if self.kind == "name" and not self.tokens[self.at][2] else None
            self.ended()
            return roll("Statement", word.capitalize() + "Stmt", self.maybe("Name", label))
        if word := self.take("return", "throw"):
            value = None if self.is_(";", "}") or self.tokens[self.at][2] else self.expression()
            self.ended()
            return roll("Statement", word.capitalize() + "Stmt", self.maybe("Exp", value))
        if self.take("debugger"):
            self.ended()
            return roll("Statement", "DebuggerStmt")
        if self.take("with"):
            return roll("Statement", "WithStmt", self.in_brackets(), self.statement())
        if self.take("switch"):
            over, cases = self.in_brackets(), []
            self.need("{")
            while not self.take("}"):
                test = None if self.take("default") else (self.need("case"), self.expression())[1]
                self.need(":")
                body = []
                while not self.is_("case", "default", "}"):
                    body.append(self.statement())
                cases.append(roll("CaseClause", "CaseDefault", self.list("Statement", body)) if test is None else roll("CaseClause", "CaseClause", test, self.list("Statement", body)))
            return roll("Statement", "SwitchStmt", over, self.list("CaseClause", cases))
        if self.take("try"):
            body, catch, last = self.block(), None, None
            if self.take("catch"):
                self.need("(")
                name = self.name()
                self.need(")")
                catch = roll("CatchClause", "CatchClause", name, self.block())
            if self.take("finally"):
                last = self.block()
            if catch is None and last is None:
                raise ParseError("try without catch or finally")
            return roll("Statement", "TryStmt", body, self.maybe("CatchClause", catch), self.maybe("[Statement]", last))
        if self.kind == "name" and self.is_(":", ahead=1):
            label = self.name()
            self.need(":")
            return roll("Statement", "LabelledStmt", label, self.statement())
        out = roll("Statement", "ExprStmt", self.expression())
        self.ended()
        return out

    def variables(self) -> Term:
        kind = self.text
        self.at += 1
        out = []
        while True:
            name = self.name()
            out.append(self.roll("VarDecl", "VarDecl", name, self.maybe("Exp", self.assignment() if self.take("=") else None)))
            if not self.take(","):
                return self.roll("Statement", "VarDeclStmt", self.space.prim("Text", kind), self.list("VarDecl", out))

    def loop(self) -> Term:
        self.need("(")
        first = None
        self.plain_in = False  # `in` isn't an operator here
        if self.is_("var", "const") or self.kind == "name" and self.text == "let" and self.tokens[self.at + 1][0] == "name":
            first = self.variables()
        elif not self.is_(";"):
            first = self.expression()
        self.plain_in = True
        if first is not None and (self.is_("in") or self.kind == "name" and self.text == "of"):
            con = "ForInStmt" if self.text == "in" else "ForOfStmt"
            self.at += 1
            over = self.expression()
            self.need(")")
            return self.roll("Statement", con, first, over, self.statement())
        self.need(";")
        test = None if self.is_(";") else self.expression()
        self.need(";")
        step = None if self.is_(")") else self.expression()
        self.need(")")
        return self.roll("Statement", "ForStmt", self.maybe("Init", first), self.maybe("Exp", test), self.maybe("Exp", step), self.statement())

    def function(self) -> tuple[Term, Term]:
        self.need("(")
        names = self.several(self.name, ")")
        return self.list("Name", names), self.block()

    def expression(self) -> Term:
        out = [self.assignment()]
        while self.take(","):
            out.append(self.assignment())
        return out[0] if len(out) == 1 else self.roll("Exp", "ListExpr", self.list("Exp", out))

    def arrow(self) -> Term:
        names = [self.name()] if self.kind == "name" else (self.need("("), self.several(self.name, ")"))[1]
        self.need("=>")
        return self.list("Name", names)

    def assignment(self) -> Term:
        if (self.kind == "name" and self.is_("=>", ahead=1)) or (self.is_("(") and (self.is_(")", ahead=1) or self.tokens[self.at + 1][0] == "name" and self.is_(")", ",", ahead=2))):
            if (names := self.attempt(self.arrow)) is not None:
                return self.roll("Exp", "ArrowExpr", names, self.roll("Statement", "BlockStmt", self.block()) if self.is_("{") else self.assignment())
        left = self.binary()
        if self.take("?"):
            held, self.plain_in = self.plain_in, True
            yes = self.assignment()
            self.plain_in = held
            self.need(":")
            return self.roll("Exp", "CondExpr", left, yes, self.assignment())
        if self.kind == "op" and self.text in self.ASSIGN:
            if left.con not in ("VarRef", "DotRef", "BracketRef"):
                raise ParseError("what is assigned to is no variable")
            op = self.take(self.text)
            return self.roll("Exp", "AssignExpr", self.roll("AssignOp", op), left, self.assignment())
        return left

    def binary(self, least: int = 0) -> Term:
        left = self.operand()
        while self.kind in ("op", "word") and (power := self.BINARY.get(self.text, -1)) >= least and (self.plain_in or self.text != "in"):
            op = self.take(self.text)
            left = self.roll("Exp", "InfixExpr", self.roll("InfixOp", op), left, self.binary(power + 1))
        return left

    def operand(self) -> Term:
        if self.is_("delete", "void", "typeof", "+", "-", "~", "!", "++", "--"):
            op = self.take(self.text)
            return self.roll("Exp", "UnaryAssignExpr" if op in ("++", "--") else "PrefixExpr", self.roll("PrefixOp", op), self.operand())
        out = self.called(self.member())
        if self.is_("++", "--") and not self.tokens[self.at][2]:
            return self.roll("Exp", "UnaryAssignExpr", self.roll("PostfixOp", self.take(self.text)), out)
        return out

    def called(self, out: Term) -> Term:
        while self.is_("(", ".", "["):
            if self.take("("):
                out = self.roll("Exp", "CallExpr", out, self.list("Exp", self.several(self.argument, ")")))
            else:
                out = self.selected(out)
        return out

    def argument(self) -> Term:
        return self.roll("Exp", "SpreadExpr", self.assignment()) if self.take("...") else self.assignment()

    def selected(self, out: Term) -> Term:
        if self.take("."):
            if self.kind not in ("name", "word"):
                raise ParseError(f"expected a name, found {self.text}")
            self.at += 1
            return self.roll("Exp", "DotRef", out, self.roll("Name", "Name", self.space.prim("Text", self.tokens[self.at - 1][1])))
        self.need("[")
        held, self.plain_in = self.plain_in, True
        out = self.roll("Exp", "BracketRef", out, self.expression())
        self.plain_in = held
        self.need("]")
        return out

    def member(self) -> Term:
        if self.take("new"):
            made = self.member()
            while self.is_(".", "["):
                made = self.selected(made)
            return self.roll("Exp", "NewExpr", made, self.list("Exp", self.several(self.argument, ")") if self.take("(") else []))
        return self.primary()

    def primary(self) -> Term:
        held, self.plain_in = self.plain_in, True
        try:
            if self.kind in ("number", "string", "regex"):
                return self.literal({"number": "NumLit", "string": "StringLit", "regex": "RegexpLit"}[self.kind])
            if self.is_(*self.VALUES):
                return self.literal(self.VALUES[self.text])
            if self.take("function"):
                name = self.name() if self.kind == "name" else None
                return self.roll("Exp", "FuncExpr", self.maybe("Name", name), *self.function())
            if self.take("("):
                out = self.expression()
                self.need(")")
                return out
            if self.take("["):
                out = []
                while not self.take("]"):
                    if self.take(","):
                        out.append(self.roll("Exp", "Hole"))
                        continue
                    out.append(self.argument())
                    if not self.take(","):
                        self.need("]")
                        break
                return self.roll("Exp", "ArrayLit", self.list("Exp", out))
            if self.take("{"):
                return self.roll("Exp", "ObjectLit", self.list("Prop", self.several(self.property, "}")))
            return self.roll("Exp", "VarRef", self.name())
        finally:
            self.plain_in = held

    def property(self) -> Term:
        if self.kind not in ("name", "word", "string", "number"):
            raise ParseError(f"unexpected {self.text or 'end'} in an object")
        kind, text, _ = self.tokens[self.at]
        self.at += 1
        key = self.roll("Prop", {"string": "PropString", "number": "PropNum"}.get(kind, "PropId"), self.space.prim("Text", text))
        if text in ("get", "set") and self.kind in ("name", "word", "string", "number"):
            key = self.roll("Prop", "PropId", self.space.prim("Text", self.text))
            self.at += 1
            return self.roll("Prop", "Accessor", self.space.prim("Text", text), key, *self.function())
        if self.is_("("):
            return self.roll("Prop", "Method", key, *self.function())
        if kind == "name" and self.is_(",", "}"):
            return self.roll("Prop", "Short", key)
        self.need(":")
        return self.roll("Prop", "Value", key, self.assignment())


class Java(Parser):
    TOKEN = re.compile(
        r"(?P<blank>\s+|//[^\n]*|/\*.*?\*/)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>0[xXbB][\da-fA-F_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
        r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')|(?P<op>\.\.\.|<<=|->|::|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]=|[-+*/%&|^~!<>=?:;,.(){}\[\]@])",
        re.S,
    )
    #: Reserved words, kinds of them, assignments and the binding powers of operators.
    PRIMITIVE = frozenset("boolean byte short int long char float double".split())
    MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
    RESERVED = frozenset("assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try void while true false null".split()) | PRIMITIVE | MODIFIERS
    ASSIGN = frozenset("= += -= *= /= %= <<= &= ^= |=".split())
    BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    VALUES = {"this": "This", "null": "Null", "true": "Boolean", "false": "Boolean"}

    def program(self) -> Term:
        package = self.attempt(self.package)
        imports, types = [], []
        while self.take("import"):
            static = self.space.prim("Bool", str(bool(self.take("static"))))
            path = [self.name()]
            while self.take(".") and not self.is_("*"):
                path.append(self.name())
            imports.append(self.roll("ImportDecl", "ImportDecl", static, self.list("Name", path), self.space.prim("Bool", str(bool(self.take("*"))))))
            self.need(";")
        while self.kind != "end":
            if not self.take(";"):
                types.append(self.type_decl(self.modifiers()))
        return self.roll("CompilationUnit", "CompilationUnit", self.maybe("PackageDecl", package), self.list("ImportDecl", imports), self.list("TypeDecl", types))

    def package(self) -> Term:
        self.modifiers()
        self.need("package")
        out = self.roll("PackageDecl", "PackageDecl", self.path())
        self.need(";")
        return out

    def path(self) -> Term:
        out = [self.name()]
        while self.is_(".") and self.tokens[self.at + 1][0] == "name":
            self.take(".")
            out.append(self.name())
        return self.list("Name", out)

    def modifiers(self) -> Term:
        out = []
        while True:
            if self.is_("@") and not self.is_("interface", ahead=1):
                out.append(self.annotation())
            elif self.is_("default") and self.is_(":", "->", ahead=1):
                break
            elif self.kind == "word" and self.text in self.MODIFIERS and not (self.is_("synchronized") and self.is_("(", ahead=1)):
                out.append(self.roll("Modifier", self.take(self.text).capitalize()))
            else:
                break
        return self.list("Modifier", out)

    def annotation(self) -> Term:
        self.need("@")
        path, values = self.path(), []
        if self.take("("):
            values = self.several(self.element, ")")
        return self.roll("Modifier", "Annotation", path, self.list("Element", values))

    def element(self) -> Term:
        name = None
        if self.kind == "name" and self.is_("=", ahead=1):
            name = self.name()
            self.need("=")
        return self.roll("Element", "Element", self.maybe("Name", name), self.initial())

    def initial(self) -> Term:
        if self.take("{"):
            return self.roll("VarInit", "InitArray", self.list("VarInit", self.several(self.initial, "}")))
        return self.roll("VarInit", "InitAnnotation", self.annotation()) if self.is_("@") else self.roll("VarInit", "InitExp", self.expression())

    # Types

    def type(self) -> Term:
        while self.is_("@"):
            self.annotation()
        if self.kind == "word" and self.text in self.PRIMITIVE:
            out = self.roll("Type", "PrimType", self.space.prim("Text", self.take(self.text)))
        else:
            parts = [self.class_part()]
            while self.is_(".") and self.tokens[self.at + 1][0] == "name":
                self.take(".")
                parts.append(self.class_part())
            out = self.roll("Type", "ClassType", self.list("ClassPart", parts))
        return self.dimensions(out)

    def dimensions(self, out: Term) -> Term:
        while self.is_("[") and self.is_("]", ahead=1):
            self.at += 2
            out = self.roll("Type", "ArrayType", out)
        return out

    def class_part(self) -> Term:
        return self.roll("ClassPart", "ClassPart", self.name(), self.list("TypeArgument", self.type_arguments()))

    def type_arguments(self) -> list[Term]:
        return self.several(self.type_argument, ">") if self.take("<") else []

    def type_argument(self) -> Term:
        if not self.take("?"):
            return self.roll("TypeArgument", "ActualType", self.type())
        bound = self.take("extends", "super")
        return self.roll("TypeArgument", f"Wildcard {bound}", self.type()) if bound else self.roll("TypeArgument", "Wildcard")

    def type_parameters(self) -> Term:
        def one() -> Term:
            name = self.name()
            return self.roll("TypeParam", "TypeParam", name, self.list("Type", self.types("&") if self.take("extends") else []))

        return self.list("TypeParam", self.several(one, ">") if self.take("<") else [])

    def types(self, between: str = ",") -> list[Term]:
        out = [self.type()]
        while self.take(between):
            out.append(self.type())
        return out

    # Declarations

    def type_decl(self, modifiers: Term) -> Term:
        roll = self.roll
        if self.take("class"):
            name, parameters = self.name(), self.type_parameters()
            base = self.type() if self.take("extends") else None
            faces = self.types() if self.take("implements") else []
            return roll("TypeDecl", "ClassDecl", modifiers, name, parameters, self.maybe("Type", base), self.list("Type", faces), self.body())
        if self.take("interface"):
            name, parameters = self.name(), self.type_parameters()
            return roll("TypeDecl", "InterfaceDecl", modifiers, name, parameters, self.list("Type", self.types() if self.take("extends") else []), self.body())
        if self.is_("@") and self.is_("interface", ahead=1):
            self.at += 2
            return roll("TypeDecl", "AnnotationDecl", modifiers, self.name(), self.body())
        self.need("enum")
        name, faces, constants = self.name(), self.types() if self.take("implements") else [], []
        self.need("{")
        while not self.is_(";", "}"):
            marks, own = self.modifiers(), self.name()
            arguments = self.several(self.expression, ")") if self.take("(") else []
            constants.append(roll("EnumConstant", "EnumConstant", marks, own, self.list("Exp", arguments), self.maybe("[Decl]", self.body() if self.is_("{") else None)))
            if not self.take(","):
                break
        members = self.members() if self.take(";") else (self.need("}"), [])[1]
        return roll("TypeDecl", "EnumDecl", modifiers, name, self.list("Type", faces), self.list("EnumConstant", constants), self.list("Decl", members))

    def body(self) -> Term:
        self.need("{")
        return self.list("Decl", self.members())

    def members(self) -> list[Term]:
        out = []
        while not self.take("}"):
            if not self.take(";"):
                out.append(self.member())
        return out

    def member(self) -> Term:
        roll = self.roll
        if self.is_("static") and self.is_("{", ahead=1):
            self.at += 1
            return roll("Decl", "InitDecl", self.space.prim("Bool", "True"), self.block())
        if self.is_("{"):
            return roll("Decl", "InitDecl", self.space.prim("Bool", "False"), self.block())
        modifiers = self.modifiers()
        if self.is_("class", "interface", "enum", "@"):
            return roll("Decl", "MemberTypeDecl", self.type_decl(modifiers))
        parameters = self.type_parameters()
        if self.kind == "name" and self.is_("(", ahead=1):
            return roll("Decl", "ConstructorDecl", modifiers, parameters, self.name(), self.formals(), self.throws(), self.block())
        kind = None if self.take("void") else self.type()
        if self.kind == "name" and self.is_("(", ahead=1):
            name, formals = self.name(), self.formals()
            kind = kind and self.dimensions(kind)
            throws = self.throws()
            default = self.initial() if self.take("default") else None
            code = self.block() if self.is_("{") else (self.need(";"), None)[1]
            return roll("Decl", "MethodDecl", modifiers, parameters, self.maybe("Type", kind), name, formals, throws, self.maybe("VarInit", default), self.maybe("Block", code))
        if kind is None:
            raise ParseError("a field has a type")
        out = roll("Decl", "FieldDecl", modifiers, kind, self.variables())
        self.need(";")
        return out

    def formals(self) -> Term:
        def one() -> Term:
            modifiers, kind = self.modifiers(), self.type()
            more = self.space.prim("Bool", str(bool(self.take("..."))))
            if self.take("this"):
                return self.roll("FormalParam", "Receiver", kind)
            name = self.name()
            return self.roll("FormalParam", "FormalParam", modifiers, self.dimensions(kind), more, name)

        self.need("(")
        return self.list("FormalParam", self.several(one, ")"))

    def throws(self) -> Term:
        return self.list("Type", self.types() if self.take("throws") else [])

    def variables(self) -> Term:
        out = []
        while True:
            name = self.name()
            sizes = self.dimensions(self.roll("Type", "Same"))
            out.append(self.roll("VarDecl", "VarDecl", name, sizes, self.maybe("VarInit", self.initial() if self.take("=") else None)))
            if not self.take(","):
                return self.list("VarDecl", out)

    # Statements

    def block(self) -> Term:
        self.need("{")
        out = []
        while not self.take("}"):
            out.append(self.statement())
        return self.roll("Block", "Block", self.list("Stmt", out))

    def local(self) -> Term:
        modifiers, kind = self.modifiers(), self.type()
        if self.kind != "name" or not self.is_("=", ";", ",", ":", "[", ahead=1):
            raise ParseError("no declaration")
        return self.roll("Stmt", "LocalVars", modifiers, kind, self.variables())

    def in_brackets(self) -> Term:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def statement(self) -> Term:
        roll = self.roll
        if self.is_("{"):
            return roll("Stmt", "StmtBlock", self.block())
        if self.take(";"):
            return roll("Stmt", "Empty")
        if self.take("if"):
            test, yes = self.in_brackets(), self.statement()
            return roll("Stmt", "If", test, yes, self.maybe("Stmt", self.statement() if self.take("else") else None))
        if self.take("while"):
            return roll("Stmt", "While", self.in_brackets(), self.statement())
        if self.take("do"):
            body = self.statement()
            self.need("while")
            out = roll("Stmt", "Do", body, self.in_brackets())
            self.need(";")
            return out
        if self.take("for"):
            return self.loop()
        if self.take("switch"):
            over, groups = self.in_brackets(), []
            self.need("{")
            while not self.take("}"):
                test = None if self.take("default") else (self.need("case"), self.expression())[1]
                self.need(":")
                body = []
                while not self.is_("case", "default", "}"):
                    body.append(self.statement())
                groups.append(roll("SwitchGroup", "SwitchGroup", self.maybe("Exp", test), self.list("Stmt", body)))
            return roll("Stmt", "Switch", over, self.list("SwitchGroup", groups))
        if self.take("try"):
            resources = self.several(self.resource, ")", ";") if self.take("(") else []
            body, catches = self.block(), []
            while self.take("catch"):
                self.need("(")
                modifiers, kinds, name = self.modifiers(), self.types("|"), self.name()
                self.need(")")
                catches.append(roll("Catch", "Catch", modifiers, self.list("Type", kinds), name, self.block()))
            last = self.block() if self.take("finally") else None
            if not (resources or catches or last):
                raise ParseError("try without catch or finally")
            return roll("Stmt", "Try", self.list("Stmt", resources), body, self.list("Catch", catches), self.maybe("Block", last))
        if word := self.take("return", "throw"):
            value = None if self.is_(";") else self.expression()
            self.need(";")
            return roll("Stmt", word.capitalize(), self.maybe("Exp", value))
        if word := self.take("break", "continue"):
            label = self.name() if self.kind == "name" else None
            self.need(";")
            return roll("Stmt", word.capitalize(), self.maybe("Name", label))
        if self.take("assert"):
            test = self.expression()
            out = roll("Stmt", "Assert", test, self.maybe("Exp", self.expression() if self.take(":") else None))
            self.need(";")
            return out
        if self.is_("synchronized") and self.is_("(", ahead=1):
            self.at += 1
            return roll("Stmt", "Synchronized", self.in_brackets(), self.block())
        if self.kind == "name" and self.is_(":", ahead=1):
            label = self.name()
            self.need(":")
            return roll("Stmt", "Labeled", label, self.statement())
        if (out := self.attempt(self.local)) is not None:
            self.need(";")
            return out
        if self.is_("class", "abstract", "final", "static", "enum", "interface", "@"):
            return roll("Stmt", "LocalClass", self.type_decl(self.modifiers()))
        out = roll("Stmt", "ExpStmt", self.expression())
        self.need(";")
        return out

    def resource(self) -> Term:
        return self.attempt(self.local) or self.roll("Stmt", "ExpStmt", self.expression())

    def loop(self) -> Term:
        self.need("(")
        first = None
        if not self.is_(";"):
            first = self.attempt(self.local) or self.roll("Stmt", "Exps", self.list("Exp", self.expressions()))
        if first is not None and self.take(":"):
            over = self.expression()
            self.need(")")
            return self.roll("Stmt", "EnhancedFor", first, over, self.statement())
        self.need(";")
        test = None if self.is_(";") else self.expression()
        self.need(";")
        steps = [] if self.is_(")") else self.expressions()
        self.need(")")
        return self.roll("Stmt", "BasicFor", self.maybe("Stmt", first), self.maybe("Exp", test), self.list("Exp", steps), self.statement())

    # Expressions

    def expressions(self) -> list[Term]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def lambda_head(self) -> Term:
        if self.kind == "name":
            out = self.list("FormalParam", [self.name()])
        else:
            out = self.attempt(self.formals)
            if out is None or not self.is_("->"):
                raise ParseError("no lambda")
        self.need("->")
        return out

    def plain_head(self) -> Term:
        self.need("(")
        out = self.list("FormalParam", self.several(self.name, ")"))
        self.need("->")
        return out

    def expression(self) -> Term:
        roll = self.roll
        if self.kind == "name" and self.is_("->", ahead=1) or self.is_("("):
            head = self.attempt(self.lambda_head) or (self.attempt(self.plain_head) if self.is_("(") else None)
            if head is not None:
                return roll("Exp", "Lambda", head, self.block() if self.is_("{") else self.expression())
        left = self.binary()
        if self.take("?"):
            yes = self.expression()
            self.need(":")
            return roll("Exp", "Cond", left, yes, self.expression())
        op = self.text if self.kind == "op" and self.text in self.ASSIGN else self.shift() if self.is_(">") else ""
        if op in self.ASSIGN or op in (">>=", ">>>="):
            if left.con not in ("ExpName", "FieldAccess", "ArrayAccess", "Paren"):
                raise ParseError("what is assigned to is no variable")
            self.at += max(1, op.count(">"))
            return roll("Exp", "Assign", roll("AssignOp", op), left, self.expression())
        return left

    def shift(self) -> str:
        """What the signs > from here on make together; each is a token, as they also close type arguments."""
        out, i = "", self.at
        while len(out) < 3 and self.tokens[i][1] in (">", ">=") and not out.endswith("="):
            out += self.tokens[i][1]
            i += 1
        return out

    def binary(self, least: int = 0) -> Term:
        left = self.operand()
        while self.kind in ("op", "word"):
            op = self.shift() if self.is_(">", ">=") else self.text
            if (power := self.BINARY.get(op, -1)) < least:
                break
            self.at += op.count(">") or 1
            right = self.type() if op == "instanceof" else self.binary(power + 1)
            left = self.roll("Exp", "BinOp", self.roll("Op", op), left, right)
        return left

    def cast(self) -> Term:
        self.need("(")
        kinds = self.types("&")
        self.need(")")
        plain = kinds[0].con == "PrimType"
        if not plain and not (self.kind in ("name", "string", "number") or self.is_("(", "!", "~", "new", "super", *self.VALUES)):
            raise ParseError("no cast")
        value = self.expression() if self.kind == "name" and self.is_("->", ahead=1) or self.is_("(") and self.attempt(self.arrow_ahead) else self.operand()
        return self.roll("Exp", "Cast", self.list("Type", kinds), value)

    def arrow_ahead(self) -> bool:
        begin = self.at
        self.attempt(self.lambda_head) or self.plain_head()
        self.at = begin
        return True

    def operand(self) -> Term:
        roll = self.roll
        if self.is_("+", "-", "!", "~", "++", "--"):
            return roll("Exp", "PreOp", roll("Op", self.take(self.text)), self.operand())
        if self.is_("(") and (out := self.attempt(self.cast)) is not None:
            return out
        out = self.primary()
        while True:
            if self.take("."):
                if self.take("new"):
                    out = roll("Exp", "QualInstanceCreation", out, self.creation())
                elif self.take("class"):
                    out = roll("Exp", "ClassLit", out)
                elif self.take("this"):
                    out = roll("Exp", "ThisClass", out)
                elif self.take("super"):
                    out = roll("Exp", "SuperClass", out)
                else:
                    kinds, name = self.type_arguments(), self.name()
                    out = roll("Exp", "MethodCall", out, self.list("TypeArgument", kinds), name, self.arguments()) if self.is_("(") else roll("Exp", "FieldAccess", out, name)
            elif self.take("["):
                out = roll("Exp", "ArrayAccess", out, self.expression())
                self.need("]")
            elif self.take("::"):
                out = roll("Exp", "MethodRef", out, roll("Name", "New") if self.take("new") else self.name())
            elif self.is_("++", "--"):
                out = roll("Exp", "PostOp", roll("Op", self.take(self.text)), out)
            else:
                return out

    def arguments(self) -> Term:
        self.need("(")
        return self.list("Exp", self.several(self.expression, ")"))

    def reference(self) -> Term:
        """A type before '::' or '.class' that is no expression."""
        kind = self.type()
        if not (self.is_("::") or self.is_(".") and self.is_("class", ahead=1)) or kind.con == "ClassType" and not any(p.kids[1].con == ":" for p in _items(kind.kids[0])):
            raise ParseError("no type")
        return self.roll("Exp", "TypeName", kind)

    def primary(self) -> Term:
        roll = self.roll
        if self.kind in ("number", "string"):
            return self.literal("Number" if self.kind == "number" else "String")
        if self.is_("this", "super") and self.is_("(", ahead=1):
            return roll("Exp", "ConstructorCall", self.space.prim("Text", self.take(self.text)), self.arguments())
        if self.take("super"):
            return roll("Exp", "Super")
        if self.is_(*self.VALUES):
            return self.literal(self.VALUES[self.text])
        if self.take("("):
            out = roll("Exp", "Paren", self.expression())
            self.need(")")
            return out
        if self.take("new"):
            return self.creation()
        if self.is_("void") and self.is_(".", ahead=1):
            self.at += 1
            return roll("Exp", "TypeName", roll("Type", "Void"))
        if self.kind == "word" or self.is_("[", ahead=1) or self.is_("<", ahead=1):
            if (out := self.attempt(self.reference)) is not None:
                return out
        name = self.name()
        return roll("Exp", "Call", name, self.arguments()) if self.is_("(") else roll("Exp", "ExpName", name)

    def creation(self) -> Term:
        roll = self.roll
        kind = roll("Type", "PrimType", self.space.prim("Text", self.take(self.text))) if self.kind == "word" and self.text in self.PRIMITIVE else None
        if kind is None:
            parts = [self.class_part()]
            while self.take("."):
                parts.append(self.class_part())
            kind = roll("Type", "ClassType", self.list("ClassPart", parts))
        if self.is_("["):
            sizes = []
            while self.take("["):
                sizes.append(self.maybe("Exp", None if self.is_("]") else self.expression()))
                self.need("]")
            return roll("Exp", "ArrayCreate", kind, self.list("Maybe Exp", sizes), self.maybe("VarInit", self.initial() if self.is_("{") else None))
        arguments = self.arguments()
        return roll("Exp", "InstanceCreation", kind, arguments, self.maybe("[Decl]", self.body() if self.is_("{") else None))


def _items(xs: Term):
    while xs.con == ":":
        yield xs.kids[0]
        xs = xs.kids[1]


class Shell:
    """Lists of commands. Words are made of plain text, quotes, parameters and substitutions."""

    #: Words that end a list, and redirections.
    CLOSERS = frozenset(("then", "else", "elif", "fi", "do", "done", "esac", "}"))
    REDIRECT = re.compile(r"(\d*|\{\w+\})(<<<|<<-|<<|<>|<&|>&|>>|>\||&>>|&>|<|>)(?!\()")
    ASSIGN = re.compile(r"([A-Za-z_]\w*(?:\[[^\]\n]*\])?)(\+?=)")
    PLAIN = re.compile(r"(?:\\.|[^\s\\'\"`$|&;()<>])+", re.S)

    def __init__(self, space: Space, text: str):
        self.space, self.text, self.at = space, text, 0
        self.skip: dict[int, int] = {}  # from the end of a line to the end of the here-documents that follow it

    def roll(self, dtype: str, con: str, *kids: Term) -> Term:
        return self.space.roll(dtype, con, kids)

    def list(self, element: str, items) -> Term:
        return self.space.list(element, items)

    def value(self, text: str) -> Term:
        return self.space.prim("Text", text)

    def fail(self, what: str):
        raise ParseError(f"{what} at {self.at}")

    def starts(self, *texts: str) -> bool:
        return self.text.startswith(texts, self.at)

    def blanks(self) -> None:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in " \t\r":
                self.at += 1
            elif self.starts("\\\n"):
                self.at += 2
            elif c == "#" and (self.at == 0 or self.text[self.at - 1] in " \t\r\n;&|()"):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                return

    def lines(self) -> bool:
        """Skips blanks, comments and ends of lines; whether a line ended."""
        ended = False
        while True:
            self.blanks()
            if not self.starts("\n"):
                return ended
            self.at, ended = self.skip.pop(self.at, self.at + 1), True

    def keyword(self) -> str:
        m = re.compile(r"[A-Za-z]+|[{}!]|\[\[").match(self.text, self.at)
        if m and (m.end() == len(self.text) or self.text[m.end()] in " \t\r\n;&|()<>"):
            return m[0]
        return ""

    def take(self, word: str) -> bool:
        self.blanks()
        if self.keyword() == word:
            self.at += len(word)
            return True
        return False

    def need(self, word: str) -> None:
        self.lines()
        if not self.take(word):
            self.fail(f"expected {word}")

    def program(self) -> Term:
        out = self.commands()
        if self.at < len(self.text):
            self.fail("unexpected text")
        return out

    def commands(self) -> Term:
        """A list of statements, up to what closes it."""
        out = []
        while True:
            self.lines()
            if self.at >= len(self.text) or self.starts(")", ";;", ";&") or self.keyword() in self.CLOSERS:
                return self.roll("List", "List", self.list("Statement", out))
            body, mark = self.chain(), "Sequential"
            self.blanks()
            if self.starts("&") and not self.starts("&&", "&>"):
                self.at, mark = self.at + 1, "Asynchronous"
            elif self.starts(";") and not self.starts(";;", ";&"):
                self.at += 1
            elif not (self.starts("\n", ")", ";;", ";&") or self.at >= len(self.text)):
                self.fail("unexpected text")
            out.append(self.roll("Statement", "Statement", body, self.roll("ListTerm", mark)))

    def chain(self) -> Term:
        left = self.pipeline()
        while True:
            self.blanks()
            if not self.starts("&&", "||"):
                return left
            con = "And" if self.starts("&&") else "Or"
            self.at += 2
            self.lines()
            left = self.roll("AndOr", con, left, self.pipeline())

    def pipeline(self) -> Term:
        bang = False
        while self.take("!"):
            bang = not bang
        parts = [self.command()]
        while True:
            self.blanks()
            if not self.starts("|") or self.starts("||"):
                break
            self.at += 2 if self.starts("|&") else 1
            self.lines()
            parts.append(self.command())
        return self.roll("Pipeline", "Pipeline", self.space.prim("Bool", str(bang)), self.list("Command", parts))

    def command(self) -> Term:
        self.blanks()
        body = self.shell_command()
        redirections = []
        while (r := self.redirection()) is not None:
            redirections.append(r)
        return self.roll("Command", "Command", body, self.list("Redir", redirections))

    def shell_command(self) -> Term:
        roll, word = self.roll, self.keyword()
        if self.starts("(("):
            m = re.compile(r"\(\((.*?)\)\)", re.S).match(self.text, self.at)
            if m:
                self.at = m.end()
                return roll("ShellCommand", "Arith", self.value(m[1]))
        if self.starts("("):
            self.at += 1
            body = self.commands()
            self.close(")")
            return roll("ShellCommand", "Subshell", body)
        if word == "{":
            self.at += 1
            return roll("ShellCommand", "Group", self.until("}"))
        if word == "[[":
            end = re.compile(r"\s\]\](?=[\s;&|)]|$)").search(self.text, self.at)
            if not end:
                self.fail("]] is missing")
            out = roll("ShellCommand", "Cond", self.value(self.text[self.at + 2 : end.start()].strip()))
            self.at = end.end()
            return out
        if word == "if":
            return self.branches()
        if word in ("while", "until"):
            self.at += len(word)
            test = self.commands()
            self.need("do")
            return roll("ShellCommand", word.capitalize(), test, self.until("done"))
        if word in ("for", "select"):
            self.at += len(word)
            return self.loop(word)
        if word == "case":
            self.at += 4
            return self.cases()
        m = re.compile(r"(?:function[ \t]+([^\s(){}]+)[ \t]*(?:\([ \t]*\))?|([^\s(){}$'\"`;&|<>=]+)[ \t]*\([ \t]*\))").match(self.text, self.at)
        if m:
            self.at = m.end()
            self.lines()
            return roll("ShellCommand", "FunctionDef", self.value(m[1] or m[2]), self.command())
        return self.simple()

    def until(self, word: str) -> Term:
        out = self.commands()
        self.need(word)
        return out

    def close(self, text: str) -> None:
        self.lines()
        if not self.starts(text):
            self.fail(f"{text} is missing")
        self.at += len(text)

    def branches(self) -> Term:
        arms, other = [], self.list("List", [])
        while True:
            self.at += 2 if self.starts("if") else 4
            test = self.commands()
            self.need("then")
            arms.append(self.roll("Arm", "Arm", test, self.commands()))
            self.lines()
            if self.keyword() != "elif":
                break
        if self.take("else"):
            other = self.list("List", [self.commands()])
        self.need("fi")
        return self.roll("ShellCommand", "If", self.list("Arm", arms), other)

    def loop(self, word: str) -> Term:
        self.blanks()
        if self.starts("(("):
            m = re.compile(r"\(\((.*?)\)\)", re.S).match(self.text, self.at)
            if not m:
                self.fail(")) is missing")
            self.at = m.end()
            self.separator()
            self.need("do")
            return self.roll("ShellCommand", "ArithFor", self.value(m[1]), self.until("done"))
        m = re.compile(r"[A-Za-z_]\w*").match(self.text, self.at)
        if not m:
            self.fail("expected a name")
        self.at = m.end()
        self.lines()
        words = None
        if self.take("in"):
            words = []
            while (w := self.word()) is not None:
                words.append(w)
        self.separator()
        self.need("do")
        over = self.roll("WordList", "Args") if words is None else self.roll("WordList", "WordList", self.list("Word", words))
        return self.roll("ShellCommand", word.capitalize(), self.value(m[0]), over, self.until("done"))

    def separator(self) -> None:
        self.blanks()
        if self.starts(";"):
            self.at += 1
        self.lines()

    def cases(self) -> Term:
        over = self.word() or self.fail("expected a word")
        self.need("in")
        clauses = []
        while True:
            self.lines()
            if self.take("esac"):
                return self.roll("ShellCommand", "Case", over, self.list("CaseClause", clauses))
            if self.starts("("):
                self.at += 1
            patterns = [self.word() or self.fail("expected a pattern")]
            self.blanks()
            while self.starts("|"):
                self.at += 1
                patterns.append(self.word() or self.fail("expected a pattern"))
                self.blanks()
            self.close(")")
            body, end = self.commands(), "Break"
            self.lines()
            for text, con in ((";;&", "Continue"), (";;", "Break"), (";&", "FallThrough")):
                if self.starts(text):
                    self.at, end = self.at + len(text), con
                    break
            else:
                if self.keyword() != "esac":
                    self.fail(";; is missing")
            clauses.append(self.roll("CaseClause", "CaseClause", self.list("Word", patterns), body, self.roll("CaseTerm", end)))

    def simple(self) -> Term:
        assigned, words, redirections = [], [], []
        while True:
            if (r := self.redirection()) is not None:
                redirections.append(r)
                continue
            m = self.ASSIGN.match(self.text, self.at)
            if m and (not words or self.text.startswith("(", m.end())):  # after a command's name only lists, as declarations have them
                self.at = m.end()
                if self.starts("("):
                    self.at += 1
                    items = []
                    while True:
                        self.lines()
                        if (w := self.word()) is None:
                            break
                        items.append(w)
                    self.close(")")
                    value = self.roll("RValue", "RArray", self.list("Word", items))
                else:
                    spans = self.spans()
                    value = self.roll("RValue", "RValue", self.list("Span", spans))
                assigned.append(self.roll("Assign", "Assign", self.value(m[1]), self.roll("AssignOp", m[2]), value))
                continue
            if (w := self.word()) is None:
                break
            words.append(w)
        if not (assigned or words or redirections):
            self.fail("expected a command")
        return self.roll("ShellCommand", "SimpleCommand", self.list("Assign", assigned), self.list("Word", words), self.list("Redir", redirections))

    def redirection(self) -> Term | None:
        self.blanks()
        m = self.REDIRECT.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        self.blanks()
        begin = self.at
        target = self.word() or self.fail("expected a word")
        if m[2] not in ("<<", "<<-"):
            return self.roll("Redir", "Redir", self.value(m[1]), self.roll("RedirOp", m[2]), target)
        raw = self.text[begin : self.at]
        end = re.sub(r"['\"\\]", "", raw)
        line = self.text.find("\n", self.at)
        if line < 0:
            self.fail("the here-document is missing")
        at = self.skip.get(line, line + 1)
        body = []
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            text, at = self.text[at:stop], stop + 1
            if (text.lstrip("\t") if m[2] == "<<-" else text) == end:
                break
            body.append(text)
        self.skip[line] = at
        return self.roll("Redir", "Heredoc", self.roll("HeredocOp", m[2]), self.value(raw), self.value("\n".join(body)))

    def word(self) -> Term | None:
        self.blanks()
        spans = self.spans()
        return self.roll("Word", "Word", self.list("Span", spans)) if spans else None

    def spans(self) -> list[Term]:
        out = []
        while self.at < len(self.text):
            if m := self.PLAIN.match(self.text, self.at):
                self.at = m.end()
                out.append(self.roll("Span", "Chars", self.value(m[0])))
            elif self.starts("'", "$'"):
                self.at += 1 + self.starts("$")
                m = re.compile(r"[^']*'").match(self.text, self.at) or self.fail("' is missing")
                self.at = m.end()
                out.append(self.roll("Span", "Single", self.value(m[0][:-1])))
            elif self.starts('"'):
                self.at += 1
                out.append(self.roll("Span", "Double", self.list("Span", self.quoted())))
            elif self.starts("$", "`"):
                out.append(self.dollar())
            elif self.starts("<(", ">("):
                con = "In" if self.starts("<") else "Out"
                self.at += 2
                body = self.commands()
                self.close(")")
                out.append(self.roll("Span", "ProcessSubst", self.roll("ProcessSubstOp", con), body))
            else:
                break
        return out

    def quoted(self) -> list[Term]:
        out = []
        plain = re.compile(r'(?:\\.|[^"\\$`])+', re.S)
        while True:
            if m := plain.match(self.text, self.at):
                self.at = m.end()
                out.append(self.roll("Span", "Chars", self.value(m[0])))
            elif self.starts('"'):
                self.at += 1
                return out
            elif self.starts("$", "`"):
                out.append(self.dollar())
            else:
                self.fail('" is missing')

    def dollar(self) -> Term:
        if self.starts("`"):
            m = re.compile(r"`((?:\\.|[^`\\])*)`", re.S).match(self.text, self.at) or self.fail("` is missing")
            self.at = m.end()
            return self.roll("Span", "Backquote", self.value(m[1]))
        if self.starts("$(("):
            if m := re.compile(r"\$\(\((.*?)\)\)", re.S).match(self.text, self.at):
                self.at = m.end()
                return self.roll("Span", "ArithSubst", self.value(m[1]))
        if self.starts("$("):
            self.at += 2
            body = self.commands()
            self.close(")")
            return self.roll("Span", "CommandSubst", body)
        if self.starts("${"):
            depth, i = 0, self.at + 1
            while i < len(self.text):
                c = self.text[i]
                if c == "\\":
                    i += 1
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        break
                i += 1
            else:
                self.fail("} is missing")
            out = self.roll("Span", "ParamSubst", self.value(self.text[self.at + 2 : i]))
            self.at = i + 1
            return out
        m = re.compile(r"\$(?:[A-Za-z_]\w*|[0-9@*#?$!-])?").match(self.text, self.at)
        self.at = m.end()
        return self.roll("Span", "Param", self.value(m[0][1:]))


def lua(space: Space, text: str) -> Term:
    with deep():
        return Lua(space, text).program()


def javascript(space: Space, text: str) -> Term:
    with deep():
        return JavaScript(space, text).program()


def java(space: Space, text: str) -> Term:
    with deep():
        return Java(space, text).program()


def shell(space: Space, text: str) -> Term:
    with deep():
        return Shell(space, text).program()
