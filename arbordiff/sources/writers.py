"""Trees of programs and of expressions as text again. What is written parses to the same tree, as long as the tree is one that its grammar
makes; what a merge has put together differently (a list of one statement, say) is written as what it holds."""

from __future__ import annotations

from arbordiff.operators.terms import Term

#: How operators and separators are written, and how tightly operators bind (less is tighter).
ARITHMETIC = {"Power": ("^", 0), "Multiply": ("*", 1), "Divide": ("/", 1), "Reminder": ("%", 1), "Add": ("+", 2), "Subtract": ("-", 2)}
RELATIONS = {"Greater": ">", "Less": "<", "Equal": "=="}
PREFIXES = {"Quote": "'", "SQuote": "`", "UnQuote": "~", "DeRef": "@", "Meta": "^"}
BRACKETS = {"Parens": "()", "Vec": "[]", "Set": "{}"}
SEPARATORS = {"Comma": ", ", "NewLine": "\n", "Space": " ", "EmptySep": ""}


def items(t: Term) -> list[Term]:
    """The elements of a list."""
    out = []
    while t.con == ":":
        out.append(t.kids[0])
        t = t.kids[1]
    return out


def _level(x: Term) -> int:
    """0 to 2 for operators, -1 for a sign, -2 for what stands by itself."""
    return ARITHMETIC[x.kids[0].con][1] if x.con == "ABinary" else -1 if x.con == "Neg" else -2


def arithmetic(x: Term, at_most: int = 2) -> str:
    """x where operators up to a level may stand without brackets. Operators bind to the left."""
    if _level(x) > at_most:
        return f"({arithmetic(x)})"
    if x.con == "ABinary":
        op, level = ARITHMETIC[x.kids[0].con]
        return f"{arithmetic(x.kids[1], level)} {op} {arithmetic(x.kids[2], level - 1)}"
    if x.con == "Neg":
        return f"-{arithmetic(x.kids[0], -2)}"
    if x.con == "ARange":
        return f"range {arithmetic(x.kids[0], -2)} {arithmetic(x.kids[1], -2)}"
    return x.kids[0].con


def boolean(x: Term, whole: bool = True, bare: bool = False) -> str:
    """whole: and/or may stand without brackets; bare: not may not."""
    if x.con == "BBinary" and not whole or x.con == "Not" and bare:
        return f"({boolean(x)})"
    if x.con == "BBinary":
        return f"{boolean(x.kids[1])} {x.kids[0].con.lower()} {boolean(x.kids[2], False)}"
    if x.con == "Not":
        return f"not {boolean(x.kids[0], False, True)}"
    if x.con == "RBinary":
        return f"{arithmetic(x.kids[1])} {RELATIONS[x.kids[0].con]} {arithmetic(x.kids[2])}"
    return x.kids[0].con.lower()


def statements(x: Term) -> list[Term]:
    return [s for k in items(x.kids[0]) for s in statements(k)] if x.con == "Seq" else [x]


def program(t: Term) -> str:
    """A statement on each line, blocks in braces, two spaces further right. The stack holds what is still to be written."""
    out: list[str] = []
    stack: list = [(s, "") for s in reversed(statements(t))]
    while stack:
        x, indent = stack.pop()
        if isinstance(x, str):
            out.append(indent + x)
        elif x.con in ("If", "While"):
            head, blocks = (f"if {boolean(x.kids[0])} then {{", x.kids[1:]) if x.con == "If" else (f"while {boolean(x.kids[0])} do {{", x.kids[1:])
            parts: list = [(head, indent)]
            for i, block in enumerate(blocks):
                parts += [(s, indent + "  ") for s in statements(block)]
                parts.append(("} else {" if i < len(blocks) - 1 else "}", indent))
            stack.extend(reversed(parts))
        elif x.con == "Assign":
            out.append(f"{indent}{x.kids[0].con} := {arithmetic(x.kids[1])};")
        else:
            out.append(f"{indent}skip;")
    return "\n".join(out)


def _glued(left: str, right: str) -> bool:
    """Whether the last character of one and the first of the other would be read as one word."""
    word = "!#$%&*+./:<=>?@\\^|-~_'"
    return bool(left and right) and (left[-1].isalnum() or left[-1] in word) and (right[0].isalnum() or right[0] in word)


def expressions(t: Term) -> str:
    """Expressions with the separators that the tree has; those of the top on lines of their own."""
    out: list[str] = []

    def write(text: str) -> None:
        if text:
            out.append(" " + text if out and _glued(out[-1], text) and out[-1] not in closing else text)

    closing = {"'", "`", "~", "@", "^", "#"}  # a prefix belongs to what follows
    stack: list = [t]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            write(x)
        elif x.con == "Seq":
            stack += [x.kids[1], "\n", x.kids[0]] if x.kids[0].con != "Comment" else [x.kids[1], x.kids[0]]
        elif x.con == "Comment":
            write(f";{x.kids[0].con}\n")
        elif x.con == "Special":
            stack += [x.kids[1], PREFIXES[x.kids[0].con]]
        elif x.con == "Dispatch":
            stack += [x.kids[0], "#"]
        elif x.con == "Collection":
            begin, end = BRACKETS[x.kids[0].con]
            stack += [end, x.kids[1], begin]
        elif x.con == "Cons":
            stack += [x.kids[2], SEPARATORS[x.kids[1].con], x.kids[0]]
        elif x.con == "Term":
            tag, text = x.kids[0].kids
            write(f'"{text.con}"' if tag.con == "String" else text.con)
    return "".join(out)
