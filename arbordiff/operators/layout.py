"""Trees, patches and conflicts over several lines of at most a given width, where this is possible.

A text is laid out as a stream of tokens: strings, breaks, and groups that hold both. A group that fits the rest of the line stays on it,
with its breaks as spaces; otherwise all its own breaks are new lines. Widths are added up once, from the end to the beginning, so that the work is
linear in the tokens, and nothing recurses."""

from __future__ import annotations

import json
from collections.abc import Iterator

from arbordiff.operators.merging import Conflict
from arbordiff.operators.patches import Change, Spine
from arbordiff.operators.terms import HOLE, PRIM, Term

WIDTH, INDENT = 80, 2
BREAK, CLOSE = object(), object()


class Open:
    """The beginning of a group; its lines stand `indent` further right than the group around it begins its own."""

    __slots__ = ("indent", "flat")

    def __init__(self, indent: int):
        self.indent, self.flat = indent, 0


def _leaf(x: Term) -> str | None:
    if x.kind == HOLE:
        return f"#{x.con}"
    if x.kind == PRIM:
        return json.dumps(x.con, ensure_ascii=False)
    return None if x.kids else x.con


def tokens(tree) -> Iterator:
    """The stream of a term, or of a patch with changes or conflicts at its leaves. A last child of its parent's own datatype, as the rest
    of a list is, goes no further right."""
    stack: list = [(tree, INDENT)]
    while stack:
        item = stack.pop()
        if not isinstance(item, tuple):
            yield item
            continue
        x, indent = item
        if isinstance(x, Change):
            parts = [Open(INDENT), "{{-", BREAK, (x.delete, INDENT), BREAK, "-}", BREAK, "{+", BREAK, (x.insert, INDENT), BREAK, "+}}", CLOSE]
        elif isinstance(x, Conflict):
            from arbordiff.operators.alignment import show_alignment

            mark = f">>>>>>> {x.label} <<<<<<<"
            parts = [Open(INDENT), f"{{!! {mark}", BREAK, show_alignment(x.left), BREAK, "===========", BREAK, show_alignment(x.right), BREAK, f"{mark} !!}}", CLOSE]
        elif isinstance(x, Term) and (text := _leaf(x)) is not None or isinstance(x, Spine) and not x.kids and (text := x.con):
            parts = [text]
        else:
            parts = [Open(indent), f"({x.con}"]
            for i, k in enumerate(x.kids):
                rest = i == len(x.kids) - 1 and isinstance(k, (Term, Spine)) and k.dtype == x.dtype
                parts += [BREAK, (k, 0 if rest else INDENT)]
            parts += [")", CLOSE]
        stack.extend(reversed(parts))


def layout(stream: Iterator, width: int = WIDTH) -> str:
    held = [*stream]
    # the width of each group on one line, together with what follows it up to the next break
    ends, total, trailing = [], 0, 0
    for x in reversed(held):
        if x is CLOSE:
            ends.append((total, trailing))
        elif isinstance(x, Open):
            end, after = ends.pop()
            x.flat = total - end + after
        elif x is BREAK:
            total, trailing = total + 1, 0
        else:
            total, trailing = total + len(x), trailing + len(x)
    out: list[str] = []
    column, groups = 0, [(0, True)]  # indent, and whether breaks are spaces
    for x in held:
        if isinstance(x, Open):
            indent, flat = groups[-1]
            groups.append((indent + x.indent, flat and len(groups) > 1 or column + x.flat <= width))
        elif x is CLOSE:
            groups.pop()
        elif x is BREAK:
            indent, flat = groups[-1]
            out.append(" " if flat else "\n" + " " * indent)
            column = column + 1 if flat else indent
        else:
            out.append(x)
            column += len(x)
    return "".join(out)


def pretty(tree, width: int = WIDTH) -> str:
    return layout(tokens(tree), width)
