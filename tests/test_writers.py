"""Text out of trees: it parses to the same tree, and merges of programs come out as programs."""

import random

import pytest

from arbordiff import api
from arbordiff.operators.terms import Space
from arbordiff.sources import grammars


def expression(rng, depth):
    if not depth or rng.random() < 0.2:
        return rng.choice(["a", "b1", "7", "0"])
    kind = rng.random()
    if kind < 0.6:
        return f"({expression(rng, depth - 1)}) {rng.choice('^*/%+-')} ({expression(rng, depth - 1)})"
    return f"-({expression(rng, depth - 1)})" if kind < 0.8 else f"range ({expression(rng, depth - 1)}) (x)"


def condition(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice(["true", "false", f"{expression(rng, 1)} < {expression(rng, 1)}", f"({expression(rng, 1)}) == 3"])
    return f"not ({condition(rng, depth - 1)})" if rng.random() < 0.3 else f"({condition(rng, depth - 1)}) {rng.choice(['and', 'or'])} ({condition(rng, depth - 1)})"


def block(rng, depth):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        if not depth or kind < 0.4:
            out.append(rng.choice(["skip;", f"x := {expression(rng, 3)};"]))
        elif kind < 0.7:
            out.append(f"if {condition(rng, 2)} then {{ {block(rng, depth - 1)} }} else {{ {block(rng, depth - 1)} }}")
        else:
            out.append(f"while {condition(rng, 2)} do {{ {block(rng, depth - 1)} }}")
    return " ".join(out)


def form(rng, depth):
    kind = rng.random()
    if not depth or kind < 0.4:
        return rng.choice(["a", "b-c", ":k", '"s t"', '"q\\"r"', "12", "+", "é"])
    if kind < 0.55:
        return rng.choice("'`~@^#") + form(rng, depth - 1)
    o, c = rng.choice(["()", "[]", "{}"])
    return o + "".join(form(rng, depth - 1) + rng.choice([" ", "\n", ", ", "  ", " ;note\n"]) for _ in range(rng.randint(0, 3))) + c


@pytest.mark.parametrize("name,make", [("while", lambda rng: block(rng, 3)), ("clj", lambda rng: "\n".join(form(rng, 3) for _ in range(rng.randint(0, 4))))])
def test_what_is_written_is_read_as_the_same_tree(name, make):
    parse, write = grammars.grammar(name), grammars.unparser(name)
    rng, good = random.Random(21), 0
    for _ in range(400):
        space, text = Space(), make(rng)
        try:
            tree = parse(space, text)
        except grammars.ParseError:
            continue
        again = parse(space, write(tree))
        assert again is tree, (text, write(tree))
        assert write(again) == write(tree)
        good += 1
    assert good > 200


def test_fixed_texts():
    space = Space()
    assert grammars.unparser("while")(grammars.while_(space, "if a<1 then {x:=(1+2)*3;} else skip; y := 2;")) == "if a < 1 then {\n  x := (1 + 2) * 3;\n} else {\n  skip;\n}\ny := 2;"
    assert grammars.unparser("clj")(grammars.clojure(space, "(defn  f [x]\n  (inc x)) 'q")) == "(defn f [x]\n(inc x))\n'q\n"


def test_merges_come_out_as_text(spark):
    rows = [("while", "x := 1; y := 9; z := 3;", "x := 1; y := 2; z := 3;", "x := 1; y := 2; z := 4;"), ("clj", "(f 1 2) (g 9)", "(f 1 2) (g 3)", "(f 8 2) (g 3)")]
    for name, a, o, b in rows:
        frame = spark.createDataFrame([(a, o, b)], "a string, o string, b string")
        got = api.merge_triples(frame, "a", "o", "b", name).first()
        assert got.status == "success"
        assert got.merged == {"while": "x := 1; y := 9; z := 4;", "clj": "(f 8 2) (g 9)"}[name]


WHILE = """// head
x := 1;   /* one */
if x < 2 then {
    y := 3;  // three
    skip;
} else   z := 4;
while true do { skip; }  // tail
"""
CLJ = """; head
(defn f [x]
   (inc x))   ; note

'q "s" ;; tail
#{1 2}
"""


@pytest.mark.parametrize("name,o,edits_a,edits_b", [
    ("while", WHILE, [("y := 3", "y := 33")], [("z := 4", "z := 44"), ("// tail", "// the tail")]),
    ("while", WHILE, [("x := 1;   /* one */", "x := 1;  /* one */\nw := 0;")], [("while true do { skip; }", "while true do { u := 1; }")]),
    ("while", WHILE, [("    skip;\n", "")], [("// head\n", "// a head\n")]),
    ("clj", CLJ, [("(inc x)", "(dec x)")], [('"s"', '"ss"'), (";; tail", ";; the end")]),
    ("clj", CLJ, [("#{1 2}", "#{1 2}\n(more)")], [("; head", "; the head")]),
])
def test_unchanged_text_stays_byte_by_byte(spark, name, o, edits_a, edits_b):
    def edited(*edits):
        out = o
        for old, new in edits:
            assert old in out
            out = out.replace(old, new, 1)
        return out

    frame = spark.createDataFrame([(edited(*edits_a), o, edited(*edits_b))], "a string, o string, b string")
    got = api.merge_triples(frame, "a", "o", "b", name).first()
    assert got.status == "success" and got.merged == edited(*edits_a, *edits_b)


def test_merged_layout_is_read_as_the_merged_tree():
    """Random programs: what is kept together is the merged tree again, and a merge with the base gives the side as it stands."""
    from arbordiff.operators import merging
    from arbordiff.sources import layouts

    rng, good = random.Random(8), 0
    for _ in range(150):
        for name, make in (("while", lambda: block(rng, 2)), ("clj", lambda: "\n".join(form(rng, 2) for _ in range(4)))):
            space, parse, write = Space(), grammars.grammar(name), grammars.unparser(name)
            texts = [make() for _ in range(3)]
            cut = [t.split(";" if name == "while" else "\n") for t in texts]
            texts = [texts[0], *((";" if name == "while" else "\n").join([*cut[0][:-1], *c[:1], cut[0][-1]]) for c in cut[1:])]
            try:
                o, a, b = (parse(space, t) for t in texts)
            except grammars.ParseError:
                continue
            assert layouts.keep(name, space, a, [texts[0], texts[1], texts[0]], write) == texts[1]
            status, merged, _ = merging.merge3(space, a, o, b)
            if status == "success":
                assert parse(space, layouts.keep(name, space, merged, texts, write)) is merged
                good += 1
    assert good > 20
