"""Grammars of programming languages, and rows that must not fail a task."""

import json
import random

import pytest

from arbordiff import api
from arbordiff.operators import patches
from arbordiff.operators.terms import Space, render
from arbordiff.plans import experiments
from arbordiff.sources import grammars

PROGRAMS = {
    "lua": """#!/usr/bin/lua
local a, b = 1, [[x]] -- note
function m.n:o(x, ...) return x^-2 .. "k", #t end
for i = 1, 10, 2 do print{a = 1; [2] = 3, 4} end
for k, v in pairs(t) do if k then goto e elseif v < 1 then break else f"x" end end ::e::
while not done do repeat a.b["c"]:d(1, 2).e = nil until x == y end
""",
    "js": """#!/usr/bin/env node
var a = 1, b; // note
for (var i in o) { if (a) b++; else f(/x[/]/g.test(s)) }
x = function (a, b) { return a ? b : {c: 1, "d": [1, , 2], get e() { return 1 }} }
l: for (var i = 0, n = ("in" in o); i < 3; i++) { switch (a) { case 1: b(); break l; default: c } }
try { throw new A.B(1).c[2] } catch (e) { } finally { do x(); while (1) }
let f = (x, y) => x + y * 2
""",
    "java": """package a.b; import java.util.*; import static x.Y.z;
@Ann(a = 1, b = {2, 3}) public final class A<T extends Comparable<T> & B> extends C<Map<String, List<T>>> implements D, E {
  private static final int[] X = {1, 2}, Y = new int[3][];
  A(int a, String... b) throws IOException { super(a); this.x = a >>> 2 >> 1; i >>= 2; }
  <U> List<? extends U> m(final Map<K, V> k) {
    for (int i = 0; i < 10 && j >= 2; i++) { if (x instanceof Foo) continue; else break; }
    for (String s : list) System.out.println((int) s.length() + (String) o);
    q.forEach(x -> { y(x); }); q.map(String::valueOf); c = (a, b) -> a + b;
    try (R r = new R()) { throw new E("x"); } catch (A | B e) { } finally { }
    switch (k) { case 1: return; default: x[1]++; }
    Runnable r = new Runnable() { public void run() { } }; Class<?> z = int[].class; synchronized (this) { }
  }
  enum Z implements Q { P(1) { void f() { } }, R; int v; }
}
interface I extends J { void f(); }
""",
    "sh": """#!/bin/bash
set -e; x=1 y="a $b ${c:-d} $(ls -l | wc)" cmd -a 'b c' > out 2>&1 < in &
if [ -f "$1" ] && ! grep -q x; then echo a; elif true; then :; else exit 1; fi
for i in 1 2 "$@"; do echo $i; done; for ((i=0;i<3;i++)); do :; done
while read -r l; do case $l in a|b) echo ;; *) break;; esac; done < <(cat f)
f() { local a=(1 2 3); return $((a+1)); }
cat <<EOF | tee x
hello $a
EOF
[[ $a == b* ]] || { a; (b); } 2>/dev/null
""",
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_programs(name):
    text = PROGRAMS[name]
    parse = grammars.grammar(name)
    space = Space()
    t = parse(space, text)
    assert t.size > 80 and parse(space, text) is t
    assert parse(space, text.replace("\n", "\n\n").replace(" + ", "  +  ")) is t or name == "sh"  # blanks don't count
    # each change of a name is a change of that value only
    other = parse(space, text.replace("break", "break ;") if name == "lua" else text.replace("continue", "break"))
    assert patches.apply(space, patches.diff(space, t, other, patches.Options()), t) is other


@pytest.mark.parametrize(
    "name,text,tree",
    [
        ("lua", "x = -2 ^ 2 .. 3", '(Block (: (Assign (: (Var (Name "x")) []) (: (Binop .. (Unop - (Binop ^ (Number "2") (Number "2"))) (Number "3")) [])) []) Nothing)'),
        ("lua", "return a or b and not c", '(Block [] (Just (: (Binop or (Var (Name "a")) (Binop and (Var (Name "b")) (Unop not (Var (Name "c"))))) [])))'),
        ("js", "a = b\n++c", '(Script (: (ExprStmt (AssignExpr = (VarRef (Name "a")) (VarRef (Name "b")))) (: (ExprStmt (UnaryAssignExpr ++ (VarRef (Name "c")))) [])))'),
        ("js", "a - b - c * d", '(Script (: (ExprStmt (InfixExpr - (InfixExpr - (VarRef (Name "a")) (VarRef (Name "b"))) (InfixExpr * (VarRef (Name "c")) (VarRef (Name "d"))))) []))'),
        ("sh", "a && b | c &", '(List (: (Statement (And (Pipeline "False" (: (Command (SimpleCommand [] (: (Word (: (Chars "a") [])) []) []) []) [])) (Pipeline "False" (: (Command (SimpleCommand [] (: (Word (: (Chars "b") [])) []) []) []) (: (Command (SimpleCommand [] (: (Word (: (Chars "c") [])) []) []) []) [])))) Asynchronous) []))'),
    ],
)
def test_shapes(name, text, tree):
    assert render(grammars.grammar(name)(Space(), text)) == tree


BROKEN = {"lua": ["x =", "a b", "if x then", "f() = 1", "for i = 1 do end", '"'], "js": ["x = ", "a b", "if (", "1 = 2", "try {}", "{", "'"], "java": ["class {", "class A { int }", "import a", "class A { void f() { a b c; } }"], "sh": ["if a", 'echo "x', "(a", "f() {", "a )", "case x in a) b", "; ;"]}


@pytest.mark.parametrize("name", BROKEN)
def test_what_is_no_program(name):
    for text in BROKEN[name]:
        with pytest.raises(grammars.ParseError):
            grammars.grammar(name)(Space(), text)


def test_no_row_fails_a_task(spark):
    """Deep nesting, half surrogate pairs, and noise give a tree or a reason."""
    rng = random.Random(1)
    deep = [c * 60_000 + d * 60_000 for c, d in ("()", "[]", "{}", "''")] + ["(" * 60_000, "-" * 60_000 + "1", "a:=" + "(" * 60_000, "'" * 9_000 + "("]
    texts = [None, "", json.dumps("\ud800"), '{"\\ud800": 1}', "'\\ud800'", *deep, *("".join(rng.choices("()[]{}<>'\"\\;:=ab1 \n$#`|&-.,", k=rng.randint(1, 40))) for _ in range(150))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for name in ("clj", "json", "py", "while", "dyck", "rtree", "lua", "js", "java", "sh"):
        rows = api.parse_trees(frame, "text", name).collect()
        assert len(rows) == len(texts) and all((r.ast is None) != (r.parse_error is None) for r in rows)
        nodes = {r.id: r["count"] for r in api.tree_nodes(frame, "text", name, ["digest"]).groupBy("id").count().collect()}
        assert nodes == {r.id: r.n_nodes for r in rows if r.ast is not None}
    clj = {r.id: r for r in api.parse_trees(frame, "text", "clj").collect()}
    assert clj[texts.index(deep[0])].height > 60_000
    pairs = frame.selectExpr("id", "text as src", "reverse(text) as dst")
    found = {r.status for r in api.diff_pairs(pairs, "src", "dst", "sh").collect()} | {r.status for r in api.diff_pairs(pairs, "src", "dst", "clj").collect()}
    assert found <= {"success", "parse-error", "error"}


def test_budgets(spark):
    text = "\n".join(f"line {i % 977}" for i in range(60_000))
    frame = spark.createDataFrame([(1, "a\nb", "b\na"), (2, text, text[7:] + "\nx")], "id int, src string, dst string")
    got = {r.id: r.status for r in api.diff_pairs(frame, "src", "dst", "lines", seconds=0.3).collect()}
    assert got == {1: "success", 2: "timeout"}
    got = {r.id: r.status for r in api.diff_pairs(frame, "src", "dst", "lines", max_nodes=100).collect()}
    assert got == {1: "success", 2: "too-large"}
    triples = frame.selectExpr("id", "src as a", "src as o", "dst as b")
    assert {r.id: r.status for r in api.merge_triples(triples, "a", "o", "b", "lines", max_nodes=100).collect()} == {1: "success", 2: "too-large"}


def test_composable(spark):
    def patch(a, b):
        return api.diff_pairs(spark.createDataFrame([(a, b)], "src string, dst string"), "src", "dst", "lines").first().patch

    first, then, no = patch("a\nb", "a\nc"), patch("a\nc", "d\nc"), patch("x\ny\nz", "x")
    frame = spark.createDataFrame([(1, then, first), (2, no, first), (3, None, first), (4, "?", first)], "id int, q string, p string")
    got = {r.id: (r.composes, r.parse_error is None) for r in api.composable(frame, "q", "p").collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (None, False), 4: (None, False)}


def test_changes_are_shown_in_braces():
    space = Space()
    c = patches.Change(space.hole(0, None), space.prim("String", "x"))
    assert patches.show_change(c) == '{{- #0 -} {+ "x" +}}'


def test_grids_and_logs(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "b\na")], "id int, src string, dst string")
    got = experiments.diff_grid(pairs, "lines")
    assert {(r.height, r.mode, r.scope, r.status) for r in got.collect()} == {(h, m, s, "success") for h in (1, 6) for m in patches.MODES for s in ("local", "global")}
    log = spark.createDataFrame([("p 1 nonest global time(s):0.25 n+m:12 cost:3",), ("p 6 proper local conf",), ("x",)], "value string")
    assert [tuple(r) for r in experiments.parse_log(log).collect()] == [("p", 1, "nonest", "global", 0.25, 12, 3)]
    assert [tuple(r) for r in experiments.parse_merge_log(log).collect()] == [("p", 6, "proper", "local", "conf")]
    paths = spark.createDataFrame([("a.lua.x",), ("b.js.x",), ("c.py.x",)], "path string")
    assert {tuple(r) for r in experiments.of_languages(paths, ["lua", "js"]).collect()} == {("a.lua.x", "lua"), ("b.js.x", "js")}
