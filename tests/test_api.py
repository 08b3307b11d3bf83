"""The DataFrame operations: kernels against joins, grammars, files, streams and reports."""

import random

import pytest

from arbordiff import api
from arbordiff.functions import kernels
from arbordiff.operators import patches, sharing
from arbordiff.operators.patches import MODES, Options
from arbordiff.operators.terms import HOLE, Space, preorder, render
from arbordiff.plans import experiments
from arbordiff.sources import files, grammars


def random_tree(rng, depth):
    name = rng.choice("abcd")
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return name + (f"[{','.join(kids)}]" if kids else "")


@pytest.mark.parametrize("mode", MODES)
def test_joins_find_the_holes_of_the_kernel(spark, mode):
    rng = random.Random(1)
    pairs = [(f"p{i}", random_tree(rng, 4), random_tree(rng, 4)) for i in range(30)]
    sides = [(p, side, t) for p, a, b in pairs for side, t in (("src", a), ("dst", b))]
    nodes = api.tree_nodes(spark.createDataFrame(sides, "pair_id string, side string, text string"), "text", "rtree")
    found = sharing.extract_holes(nodes, sharing.sharing_map(nodes), mode)
    digests = found.join(nodes.select("pair_id", "side", "node_id", "digest", "size"), ["pair_id", "side", "node_id"])
    got: dict = {}
    for r in digests.collect():
        got.setdefault((r.pair_id, r.side), []).append((r.node_id, r.size))
    for p, a, b in pairs:
        space = Space()
        x, y = grammars.rtree(space, a), grammars.rtree(space, b)
        _, d, i = patches.extract(space, x, y, Options(mode=mode))
        for side, whole, cut in (("src", x, d), ("dst", y, i)):
            want, stack = [], [(whole, cut, 0)]
            while stack:
                w, c, n = stack.pop()
                if c.kind == HOLE:
                    want.append((n, w.size))
                else:
                    n += 1
                    for k, m in zip(w.kids, c.kids, strict=True):
                        stack.append((k, m, n))
                        n += k.size
            assert sorted(got.get((p, side), [])) == sorted(want)


def test_nulls_and_errors_are_rows(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "(", ")"), (3, "a b", "b a"), (4, "", "")], "id int, src string, dst string")
    got = {r.id: r for r in api.diff_pairs(frame, "src", "dst", "dyck").collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["parse-error", "parse-error", "success", "success"]
    assert api.diff_pairs(frame.limit(0), "src", "dst", "dyck").count() == 0
    parsed = {r.id: r for r in api.parse_trees(frame, "src", "dyck").collect()}
    assert parsed[1].ast is None and parsed[2].parse_error and parsed[4].n_nodes > 0
    merged = api.merge_triples(spark.createDataFrame([("x", None, "y")], "a string, o string, b string"), "a", "o", "b", "lines").first()
    assert merged.status == "parse-error"


def tree(name, text):
    return render(grammars.grammar(name)(Space(), text))


def test_grammars():
    assert tree("while", "skip;") == "Skip"
    assert tree("while", "x := 1 + 2 * 3; skip; )") == tree("while", "x := 1 + (2*3); skip;")
    assert tree("while", "x := 1; /* c */ y := -x ^ 2; // end") == tree("while", "x:=1;y:=(-x)^2;")
    assert tree("while", "if not (a < 1) and true then skip; else { x := range 1 2; y := x; }").startswith("(If")
    with pytest.raises(grammars.ParseError):
        tree("while", "x = 1;")
    assert tree("dyck", "a (b [c] {d})  e") == tree("dyck", "a\n(b[c]{ d })e")
    assert tree("dyck-loc", "a b") != tree("dyck-loc", "a  b")
    for bad in ("(", ")", "(]", "a)b"):
        with pytest.raises(grammars.ParseError):
            tree("dyck", bad)
    assert tree("clj", '(defn f [x] "s\\"t" #{1 2} \'q ; note\n)').startswith("(Seq (Collection Parens")
    assert tree("py", "x = 1") == tree("py", "x  =  1")
    assert tree("json", '{"a": [1, null]}') == tree("json", '{"a":[1,null]}')
    assert tree("lines", "") == tree("lines", "").strip() and tree("lines", "a\nb\n") == tree("lines", "a\nb") != tree("lines", "a\nb\n\n")
    assert grammars.grammar_of_path("x.while") == "while" and grammars.grammar_of_path("../x.while") is None
    deep = "(" * 5000 + ")" * 5000
    assert sum(1 for _ in preorder(grammars.dyck(Space(), deep))) > 10_000


def test_registered_grammar_reaches_the_executors(spark):
    grammars.register_grammar("words", lambda space, text: space.list("W", [space.prim("String", w) for w in text.split()]))
    out = api.parse_trees(spark.createDataFrame([("a b c",)], "t string"), "t", "words").first()
    assert out.n_nodes == 7


def test_sql_functions(spark):
    kernels.register_sql(spark)
    assert spark.sql("SELECT tree_ast('rtree', 'a[b]') AS x").first().x == '(:>: "a" (: (:>: "b" []) []))'
    assert '"status": "success"' in spark.sql("SELECT tree_diff('lines', 'a', 'b') AS x").first().x
    assert '"merged": "a[b\'"' not in spark.sql("SELECT tree_merge('rtree', 'a', 'a', 'b') AS x").first().x


def test_conflict_labels_are_appended(spark, tmp_path):
    frame = spark.createDataFrame([("x[u,a]", "x[u,b]", "x[u,c]")], "a string, o string, b string")
    out = api.merge_triples(frame, "a", "o", "b", "rtree")
    for n in (1, 2):
        api.write_conflict_labels(out, str(tmp_path / "labels"))
        assert spark.read.text(str(tmp_path / "labels")).count() == n
    assert "not-eq" in out.first().conflicts[0]


def test_files(spark, tmp_path):
    for name, parts in (("one", "OABM"), ("two", "OA")):
        (tmp_path / name).mkdir()
        for p in parts:
            (tmp_path / name / f"{p}.lines").write_text(f"{p}\n")
    got = {r.name: r for r in files.read_datapoints(spark, str(tmp_path), "lines").collect()}
    assert got["one"].m == "M\n" and got["two"].b is None
    whole, rejected = experiments.datapoints(files.read_datapoints(spark, str(tmp_path), "lines"))
    assert [r.name for r in whole.collect()] == ["one"] and [r.name for r in rejected.collect()] == ["two"]
    texts = files.read_texts(spark, str(tmp_path / "one"))
    assert {r.grammar for r in texts.collect()} == {"lines"} and texts.count() == 4
    legs = experiments.four_diffs(files.read_datapoints(spark, str(tmp_path), "lines"), "lines")
    assert legs.where("name = 'one'").count() == 4 and legs.where("name = 'two'").count() == 1


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 20)) for _ in range(2))
        assert kernels.lcs_length(a, b) == slow(a, b)


def test_versions_of_a_stream(spark, tmp_path):
    from arbordiff.streaming.streams import version_diffs

    source, schema = tmp_path / "in", "doc string, turn long, text string"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    rows = [("d", 0, "a\nb"), ("d", 1, "a\nc"), ("e", 0, "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    query = version_diffs(stream, "doc", "turn", "text", "lines").writeStream.format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([("e", 1, "x\ny")], schema).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.doc, r.turn): r.status for r in spark.table("versions").collect()}
    assert got == {("d", 0): "first", ("d", 1): "success", ("e", 0): "first", ("e", 1): "success"}


def test_log_lines(spark):
    rows = spark.createDataFrame([("p 1 nonest time(s):0.25 n+m:12 cost:3",), ("nonsense",)], "value string")
    assert experiments.parse_log(rows).collect() == [("p", 1, "nonest", "local", 0.25, 12, 3)]
    assert experiments.locate(spark.createDataFrame([("abc",), ("axc",)], "name string"), "a", "x").first().single
