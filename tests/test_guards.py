"""What goes wrong in a row is its result: in node tables, SQL functions, streams and grids."""

import json
from collections import Counter

from arbordiff import api
from arbordiff.functions import kernels
from arbordiff.plans import experiments
from arbordiff.sources import grammars
from arbordiff.streaming.streams import version_diffs


def register_picky() -> None:
    def picky(space, text):  # goes to the workers by value
        if text == "boom":
            raise KeyError("no such thing")
        if text == "slow":
            while True:
                pass
        return grammars.lines(space, text)

    grammars.register_grammar("picky", picky)


def test_node_tables_tell_what_has_no_tree(spark):
    register_picky()
    frame = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None), (4, "b\nc")], "tree_id int, text string")
    for grammar, bad in (("picky", {2, 3}), ("lines", {3})):
        rows = api.tree_nodes(frame, "text", grammar, ["node_id", "digest", "parse_error"]).collect()
        assert {r.tree_id for r in rows if r.parse_error is not None} == bad == {r.tree_id for r in rows if r.node_id is None}
        assert {r.tree_id for r in api.tree_nodes(frame, "text", grammar, ["node_id"]).collect()} == {1, 2, 3, 4} - bad


def test_sql_functions_keep_to_the_row(spark):
    register_picky()
    kernels.register_sql(spark, seconds=2)
    spark.createDataFrame([("a",), ("boom",), (None,), ("slow",)], "t string").createOrReplaceTempView("rows_of_text")
    got = [json.loads(r.d)["status"] for r in spark.sql("SELECT tree_diff('picky', 'a', t) AS d FROM rows_of_text").collect()]
    assert got == ["success", "error", "parse-error", "timeout"]
    assert [r.a is None for r in spark.sql("SELECT tree_ast('picky', t) AS a FROM rows_of_text").collect()] == [False, True, True, True]


def test_streams_keep_to_the_row(spark, tmp_path):
    register_picky()
    source, schema = tmp_path / "in", "doc string, turn long, text string"
    spark.createDataFrame([("d", 0, "a"), ("d", 1, "boom"), ("d", 2, "b")], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = version_diffs(stream, "doc", "turn", "text", "picky").writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.turn, r.status) for r in spark.table("guarded").collect()} == {(0, "first"), (1, "error"), (2, "error")}


def test_a_grid_parses_each_pair_once_and_equals_its_configurations(spark):
    frame = spark.createDataFrame([(1, "a[b,c[d]]", "c[d,a[b]]"), (2, "a[", "a"), (3, None, "a"), (4, "x", "x")], "id int, src string, dst string")
    got = experiments.diff_grid(frame, "rtree").drop("secs")
    want = []
    for height in (1, 6):
        for mode in ("proper", "nonest", "patience"):
            for scope in ("local", "global"):
                rows = api.diff_pairs(frame.where("id in (1, 4)"), "src", "dst", "rtree", height, mode, scope == "global").drop("secs").collect()
                want += [(r.id, height, mode, scope, r.status, r.patch, r.cost, r.result) for r in rows]
    rows = got.collect()
    assert Counter((r.id, r.height, r.mode, r.scope, r.status, r.patch, r.cost, r.result) for r in rows if r.height) == Counter(want)
    assert Counter((r.id, r.status) for r in rows if r.height is None) == {(2, "parse-error"): 1, (3, "parse-error"): 1}


def test_locate_runs_nothing_by_itself(spark):
    names = spark.createDataFrame([("abc",), ("axc",), ("cba",)], "name string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    one, two = experiments.locate(names, "x", "c"), experiments.locate(names, "a", "b")
    assert jobs() == before
    assert [r.single for r in one.collect()] == [True] and [r.single for r in two.collect()] == [False, False]


def test_table_function_is_the_node_table(spark):
    kernels.register_sql(spark)
    frame = spark.createDataFrame([(1, "a[b,c[d]]"), (2, "a["), (3, None), (4, "x")], "tree_id int, text string")
    for grammar in ("rtree", "lines"):
        got = spark.sql("SELECT tree_id, n.* FROM {t} AS t, LATERAL tree_nodes('" + grammar + "', t.text) AS n", t=frame)
        assert sorted(map(str, got.collect())) == sorted(map(str, api.tree_nodes(frame, "text", grammar).collect()))
