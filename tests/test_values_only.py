"""Node tables of values alone: the same rows as a filter of the whole table, and no others leave the workers."""

import pytest

from arbordiff import api
from arbordiff.operators.terms import PRIM, Space, node_columns
from arbordiff.sources.grammars import grammar

TEXTS = {"clj": "(defn f [x] {:part 17 :size 3})", "sh": "run 17 --size 3 > out", "js": "var x = {part: 17, size: [3]};", "lua": "local t = {part = 17} -- end", "java": "class A { int[] x = {17, 3}; }", "py": "x = [17, 3]", "lines": "a\nb\na"}


@pytest.mark.parametrize("name", TEXTS)
def test_values_of_a_node_table(spark, name):
    rows = spark.createDataFrame([(1, TEXTS[name]), (2, None), (3, TEXTS[name])], "id int, text string")
    columns = ["node_id", "parent_id", "ord", "depth", "last_id", "prim_type", "prim_val", "digest"]
    whole = api.tree_nodes(rows, "text", name, columns)
    values = api.tree_nodes(rows, "text", name, columns, values_only=True)
    assert values.columns == whole.columns
    found = sorted(values.collect())
    assert found and found == sorted(whole.where("prim_type is not null").collect())
    assert api.tree_nodes(rows, "text", name, ["prim_val"], values_only=True).count() == len(found)


def test_an_error_is_told_beside_values(spark):
    rows = spark.createDataFrame([(1, "[1, 2]"), (2, "[")], "id int, text string")
    found = api.tree_nodes(rows, "text", "json", ["prim_val", "parse_error"], values_only=True).collect()
    assert sorted(r.prim_val for r in found if r.id == 1) == ["1", "2"]
    assert [r.prim_val for r in found if r.id == 2 and r.parse_error] == [None]


def test_a_space_for_many_rows_has_a_bound():
    space, trees = Space(), set()
    for i in range(20_000):
        space = space.next_row()
        t = grammar("json")(space, f"[{i}, 1]")
        trees.add(node_columns(t, frozenset(["prim_val"]), frozenset([PRIM]))["prim_val"][0])
        assert len(space.known) < Space.MOST + 100
    assert len(trees) == 20_000
