"""Kernels over tables of one task: rows are dealt to tasks, and only what is asked for is worked out."""

from pyspark.sql import functions as F

from arbordiff import api
from arbordiff.functions import kernels
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import Space
from arbordiff.plans import experiments


def parts(spark):
    """200 rows in one partition, as a small file is."""
    return spark.range(0, 200, 1, 1).select("id", F.concat(F.lit("r[a"), "id", F.lit("[x],b]")).alias("src"), F.concat(F.lit("r[b,a"), "id", F.lit("[x]]")).alias("dst"))


def tasks(df) -> list[int]:
    """Rows by task."""
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_rows_of_one_task_are_dealt(spark):
    pairs = parts(spark)
    merged = api.merge_triples(pairs.withColumn("b", F.col("src")), "dst", "src", "b", "rtree")
    nodes = api.tree_nodes(pairs.select("id", "src"), "src", "rtree", ["node_id"]).where("node_id = 0")
    grid = experiments.diff_grid(pairs, "rtree", heights=(1,), modes=("nonest",), scopes=("local",))
    for out in (merged, nodes, grid, api.diff_pairs(pairs, "src", "dst", "rtree"), api.show_pairs(pairs, "src", "dst", "rtree")):
        rows = tasks(out)
        assert sum(rows) == 200 and len(rows) >= 8 and max(rows) <= 50


def test_columns_asked_for_are_the_same(spark):
    pairs = parts(spark).limit(20)
    whole = {r.id: r for r in api.diff_pairs(pairs, "src", "dst", "rtree").collect()}
    some = api.diff_pairs(pairs, "src", "dst", "rtree", columns=["cost", "result"])
    assert some.columns == ["id", "src", "dst", "status", "cost", "result"]
    assert {r.id: (r.status, r.cost, r.result) for r in some.collect()} == {i: (r.status, r.cost, r.result) for i, r in whole.items()}
    row = kernels.diff_row(Space(), "rtree", "r[a,b]", "r[b,a]", Options(), frozenset())
    assert row == {"status": "success"}


def test_legs_fail_alone(spark):
    rows = spark.createDataFrame([(1, "[1", "[1]", "[2]", None), (2, "[1]", "[2]", "[3]", "[4]")], "id int, a string, o string, b string, m string")
    found = {(r.id, r.leg): (r.status, r.src, r.dst) for r in experiments.four_diffs(rows, "json").collect()}
    assert found[1, "O-A"] == ("parse-error", "[1]", "[1") and found[1, "O-B"] == ("success", "[1]", "[2]") and found[1, "A-B"][0] == "parse-error"
    assert (1, "O-M") not in found and len(found) == 7


def test_long_texts_are_worked_off_in_portions():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"text": ["x" * 500_000] * 20 + ["y"]})
    parts = [*kernels.portions(iter([b]))]
    assert sum(p.num_rows for p in parts) == 21 and max(p.num_rows for p in parts) <= 5
