"""Changes that bring their demands: the same pairs as from their patches alone, and keys of many rows go on together."""

import pyarrow as pa
from pyspark.sql import functions as F

from arbordiff import api
from arbordiff.operators import patch_index


def test_demands_told_with_the_patch(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "b\nc\nd"), (2, "x", "y"), (3, "a\nb\nq", "b\nq\nd"), (4, None, "a"), (5, "x\nx", "x\nx")], "id int, src string, dst string")
    made = patch_index.filed_changes(rows, "src", "dst", "lines", keep=["id"])
    assert made.columns == ["id", "status", "error", "patch", "demands"]
    assert {r.id: r.status for r in made.collect()} == {1: "success", 2: "success", 3: "success", 4: "parse-error", 5: "success"}
    plain = api.diff_pairs(rows, "src", "dst", "lines", columns=["patch"])
    assert {r.id: r.patch for r in plain.collect()} == {r.id: r.patch for r in made.collect()}
    changes = made.where("patch is not null").select(F.col("id").alias("patch_id"), "patch", "demands")
    trees = rows.where("src is not null").select(F.col("id").alias("tree_id"), F.col("src").alias("text"))
    told = sorted(api.applicable_patches(changes, trees, "lines").collect())
    assert told and told == sorted(api.applicable_patches(changes.drop("demands"), trees, "lines").collect())


def test_keys_of_many_rows_are_one_batch(spark):
    rows = spark.range(0, 100, 1, 1).select("id", F.col("id").cast("string").alias("text"))
    sizes = patch_index._keys(rows, "id", "text", lambda t: [t.encode(), b"k"]).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert [r.n for r in sizes.collect()] == [200]
