"""Held-out accuracy of the classifiers and of the language model on the tables, with bounds."""

import os

import pytest

from arbordiff.llm import queries

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")


@pytest.mark.parametrize("name,label,least_right,least_found", [("op6_toxicity", "toxic", 0.97, 0.9), ("op7_quality", "quality", 0.97, 0.97)])
def test_held_out_rows(spark, name, label, least_right, least_found):
    """At least so many of the held-out rows are right, and of those with label 1 so many are found; a constant answer is worse."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label)
    rows = queries.queries()[name](spark, LARGER).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r[label] for r in rows)
    ones = [r for r in rows if r[label] == 1]
    constant = max(len(ones), len(rows) - len(ones))
    assert len(rows) > 500 and len(ones) > 50
    assert right >= least_right * len(rows) and right > constant
    assert sum(r.predicted for r in ones) >= least_found * len(ones)
    # scores rank: a row of label 1 is above one of label 0 in nearly all pairs
    ordered = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in ones for b in rows if b[label] == 0)
    assert ordered >= 0.9 * len(ones) * (len(rows) - len(ones))


def test_language_model_is_better_than_its_base_on_held_out_text(spark):
    rows = [r for r in queries.queries()["op4_language_model"](spark, SF).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.1
