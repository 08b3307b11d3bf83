"""Merges over a stream: late versions in order across batches, over a restart, and versions given up after a while."""

import time

import pytest

from arbordiff.streaming.merges import merge_versions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def start(spark, folder, name, wait_ms=0):
    stream = spark.readStream.schema("doc string, side string, turn long, body string").parquet(str(folder / "in"))
    out = merge_versions(stream, "doc", "side", "turn", "body", "lines", wait_ms)
    return out.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(folder / name))).option("checkpointLocation", str(folder / "c")).start()


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "doc string, side string, turn long, body string").coalesce(1).write.mode("append").parquet(str(folder / "in"))


def results(spark, folder, name):
    return sorted((r.doc, r.a_version, r.b_version, r.status, r.merged) for r in spark.read.schema("doc string, a_version long, b_version long, status string, merged string").parquet(str(folder / name)).collect())


def test_late_versions_are_merged_in_order_over_a_restart(spark, rocks, tmp_path):
    (tmp_path / "in").mkdir()
    query = start(spark, tmp_path, "out")
    try:
        feed(spark, tmp_path, [("d", "a", 1, "x\nb\nc"), ("d", "b", 0, "a\nb\nc\nd"), ("e", "o", None, "p\nq"), ("e", "z", 0, "no side"), (None, "a", 0, "no key")])
        query.processAllAvailable()
        feed(spark, tmp_path, [("d", "o", 7, "a\nb\nc"), ("e", "a", 0, "p1\nq"), ("e", "b", 0, "p2\nq")])
        query.processAllAvailable()
        assert results(spark, tmp_path, "out") == [("e", 0, 0, "conflicting", None)]  # d still lacks version 0 of side a
    finally:
        query.stop()
    query = start(spark, tmp_path, "out")  # the state comes back from the checkpoint
    try:
        feed(spark, tmp_path, [("d", "a", 0, "a\nb\nc"), ("e", "b", 1, "p\nq\nr")])
        query.processAllAvailable()
        feed(spark, tmp_path, [("d", "a", 0, "came already"), ("d", "b", 1, "a\nb\nc\nd\ne")])
        query.processAllAvailable()
    finally:
        query.stop()
    got = results(spark, tmp_path, "out")
    assert got == [("d", 1, 0, "success", "x\nb\nc\nd"), ("d", 1, 1, "success", "x\nb\nc\nd\ne"), ("e", 0, 0, "conflicting", None), ("e", 0, 1, "success", "p1\nq\nr")]


def test_missing_versions_are_given_up(spark, rocks, tmp_path):
    (tmp_path / "in").mkdir()
    query = start(spark, tmp_path, "out", wait_ms=1000)
    try:
        feed(spark, tmp_path, [("d", "o", None, "a\nb"), ("d", "b", 0, "a\nb"), ("d", "a", 3, "z\nb"), ("d", "a", 4, "y\nb")])
        end = time.time() + 90  # with timers there is always another batch, so that processAllAvailable() would not return
        while not [*tmp_path.glob("out/part-*")] or not results(spark, tmp_path, "out"):
            assert time.time() < end and query.isActive
            time.sleep(0.5)
    finally:
        query.stop()
    assert results(spark, tmp_path, "out") == [("d", 4, 0, "success", "y\nb")]
