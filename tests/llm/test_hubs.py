"""Components of graphs with a hub."""

from pyspark.sql import functions as F

from arbordiff.llm.components import components


def test_a_star_of_a_million_nodes_is_split(spark):
    """The hub is one key; with its side a plain shuffle, the join can be split among tasks."""
    n = 1_000_000
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = spark.range(n).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b"))
        star = star.unionByName(spark.createDataFrame([(n + 10, n + 11), (n + 11, n + 12)], "a long, b long"))
        out = components(star)
        got = {r.root: r.n for r in out.groupBy("root").agg(F.count("*").alias("n")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {0: n + 1, n + 10: 3}
