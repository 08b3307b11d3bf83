"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core that rows are dealt to, so that one slow task doesn't hold up the others.
TASKS_A_CORE = 4


def dealt(df: DataFrame) -> DataFrame:
    """df's rows, dealt evenly over tasks. Spark cuts a file by its bytes and row groups: of small rows a million are one task, however much
    work each of them is."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and there is one machine only, a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="arbordiff-")
        spark.sparkContext.setCheckpointDir(top)
    return top


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table: it is computed once, whatever reads it later, and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
