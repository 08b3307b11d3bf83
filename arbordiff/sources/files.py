"""Files to rows: whole texts with the grammar that their suffix names, and datapoint folders to triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordiff.sources.grammars import _parsers


def read_texts(spark: SparkSession, path: str | list[str], grammar: str | None = None) -> DataFrame:
    """(path, text, grammar): a row for each file. Without a grammar it is what follows the first dot of the file's name, null if unknown."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if grammar:
        return rows.withColumn("grammar", F.lit(grammar))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.substring_index(F.substr(name, F.locate(".", name) + 1), "/", -1)
    return rows.withColumn("grammar", F.when((F.locate(".", name) > 0) & suffix.isin(*_parsers), suffix))


def read_datapoints(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """(name, o, a, b, m) of the folders below `folder` that hold files O, A, B and M with the language as suffix; missing files are null."""
    rows = spark.read.text(f"{folder}/*/*.{language}", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = rows.select(F.element_at(parts, -2).alias("name"), F.substring_index(F.element_at(parts, -1), ".", 1).alias("part"), F.col("value").alias("text"))
    out = rows.groupBy("name").pivot("part", ["O", "A", "B", "M"]).agg(F.min("text"))
    return out.select("name", *[F.col(c).alias(c.lower()) for c in "OABM"])
