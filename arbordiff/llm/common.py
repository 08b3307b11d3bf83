"""What the corpus operators share: Arrow kernels, row keys and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Rows of a batch that goes to Python. Texts are long, so few rows keep a worker's memory bounded.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Batches for text kernels hold at most BATCH_ROWS rows; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(kernel, schema)


class Shared:
    """A broadcast value, and what a worker makes of it. A worker keeps the last object that it made, for the tasks to come, and lets go
    of it before it makes another."""

    _made: tuple = ("", None)

    def __init__(self, spark: SparkSession, value):
        self.name, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def made(self, make: Callable):
        if Shared._made[0] != self.name:
            Shared._made = ("", None)
            Shared._made = (self.name, make(self.broadcast.value))
        return Shared._made[1]


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(df: DataFrame, text_col: str) -> DataFrame:
    """df with the texts of text_col as compressed bytes, to be stored and shuffled; null stays null."""
    schema = StructType([StructField(f.name, BinaryType()) if f.name == text_col else f for f in df.schema])

    def kernel(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            at = b.schema.get_field_index(text_col)
            packed = [None if t is None else press(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.set_column(at, text_col, pa.array(packed, pa.binary()))

    return map_arrow(df, kernel, schema)


def unpack(column: pa.Array) -> list[bytes]:
    """The bytes of packed texts; null is empty."""
    return [b"" if x is None else zstandard.decompress(x) for x in column.to_pylist()]


def unpacked(packed: DataFrame, text_col: str, like: DataFrame) -> DataFrame:
    """packed with its texts as strings again, in the columns of like."""

    def kernel(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            nulls = b.column(at).is_null().to_pylist()
            texts = [None if x else t for t, x in zip(unpack(b.column(at)), nulls, strict=True)]
            yield b.set_column(at, text_col, pa.array(texts, pa.binary()).cast(pa.string()))

    return map_arrow(packed, kernel, like.schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def fold_of(doc_id: str, folds: int = 5):
    """crc32 of the id's decimal text, modulo folds; a null id has the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or in tests on one machine a local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="arbordiff-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table in the shared folder: it is computed once and its lineage ends here. The table of instead_of, which must have come
    from here and isn't read any more, is removed then."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        remove(instead_of)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def remove(table: DataFrame) -> None:
    """Removes a table that came from written() and isn't read any more."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table._path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """df with a number of its own for each row, in the column `row`, as a table: all that reads it sees the same numbers, however the
    reads of df are cut into tasks."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), starts[1], ..."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
