"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

1. toxicity: documents with a toxicity score of 0.5 or more go.
2. near_duplicates: of each group that links of 5-word Jaccard similarity 0.8 or more join, the row with the smallest doc_id stays.
3. repeated_strings: strings of 51 words or of 400 bytes that occur more than once are taken out of the texts; emptied documents go.
4. benchmark: hits of benchmark windows are taken out; documents of which more than half is hit go.
5. tokens: byte-level BPE ids and digests of each remaining document.

Stages 1 to 4 return the columns of documents, extra ones of any name included. Clean documents pass unchanged. Null and empty texts are
copies of each other in stage 2 and pass the others; of repeated rows one stays; a null doc_id is larger than any other; empty tables
give empty ones; texts of any length are worked off whole. ORACLE_SQL is None: the label model, MinHash (XXH64) and BPE have no SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arbordiff.llm import bpe, decontaminate, near_copies, repeats, toxicity
from arbordiff.llm.common import written

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs, similarity=0.8, words=5)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(docs, length=400, words=51)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=10)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", drop_repeated_strings),
    ("benchmark", remove_benchmark),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
