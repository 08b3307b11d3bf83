"""The contract queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordiff.llm import bpe, decontaminate, hard_negatives, language_model, neighbours, quality, quality_rules, repeats, simhash, token_alignment, token_counts, toxicity, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns for strings of 400 bytes: n_repeated_words, the words within strings of 51 words that occur more than once."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, words=51)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


#: Fixed values: (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose path ends with the number of a labelled document: bad if that is of low quality or toxic."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    return numbered.join(marks.where("bad is not null"), "doc_id").select("url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.filter_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(table(spark, sf_dir, "documents"), RANKS)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), query_every=20, k=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id's label is wrong on purpose, so that labels and vectors don't quite agree."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", wrong), anchor_every=50, positives=5, negatives=3, least=50, most=95, scale=256)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b, with_groups=False)


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w
        FROM (SELECT item, ws, least(10, len(ws)) AS k FROM it WHERE len(ws) > 0), UNNEST(range(1, len(ws) - k + 2)) AS t(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
dw AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
       FROM d, (SELECT DISTINCT k FROM win) AS ks, UNNEST(range(1, len(ws) - k + 2)) AS t(i)),
m AS (SELECT r, i, dw.k AS k, item FROM dw JOIN win ON dw.k = win.k AND dw.w = win.w),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, i, k FROM m) AS x, UNNEST(range(i, i + k)) AS t(p) GROUP BY r),
its AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, b, length(h) // 2 AS n, substr(h, CAST(400 * b + 1 AS BIGINT), 1198) AS piece FROM d, UNNEST(range(0, (length(h) // 2 + 199) // 200)) AS t(b)),
w AS (SELECT r, 200 * b + i AS p, md5(substr(piece, CAST(2 * i + 1 AS BIGINT), 800)) AS m FROM c, UNNEST(range(0, 200)) AS t(i) WHERE 200 * b + i <= n - 400),
s AS (SELECT r, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
e AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS f FROM s),
g AS (SELECT r, p, sum(f) OVER (PARTITION BY r ORDER BY p) AS k FROM e),
x AS (SELECT r, k, min(p) AS b, max(p) + 400 AS z FROM g GROUP BY r, k),
n AS (SELECT r, count(*) AS spans, sum(z - b) AS removed, max(z) AS last FROM x GROUP BY r),
o AS (SELECT r, k, b, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 0) AS a FROM x),
t AS (SELECT r, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY k) AS kept FROM o JOIN d USING (r) GROUP BY r),
l AS (SELECT r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
y AS (SELECT r, i, md5(array_to_string(ws[i:i + 50], ' ')) AS m FROM l, UNNEST(range(1, len(ws) - 49)) AS t(i)),
z AS (SELECT r, i, least(51, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 51)) AS covers FROM y WHERE m IN (SELECT m FROM y GROUP BY m HAVING count(*) > 1)),
v AS (SELECT r, sum(covers) AS words FROM z GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256,
       CAST(coalesce(words, 0) AS BIGINT) AS n_repeated_words
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r) LEFT JOIN v USING (r)
"""

OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM e),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r AS a JOIN r AS b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, b, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) AS k FROM s WHERE same),
n AS (SELECT p.a AS a, p.anchor_id AS anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND k <= 5 AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # at the top of the repository; it uses this package

    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_suffix_array_dedup, op3_url_filter, op4_language_model, op5_byte_bpe, op6_toxicity, op7_quality, op8_token_counts, op9_neighbours, op10_simhash, op11_quality_rules, op12_hard_negatives, op13_token_alignment)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1_SQL, "op2_suffix_array_dedup": OP2_SQL, "op12_hard_negatives": OP12_SQL}
