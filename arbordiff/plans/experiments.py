"""The batch experiment around the kernels: configurations, datapoints, logs and reports, as DataFrame operations."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbordiff.api import merge_triples, parse_trees
from arbordiff.functions import kernels
from arbordiff.operators.patches import MODES, Options
from arbordiff.operators.terms import Space
from arbordiff.sources.grammars import ParseError

#: Results that a merge can end with, beside those that count as other.
RESULTS = ("success", "mdiff", "conf", "apply-fail", "other")
LEGS = ("O-A", "O-B", "O-M", "A-B")
#: Seconds that a difference and a merge may take in an experiment.
DIFF_SECONDS, MERGE_SECONDS = 30, 45


def config_grid(spark: SparkSession, languages: list[str], heights: tuple[int, ...] = (1, 6), modes: tuple[str, ...] = MODES) -> DataFrame:
    """(language, height, mode, scope): every combination of the given literals, from one row."""
    out = spark.range(1, numPartitions=1).drop("id")
    for name, values in (("language", languages), ("height", heights), ("mode", modes), ("scope", ("local", "global"))):
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def stage_pivot(unmerged: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, stage 1, 2 or 3, blob) to one row (key, o, a, b); a missing stage is null."""
    out = unmerged.where(F.col("stage").isin(1, 2, 3)).groupBy(key).pivot("stage", [1, 2, 3]).agg(F.min("blob"))
    return out.select(key, F.col("1").alias("o"), F.col("2").alias("a"), F.col("3").alias("b"))


def of_languages(paths: DataFrame, languages: list[str], path_col: str = "path") -> DataFrame:
    """The paths of each of the languages, with `language`, one list after another."""
    out = [of_language(paths, x, path_col).withColumn("language", F.lit(x)) for x in languages]
    return reduce(DataFrame.unionByName, out)


def of_language(paths: DataFrame, language: str, path_col: str = "path") -> DataFrame:
    """Paths whose second dot-separated field is the language."""
    return paths.where(F.get(F.split(path_col, r"\."), F.lit(1)) == language)


def datapoints(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, rejected): a datapoint needs a, o and b."""
    whole = F.col("a").isNotNull() & F.col("o").isNotNull() & F.col("b").isNotNull()
    return triples.where(whole), triples.where(~whole)


def diff_grid(pairs: DataFrame, grammar: str, heights: tuple[int, ...] = (1, 6), modes: tuple[str, ...] = MODES, scopes: tuple[str, ...] = ("local", "global"), seconds: float = DIFF_SECONDS, columns: list[str] | None = None) -> DataFrame:
    """Rows (src, dst and others) once for each configuration: height, mode, scope and diff_pairs' columns (or those that are named). Each
    pair is read and parsed once for all configurations; one without trees has one row, without a configuration."""
    grid = [*product(heights, modes, scopes)]
    outputs = kernels.chosen(kernels.DIFF, columns)
    wanted = frozenset(outputs)

    def works(space: Space, source: str | None, target: str | None) -> list:
        try:
            a, b = kernels.parsed(space, grammar, source, target)
        except ParseError as e:
            failed = {"status": "parse-error", "error": str(e)}
            return [lambda: failed]

        def one(height: int, mode: str, scope: str) -> dict:
            return kernels.diff_trees(space, grammar, a, b, Options(height, mode, scope == "global"), wanted)

        def told(height: int, mode: str, scope: str):
            run = kernels.guarded(one, kernels.DIFF, seconds)
            return lambda: run(height, mode, scope) | {"height": height, "mode": mode, "scope": scope}

        return [told(*g) for g in grid]

    return kernels.add_rows(pairs, ["src", "dst"], {"height": "int", "mode": "string", "scope": "string"} | outputs, works)


def four_diffs(triples: DataFrame, grammar: str, seconds: float = DIFF_SECONDS, columns: list[str] | None = None, **options) -> DataFrame:
    """A row for each of O-A, O-B, O-M and A-B of a datapoint, with src, dst and diff_pairs' columns (or those of these that are named). Each
    text is parsed once for all legs. Legs without both sides are left out."""
    chosen = Options(**options)
    outputs = {"leg": "string"} | {c: "string" for c in ("src", "dst") if columns is None or c in columns} | kernels.chosen(kernels.DIFF, columns)
    wanted = frozenset(outputs)

    def works(space: Space, a: str | None, o: str | None, b: str | None, m: str | None) -> list:
        texts, trees = {"A": a, "O": o, "B": b, "M": m}, {}

        def tree(name: str):
            if name not in trees:
                [trees[name]] = kernels.parsed(space, grammar, texts[name])
            return trees[name]

        def one(leg: str) -> dict:
            try:
                x, y = tree(leg[0]), tree(leg[2])
            except ParseError as e:
                return {"status": "parse-error", "error": str(e)}
            return kernels.diff_trees(space, grammar, x, y, chosen, wanted)

        def told(leg: str):
            run = kernels.guarded(one, kernels.DIFF, seconds)
            return lambda: run(leg) | {"leg": leg, "src": texts[leg[0]], "dst": texts[leg[2]]}

        return [told(leg) for leg in LEGS if texts[leg[0]] is not None and texts[leg[2]] is not None]

    return kernels.add_rows(triples, ["a", "o", "b", "m"], outputs, works, keep=[c for c in triples.columns if c not in ("a", "o", "b", "m")])


def merge_result() -> Column:
    return F.when(F.col("status") == "merge-diff", "mdiff").when(F.col("status") == "conflicting", "conf").otherwise(F.col("status"))


def merge_experiment(triples: DataFrame, grammar: str, seconds: float = MERGE_SECONDS, **options) -> DataFrame:
    """triples with result: success, mdiff (not the expected m), conf, apply-fail, or another status as it is."""
    merged = merge_triples(triples, "a", "o", "b", grammar, expected_col="m", seconds=seconds, **options)
    return merged.withColumn("result", merge_result())


def merge_cases(bases: DataFrame, o_col: str, cases_col: str, grammar: str, seconds: float = MERGE_SECONDS, **options) -> DataFrame:
    """kind and result, as merge_experiment() gives it, for each case of a base: cases_col is an array of (kind, a, b, m). Of a base, equal
    texts are parsed once and differences from it are made once for all cases."""
    chosen = Options(**options)

    def works(space: Space, o: str | None, cases: list | None) -> list:
        trees, known = {}, {}

        def tree(text: str | None):
            if text not in trees:
                [trees[text]] = kernels.parsed(space, grammar, text)
            return trees[text]

        def one(case: dict) -> dict:
            try:
                a, base, b = (tree(x) for x in (case["a"], o, case["b"]))
                want = None if case["m"] is None else tree(case["m"])
            except ParseError as e:
                return {"status": "parse-error", "error": str(e)}
            return kernels.merge_trees(space, a, base, b, want, chosen, known)

        def told(case: dict):
            run = kernels.guarded(one, kernels.MERGE, seconds)
            return lambda: run(case) | {"kind": case["kind"]}

        return [told(case) for case in cases or []]

    merged = kernels.add_rows(bases, [o_col, cases_col], {"kind": "string", "status": "string", "error": "string"}, works, keep=[])
    return merged.select("kind", merge_result().alias("result"))


def parse_experiment(texts: DataFrame, text_col: str, grammar: str) -> DataFrame:
    """(ok, failed)."""
    out = parse_trees(texts, text_col, grammar)
    return out.agg(F.count_if(F.col("parse_error").isNull()).alias("ok"), F.count_if(F.col("parse_error").isNotNull()).alias("failed"))


def result_pivot(results: DataFrame, by: tuple[str, ...] = ("height", "mode", "scope")) -> DataFrame:
    """One row for each configuration: how many ended with each result, and success and mdiff together; unknown results count as other."""
    known = F.when(F.col("result").isin(*RESULTS[:-1]), F.col("result")).otherwise("other")
    out = results.withColumn("result", known).groupBy(*by).pivot("result", list(RESULTS)).count().na.fill(0, list(RESULTS))
    return out.withColumn("merged", F.col("success") + F.col("mdiff"))


def top_configs(pivoted: DataFrame, k: int = 3, within: str = "language", by: str = "merged", ties: tuple[str, ...] = ("height", "mode", "scope")) -> DataFrame:
    """The k best configurations of each language, with their rank."""
    order = Window.partitionBy(within).orderBy(F.desc(by), *ties)
    return pivoted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def runtimes(results: DataFrame, min_size: int = 0, max_size: int = 0) -> DataFrame:
    """(nm, secs) of the results whose trees have from min_size to max_size nodes together (0: no limit)."""
    keep = (F.col("nm") >= min_size) & (F.lit(max_size == 0) | (F.col("nm") <= max_size))
    return results.where(keep).select("nm", "secs")


def parse_log(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """prefix, height, mode, scope, secs, nm and cost of lines like 'p 1 nonest global time(s):0.5 n+m:12 cost:3'; a line without a
    scope is local."""
    fields = r"^(\S+) (\d+) (\S+) (?:(local|global) )?time\(s\):([0-9.]+) n\+m:(\d+) cost:(\d+)$"
    kinds = (("prefix", "string"), ("height", "int"), ("mode", "string"), ("scope", "string"), ("secs", "double"), ("nm", "long"), ("cost", "long"))
    out = lines.where(F.col(line_col).rlike(fields)).select(*[F.regexp_extract(line_col, fields, i).cast(t).alias(n) for i, (n, t) in enumerate(kinds, 1)])
    return out.withColumn("scope", F.when(F.col("scope") == "", "local").otherwise(F.col("scope")))


def parse_merge_log(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """prefix, height, mode, scope and result of lines like 'p 1 nonest local success'."""
    fields = r"^(\S+) (\d+) (\S+) (local|global) (\S+)$"
    kinds = (("prefix", "string"), ("height", "int"), ("mode", "string"), ("scope", "string"), ("result", "string"))
    return lines.where(F.col(line_col).rlike(fields)).select(*[F.regexp_extract(line_col, fields, i).cast(t).alias(n) for i, (n, t) in enumerate(kinds, 1)])


def candidate_pairs(docs: DataFrame, min_length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, anchor_id, shared_lines): each document with the first one (by id) that has the same long line. A line of n documents
    gives n - 1 pairs, however frequent it is; nothing is left out: documents with a common line have a common anchor for it."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.split(text_col, "\n"))).alias("line")).where(F.length("line") > min_length)
    lines = lines.select("doc_id", F.sha2("line", 256).alias("line")).distinct()
    anchors = lines.groupBy("line").agg(F.min("doc_id").alias("anchor_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return lines.join(anchors, "line").where("doc_id > anchor_id").groupBy("doc_id", "anchor_id").agg(F.count("*").alias("shared_lines"))


def locate(names: DataFrame, first: str, second: str, name_col: str = "name") -> DataFrame:
    """The rows whose name has both fragments, and whether that is a single one (a subquery; nothing runs before the result is asked for)."""
    found = names.where(F.contains(F.col(name_col), F.lit(first)) & F.contains(F.col(name_col), F.lit(second)))
    return found.withColumn("single", found.limit(2).agg(F.count("*") == 1).scalar())
