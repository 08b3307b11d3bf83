"""URL filtering by explicit host and path rules and by mined association rules; DataFrame and SQL functions only.

Explicit rules: a rule fits its host and all subdomains if the url's path starts with the rule's path; the longest wins (two rules of one
length that fit have the same host and path; block is stronger than allow).
Mined rules: single tokens are counted first, and what can't be in a larger rule goes; FP-growth then finds the combinations of up to
MOST_TOKENS URL tokens that are frequent among the bad urls (support), and their share of bad urls among all labelled ones is counted. A combination that mostly is bad (confidence) is a rule, unless a part of it is a
rule that is at least as confident. Rules are looked up through an inverted index: each is filed under one of its tokens, so that a url
meets only rules that share a token with it.

Null urls and urls without '://' have an empty host and path and no tokens: no rule fits and the verdict is allow. Urls are read whole,
however long. Repeated rows repeat (and count as often among the labels), the order of rows means nothing, an empty table gives an empty
one, and other columns are left alone, whatever their names. No labelled url: no mined rules.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbordiff.llm.common import numbered, own_name, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most tokens of a rule, and tokens that a transaction of FP-growth has at most (a multiple of MOST_TOKENS): with these a transaction
#: has at most 2 ** IN_TRANSACTION combinations, however long its url is.
MOST_TOKENS, IN_TRANSACTION = 3, 12


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: registered domain, labels before it and their hyphenated words, path segments and query keys (digits as #)."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    inner = F.filter(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: x != "")
    words = F.filter(F.flatten(F.transform(inner, lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")

    def tagged(tag: str, xs: Column) -> Column:
        return F.transform(xs, lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))

    domain = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    parts = F.concat(tagged("d:", F.array(domain)), tagged("h:", inner), tagged("w:", words), tagged("p:", segments), tagged("q:", keys))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, else null. rules: (verdict, host, path). They are filed by host."""
    filed: dict[str, list[dict]] = {}
    for verdict, h, p in rules:
        filed.setdefault(h, []).append({"n": len(h) + len(p), "rule": h + p, "path": p, "verdict": verdict})
    index = F.from_json(F.lit(json.dumps(filed)), "map<string, array<struct<n:int,rule:string,path:string,verdict:string>>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(index, s)), lambda x: x.isNotNull()))
    return F.array_max(F.transform(F.filter(found, lambda r: F.startswith(path, r["path"])), lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def transactions(tokens: Column) -> Column:
    """The tokens as one transaction, or, if they are more than IN_TRANSACTION, as several of so many, such that any MOST_TOKENS tokens
    are together in one of them: the tokens are cut into small parts, and every three parts make a transaction."""
    part = IN_TRANSACTION // MOST_TOKENS
    parts = F.ceil(F.size(tokens) / part).cast("int")

    def piece(i: Column) -> Column:
        return F.slice(tokens, i * part + 1, F.lit(part))

    def third(i: Column, j: Column) -> Column:
        return F.transform(F.sequence(j + 1, parts - 1), lambda k: F.concat(piece(i), piece(j), piece(k)))

    def second(i: Column) -> Column:
        return F.flatten(F.transform(F.sequence(i + 1, parts - 2), lambda j: third(i, j)))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), parts - 3), second))
    return F.when(F.size(tokens) <= IN_TRANSACTION, F.array(tokens)).otherwise(cut)


def mine(labelled: DataFrame, min_support: float = 0.001, min_count: int = 10, min_confidence: float = 0.9) -> tuple[list[dict], dict[str, str]]:
    """labelled: (tokens array<string>, bad boolean). Rules as dicts of tokens, count, confidence: at least max(min_count, min_support of
    all labelled urls) bad urls have the tokens, and of the urls that have them at least min_confidence are bad. The number of rules is
    bounded: a url has at most C(its tokens, MOST_TOKENS) combinations, and min_support of the urls must have one.

    Level by level: tokens alone are counted first. Rare ones among the bad urls are in no rule, and what only bad urls have is a rule that
    no larger one can better; both go. Of tokens that are on exactly the same labelled urls the first stands for all; the second result
    tells for each of the others which that is. What remains of the bad urls goes to FP-growth."""
    labelled = numbered(labelled.where(F.size("tokens") > 0).select(F.array_distinct("tokens").alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")), "row", "labelled")
    total = labelled.count()
    count = max(min_count, min_support * total)
    met = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    where = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"where{k}") for k in (0, 1)]  # on which urls a token is
    known = met.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"), *where)
    known = written(known.where(F.col("bad") >= count), "tokens")
    single = known.where(F.col("bad") >= min_confidence * F.col("n")).select("token", "n", "bad").collect()
    found = {(r.token,): (r.n, r.bad / r.n) for r in single}
    same = Window.partitionBy("n", "bad", "where0", "where1")
    open_ = written(known.where(F.col("bad") < F.col("n")).select("token", F.min("token").over(same).alias("first")), "open")
    left = met.where("bad").join(open_.where(F.col("token") == F.col("first")), "token").groupBy("row").agg(F.sort_array(F.collect_set("token")).alias("items"))
    items = written(left.select(F.explode(transactions(F.col("items"))).alias("items")), "transactions")
    if n := items.count():
        # A combination is in at least as many transactions as urls, so that none is missed; what it really counts comes next.
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, count / n)).fit(items)
        sets = model.freqItemsets.where(F.size("items").between(2, MOST_TOKENS)).select(F.array_sort("items").alias("items")).collect()
        held = labelled.select("bad", F.explode(matches(F.col("tokens"), [{"tokens": r["items"]} for r in sets])).alias("rule"))
        counted = held.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
        counted = counted.where((F.col("bad") >= count) & (F.col("bad") >= min_confidence * F.col("n")))
        found |= {tuple(r.rule): (r.n, r.bad / r.n) for r in counted.collect()}
    kept: dict[tuple, tuple] = {}
    for tokens in sorted(found, key=lambda t: (len(t), t)):
        parts = (p for size in range(1, len(tokens)) for p in combinations(tokens, size))
        if not any(p in kept and kept[p][1] >= found[tokens][1] for p in parts):
            kept[tokens] = found[tokens]
    used = sorted({t for tokens in kept if len(tokens) > 1 for t in tokens})
    others = open_.where(F.col("first").isin(used) & (F.col("token") != F.col("first"))).collect() if used else []
    return [{"tokens": [*t], "count": n, "confidence": c} for t, (n, c) in kept.items()], {r.token: r.first for r in others}


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_count: int = 10, min_confidence: float = 0.9) -> list[dict]:
    """The rules alone."""
    return mine(labelled, min_support, min_count, min_confidence)[0]


def matches(tokens: Column, rules: list[dict]) -> Column:
    """The rules that hold for the tokens: of each its tokens."""
    if not rules:
        return F.array().cast("array<array<string>>")
    often: dict[str, int] = {}
    for r in rules:
        for t in r["tokens"]:
            often[t] = often.get(t, 0) + 1
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(min(r["tokens"], key=lambda t: (often[t], t)), []).append(r["tokens"])
    filed = F.from_json(F.lit(json.dumps(index)), "map<string, array<array<string>>>")
    met = F.flatten(F.filter(F.transform(tokens, lambda t: F.element_at(filed, t)), lambda x: x.isNotNull()))
    return F.filter(met, lambda r: F.size(F.array_except(r, tokens)) == 0)


def filter_urls(urls: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", min_support: float = 0.001, min_confidence: float = 0.9) -> DataFrame:
    """urls with host, path, rule, verdict and mined (the mined rules that hold) added; columns of these names are replaced.
    labels: (url, bad)."""
    mined, alike = mine(labels.select(tokens_of(F.col("url")).alias("tokens"), "bad"), min_support, min_confidence=min_confidence)
    url, fits = F.col(url_col), own_name(urls, "_fits")
    tokens = tokens_of(url)
    if alike:
        firsts = F.from_json(F.lit(json.dumps(alike)), "map<string, string>")
        tokens = F.array_distinct(F.concat(tokens, F.array_compact(F.transform(tokens, lambda t: F.element_at(firsts, t)))))
    out = urls.withColumn(fits, explicit_rule(host_of(url), path_of(url), rules)).withColumns({"host": host_of(url), "path": path_of(url), "mined": F.transform(matches(tokens, mined), lambda r: F.array_join(r, " & "))})
    verdict = F.coalesce(F.col(f"{fits}.verdict"), F.when(F.size("mined") > 0, "block").otherwise("allow"))
    return out.withColumns({"rule": F.col(f"{fits}.rule"), "verdict": verdict}).drop(fits)
