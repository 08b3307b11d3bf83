"""Trees of lines without Python workers: node tables, shapes and digests by Spark's own functions.

A text of n lines is the statement of a list of n cells, each with its line and the rest of the list; in preorder the statement is node 0,
cell i (from 0) node 1 + 3 i, its line and the line's text the next two, and the empty list node 1 + 3 n. Digests go from the end of the
list to its beginning, so that they are a fold. The fold runs over chunks of the list and within each chunk, as a list that a fold
appends to is copied at each step: with chunks of about sqrt(n) lines n lines cost about n ** 1.5 copied references, not n ** 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\0"


def lines_of(text: Column) -> Column:
    """The lines of a text; a newline at its end begins no further line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _digest(dtype: str, con: str, *kids: Column) -> Column:
    """As of a constructor's term: datatype, constructor and the children's digests."""
    return F.sha2(F.concat(F.lit(f"{dtype}{SEPARATOR}{con}{SEPARATOR}"), *kids), 256)


def line_digest(line: Column) -> Column:
    return _digest("Line", "Line", F.sha2(line, 256))


def empty_digest() -> Column:
    return _digest("[Line]", "[]")


def list_digests(lines: Column) -> Column:
    """The digests of the list and of each of its rests: from the whole list to the empty one, size(lines) + 1 of them."""
    n = F.size(lines)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    ends = F.sequence(n, F.least(n, F.lit(1)), -width)  # of the chunks, from the list's end; each chunk is turned round by itself
    chunks = F.transform(ends, lambda end: F.transform(F.reverse(F.slice(lines, F.greatest(end - width, F.lit(0)) + 1, F.least(width, end))), line_digest))

    def cell(acc: Column, line: Column) -> Column:
        return F.concat(acc, F.array(_digest("[Line]", ":", line, F.element_at(acc, -1))))

    def chunk(acc: Column, own: Column) -> Column:
        """Each chunk begins with the last digest of the one before."""
        return F.concat(acc, F.array(F.aggregate(own, F.array(F.element_at(F.element_at(acc, -1), -1)), cell)))

    start = F.array(F.array(empty_digest(), empty_digest()))
    found = F.aggregate(chunks, start, chunk, lambda acc: F.transform(acc, lambda c: F.slice(c, F.lit(2), F.size(c) - 1)))
    return F.reverse(F.flatten(found))


def shape(text: Column) -> tuple[Column, Column]:
    """(number of nodes, height) of a text's tree."""
    n = F.size(lines_of(text))
    return 3 * n + 2, n + 2


#: Columns of a node table that need no digests, and those that hold a string for each node.
TYPES = {"node_id": "int", "parent_id": "int", "ord": "int", "depth": "int", "last_id": "int", "kind": "string", "dtype": "string", "con": "string", "prim_type": "string", "prim_val": "string", "height": "int", "size": "int", "digest": "string", "kids": "array<string>", "parse_error": "string"}


def line_nodes(df: DataFrame, text_col: str, columns: list[str], lists_only: bool = False) -> DataFrame:
    """df's other columns and the node table of its texts' trees, as the kernel gives it; null texts have no rows or, with parse_error
    among the columns, one. lists_only: leaves out the nodes of single lines, which are never higher than 1."""
    kept = [c for c in df.columns if c != text_col and c not in columns]
    own = "_lines" + "_" * max(map(len, df.columns))
    source = df.where(F.col(f"`{text_col}`").isNotNull()).select(*[F.col(f"`{c}`") for c in kept], lines_of(F.col(f"`{text_col}`")).alias(own))
    digested = "digest" in columns or "kids" in columns
    if digested:
        source = source.withColumn(own + "d", list_digests(F.col(own)))
    lines, digests = F.col(own), F.col(own + "d")
    n = F.size(lines)
    end = 3 * n + 1

    def node(**given: Column) -> Column:
        return F.struct(*[given.get(c, F.lit(None)).cast(TYPES[c]).alias(c) for c in columns])

    def lit(x) -> Column:
        return F.lit(x)

    def digest_at(i: Column) -> Column:
        return F.get(digests, i) if digested else lit(None)

    root = {"node_id": lit(0), "ord": lit(0), "depth": lit(0), "last_id": end, "kind": lit("roll"), "dtype": lit("Stmt"), "con": lit("Stmt"), "height": n + 2, "size": 3 * n + 2}
    empty = {"node_id": end, "parent_id": F.greatest(end - 3, lit(0)), "ord": F.when(n > 0, 1).otherwise(0), "depth": n + 1, "last_id": end, "kind": lit("roll"), "dtype": lit("[Line]"), "con": lit("[]"), "height": lit(1), "size": lit(1)}
    if digested:
        root |= {"digest": _digest("Stmt", "Stmt", digest_at(lit(0))), "kids": F.array(digest_at(lit(0)))}
        empty |= {"digest": empty_digest(), "kids": F.array().cast("array<string>")}

    def cells(x: Column, i: Column) -> Column:
        at = 3 * i + 1
        cell = {"node_id": at, "parent_id": F.greatest(at - 3, lit(0)), "ord": F.when(i > 0, 1).otherwise(0), "depth": i + 1, "last_id": end, "kind": lit("roll"), "dtype": lit("[Line]"), "con": lit(":"), "height": n - i + 1, "size": end - at + 1}
        line = {"node_id": at + 1, "parent_id": at, "ord": lit(0), "depth": i + 2, "last_id": at + 2, "kind": lit("roll"), "dtype": lit("Line"), "con": lit("Line"), "height": lit(1), "size": lit(2)}
        text = {"node_id": at + 2, "parent_id": at + 1, "ord": lit(0), "depth": i + 3, "last_id": at + 2, "kind": lit("prim"), "prim_type": lit("String"), "prim_val": x, "height": lit(0), "size": lit(1)}
        if digested:
            cell |= {"digest": digest_at(i), "kids": F.array(line_digest(x), digest_at(i + 1))}
            line |= {"digest": line_digest(x), "kids": F.array(F.sha2(x, 256))}
            text |= {"digest": F.sha2(x, 256), "kids": F.array().cast("array<string>")}
        return F.array(node(**cell)) if lists_only else F.array(node(**cell), node(**line), node(**text))

    whole = F.concat(F.array(node(**root)), F.flatten(F.transform(lines, cells)), F.array(node(**empty)))
    out = source.select(*[F.col(f"`{c}`") for c in kept], F.inline(whole))
    if "parse_error" in columns:
        missing = df.where(F.col(f"`{text_col}`").isNull())
        why = [F.lit("there is no text" if c == "parse_error" else None).cast(TYPES[c]).alias(c) for c in columns]
        out = out.unionByName(missing.select(*[F.col(f"`{c}`") for c in kept], *why))
    return out
