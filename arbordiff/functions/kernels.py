"""Per-row work on Arrow batches, and the same functions for Spark SQL."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordiff.operators import alignment, layout, merging, patches
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import PRIM, Space, encode, node_columns, render
from arbordiff.sources import layouts
from arbordiff.sources.grammars import ParseError, grammar, install, lines, outline, registry, unparser
from arbordiff.sources.line_trees import line_nodes
from arbordiff.sources.tables import dealt

#: Rows of a batch in a kernel; trees are small, but a text may be long.
BATCH_ROWS = 256
#: Bytes of a batch's columns that a kernel works on at a time.
PORTION = 1 << 21


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class OutOfTime(Exception):
    pass


@contextmanager
def budget(seconds: float):
    """OutOfTime after so many seconds of a row's work (0: never). Off the main thread, where no alarm can be set, there is no limit, and a
    single call of C code (lcs_length's long integers) is over before the alarm is seen."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def over(*_):
        raise OutOfTime

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def guarded(work: Callable[..., dict], outputs: dict[str, str], seconds: float) -> Callable[..., dict]:
    """work with whatever goes wrong in a row as its result, where the outputs have a place for it: a status, or a parse error."""

    def run(*args) -> dict:
        try:
            with budget(seconds):
                return work(*args)
        except OutOfTime:
            found, why = "timeout", f"more than {seconds:g} seconds"
        except Exception as e:  # a row's fault is its result, never the task's
            if "status" not in outputs and "parse_error" not in outputs:
                raise
            found, why = "error", f"{type(e).__name__}: {e}".encode(errors="replace").decode()
        return {"status": found, "error": why} if "status" in outputs else {"parse_error": why}

    return run


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about PORTION bytes, so that a worker's memory doesn't follow the length of the texts."""
    for b in batches:
        n = max(1, b.num_rows * PORTION // max(1, b.nbytes))
        yield from (b.slice(i, n) for i in range(0, b.num_rows, n))


def _source(df: DataFrame, inputs: list[str], outputs: dict[str, str], keep: list[str] | None, deal: bool) -> tuple[DataFrame, list[str], list[int], str]:
    """(rows for a kernel, the columns that it passes on, the places of its inputs among the rows' columns, its schema)."""
    kept = [c for c in df.columns if c not in outputs and (keep is None or c in keep)]
    more = [c for c in dict.fromkeys(inputs) if c not in kept]
    places = [kept.index(c) if c in kept else len(kept) + more.index(c) for c in inputs]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select([F.col(f"`{c}`") for c in kept]).dtypes] + [f"`{c}` {t}" for c, t in outputs.items()])
    rows = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(more)])
    return dealt(rows) if deal else rows, kept, places, schema


def add_columns(df: DataFrame, inputs: list[str], outputs: dict[str, str], work: Callable[..., dict], seconds: float = 0, deal: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df with columns that work(space, *inputs) gives for each row; columns of these names are replaced. One space a row.
    seconds: after which a row's status is timeout. deal: the rows are dealt to tasks first; without it there is no shuffle. keep: the
    columns of df that are passed on (None: all)."""
    work = guarded(work, outputs, seconds)
    bounded_batches(df.sparkSession)
    source, kept, places, schema = _source(df, inputs, outputs, keep, deal)
    registered = registry()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        install(*registered)
        for b in portions(batches):
            rows = [work(Space(), *r) for r in zip(*(b.column(i).to_pylist() for i in places), strict=True)]
            arrays = [pa.array([r.get(c) for r in rows], ARROW[t]) for c, t in outputs.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *arrays], [*kept, *outputs])

    return source.mapInArrow(kernel, schema)


def add_rows(df: DataFrame, inputs: list[str], outputs: dict[str, str], works: Callable[..., list[Callable[[], dict]]], seconds: float = 0, keep: list[str] | None = None) -> DataFrame:
    """df with columns as add_columns() makes them, and a row for each of the works that works(space, *inputs) prepares: what they share
    is done once. Each has the limit of seconds and gets the status of its own; what goes wrong in preparing is the status of one row."""
    bounded_batches(df.sparkSession)
    source, kept, places, schema = _source(df, inputs, outputs, keep, True)
    registered = registry()

    def each(*args) -> list[dict]:
        found = guarded(lambda: {"works": works(*args)}, outputs, seconds)()
        return [guarded(w, outputs, seconds)() for w in found["works"]] if "works" in found else [found]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        install(*registered)
        for b in portions(batches):
            rows = [each(Space(), *r) for r in zip(*(b.column(i).to_pylist() for i in places), strict=True)]
            at = pa.array([i for i, found in enumerate(rows) for _ in found], pa.int64())
            flat = [r for found in rows for r in found]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(kept))), *(pa.array([r.get(c) for r in flat], ARROW[t]) for c, t in outputs.items())], [*kept, *outputs])

    return source.mapInArrow(kernel, schema)


def chosen(outputs: dict[str, str], columns: list[str] | None) -> dict[str, str]:
    """Those of the outputs that are asked for (None: all), and the status."""
    return {c: t for c, t in outputs.items() if columns is None or c in columns or c == "status"}


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "map<string,long>": pa.map_(pa.string(), pa.int64())}
NODE = {"node_id": "int", "parent_id": "int", "ord": "int", "depth": "int", "last_id": "int", "kind": "string", "dtype": "string", "con": "string", "prim_type": "string", "prim_val": "string", "height": "int", "size": "int", "digest": "string", "kids": "array<string>", "parse_error": "string"}
#: What a node table has unless told otherwise.
PLAIN = [c for c in NODE if c not in ("kids", "parse_error")]


def parsed(space: Space, name: str, *texts: str | None):
    parse = grammar(name)
    return [parse(space, t) if t is not None else _missing() for t in texts]


def _missing():
    raise ParseError("there is no text")


def parse_row(space: Space, name: str, text: str | None) -> dict:
    try:
        [t] = parsed(space, name, text)
    except ParseError as e:
        return {"parse_error": str(e)}
    return {"ast": encode(t), "height": t.height, "n_nodes": t.size}


def node_table(df: DataFrame, text_col: str, name: str, columns: list[str], values_only: bool = False) -> DataFrame:
    """A row for each node of each tree, with the other columns of df; a text without a tree has none or, if parse_error is among the
    columns, one that tells why and has no node. Trees of lines need no parser. values_only: of the nodes, those of values; the others,
    most of a tree, don't leave the worker."""
    if grammar(name) is lines:
        if not values_only:
            return line_nodes(df, text_col, columns)
        nodes = line_nodes(df, text_col, [*columns, *(["prim_type"] if "prim_type" not in columns else [])])
        values = nodes.where(F.col("prim_type").isNotNull() | F.col("parse_error").isNotNull() if "parse_error" in columns else F.col("prim_type").isNotNull())
        return values if "prim_type" in columns else values.drop("prim_type")
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text_col and c not in columns]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(kept).dtypes] + [f"{c} {NODE[c]}" for c in columns])
    registered, wanted, kinds = registry(), frozenset(columns), frozenset([PRIM]) if values_only else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        install(*registered)
        space = Space()
        for b in batches:
            rows, found, n_nodes = [], {c: [] for c in columns}, 0
            for i, text in enumerate(b.column(len(kept)).to_pylist()):
                try:
                    space = space.next_row()
                    [t] = parsed(space, name, text)
                    nodes = node_columns(t, wanted | {"node_id"}, kinds)
                    n = len(nodes["node_id"])
                except Exception as e:  # a row's fault is its result, never the task's
                    if "parse_error" in wanted:
                        why = str(e) if isinstance(e, ParseError) else f"{type(e).__name__}: {e}"
                        rows.append((i, 1))
                        for c in columns:
                            found[c].append(why.encode(errors="replace").decode() if c == "parse_error" else None)
                    continue
                rows.append((i, n))
                for c in columns:
                    found[c] += nodes[c] if c in nodes else [None] * n
                n_nodes += n
                if n_nodes > 100_000:
                    yield flushed(b, rows, found)
                    rows, found, n_nodes = [], {c: [] for c in columns}, 0
            if rows:
                yield flushed(b, rows, found)

    def flushed(b: pa.RecordBatch, rows: list, found: dict) -> pa.RecordBatch:
        at = pa.array([i for i, n in rows for _ in range(n)], pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(kept))), *(pa.array(found[c], ARROW[NODE[c]]) for c in columns)], [*kept, *columns])

    return dealt(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`"))).mapInArrow(kernel, schema)


def _too_large(options: Options, *trees) -> dict | None:
    n = sum(t.size for t in trees)
    return {"status": "too-large", "error": f"{n} nodes"} if options.max_nodes and n > options.max_nodes else None


DIFF = {"status": "string", "error": "string", "patch": "string", "n_changes": "int", "n_copies": "int", "nm": "long", "patch_cost": "long", "cost": "long", "operations": "map<string,long>", "secs": "double", "result": "string"}
MERGE = {"status": "string", "error": "string", "merged": "string", "labels": "array<string>", "conflicts": "array<string>"}
DIFF_ALL, MERGE_ALL = frozenset(DIFF), frozenset(MERGE)
#: What of a difference needs the alignment.
ALIGNED = frozenset({"cost", "operations", "secs"})


def diff_row(space: Space, name: str, source: str | None, target: str | None, options: Options, wanted=DIFF_ALL) -> dict:
    """patch, counts, costs, CPU seconds of difference and alignment, and the text or tree that the patch makes of the source; what isn't
    wanted isn't worked out, but for the status."""
    try:
        a, b = parsed(space, name, source, target)
    except ParseError as e:
        return {"status": "parse-error", "error": str(e)}
    return diff_trees(space, name, a, b, options, wanted)


def diff_trees(space: Space, name: str, a, b, options: Options, wanted=DIFF_ALL) -> dict:
    if large := _too_large(options, a, b):
        return large
    began = time.process_time()
    try:
        patch = patches.diff(space, a, b, options)
        aligned = alignment.align(space, patch)[0] if wanted & ALIGNED else None
        spent = time.process_time() - began
        made = patches.apply(space, patch, a)
    except ValueError as e:
        return {"status": "error", "error": str(e)}
    write = unparser(name)
    given = {
        "patch": lambda: patches.encode_patch(patch), "n_changes": lambda: len(patches.leaves(patch)), "n_copies": lambda: sum(c.delete is c.insert for c in patches.leaves(patch)),
        "nm": lambda: a.size + b.size, "patch_cost": lambda: patches.cost(patch), "cost": lambda: alignment.patch_align_cost(aligned), "operations": lambda: sorted(alignment.operations(aligned).items()), "secs": lambda: spent,
        "result": lambda: None if made is None else write(made) if write else encode(made),
    }
    return {"status": "apply-fail" if made is None else "success" if made is b else "merge-diff"} | {c: f() for c, f in given.items() if c in wanted}



def merge_row(space: Space, name: str, a: str | None, o: str | None, b: str | None, expected: str | None, options: Options, wanted=MERGE_ALL) -> dict:
    """status, and of the merged text, labels and conflicts what is wanted."""
    texts = [o, a, b]
    try:
        a, o, b = parsed(space, name, a, o, b)
        want = parsed(space, name, expected)[0] if expected is not None else None
    except ParseError as e:
        return {"status": "parse-error", "error": str(e)}
    if large := _too_large(options, a, o, b):
        return large
    try:
        status, merged, found = merging.merge3(space, a, o, b, options, want)
    except ValueError as e:
        return {"status": "error", "error": str(e)}
    given = {"merged": lambda: None if merged is None else merged_text(space, name, merged, texts), "labels": lambda: [c.label for c in found], "conflicts": lambda: [merging.show_conflict(c) for c in found]}
    return {"status": status} | {c: f() for c, f in given.items() if c in wanted}


#: What of a merge has no names in it.
NAMELESS = frozenset({"status", "labels"})
#: Outlines whose merges a task remembers before it begins anew, and characters of the texts of one of them.
OUTLINES, OUTLINED = 1 << 12, 1 << 12


def merges(name: str, options: Options, wanted=MERGE_ALL) -> Callable[..., dict]:
    """merge_row() for the rows of a task. A merge asks of values only which are the same: status and labels are those of any texts that
    differ in names alone. If nothing else is wanted, and the grammar tells names, such texts are parsed and merged once."""
    known: dict[tuple, dict] = {}
    nameless = wanted <= NAMELESS

    def work(space: Space, a: str | None, o: str | None, b: str | None, expected: str | None = None) -> dict:
        texts = a, o, b, expected
        key = outline(name, *texts) if nameless and sum([len(t) for t in texts if t is not None]) <= OUTLINED else None
        if key is None:
            return merge_row(space, name, *texts, options, wanted)
        if (row := known.get(key)) is None:
            row = merge_row(space, name, *texts, options, wanted)
            if len(known) >= OUTLINES:
                known.clear()
            known[key] = row
        return row

    return work


def merge_trees(space: Space, a, o, b, want, options: Options, known: dict) -> dict:
    """The status of a merge; known: see merging.merge3()."""
    if large := _too_large(options, a, o, b):
        return large
    try:
        return {"status": merging.merge3(space, a, o, b, options, want, known)[0]}
    except ValueError as e:
        return {"status": "error", "error": str(e)}


def merged_text(space: Space, name: str, merged, texts: list[str]) -> str:
    """A merged tree as text, in the layout of the base and both sides where the grammar has one, or encoded."""
    write = unparser(name)
    if write is None:
        return encode(merged)
    return layouts.keep(name, space, merged, texts, write) if name in layouts.GRAMMARS and grammar(name) is layouts.GRAMMARS[name] else write(merged)



def chain_row(space: Space, name: str, versions: list, options: Options) -> dict:
    """The patches between neighbouring versions, composed from the left, applied to the first version."""
    try:
        trees = parsed(space, name, *versions) if versions else _missing()
    except (ParseError, TypeError) as e:
        return {"status": "parse-error", "error": str(e)}
    try:
        whole = patches.diff(space, trees[0], trees[0], options)
        for x, y in zip(trees, trees[1:]):
            if (whole := patches.compose(space, patches.diff(space, x, y, options), whole)) is None:
                return {"status": "compose-fail"}
        made = patches.apply(space, whole, trees[0])
    except ValueError as e:
        return {"status": "error", "error": str(e)}
    write = unparser(name)
    return {"status": "apply-fail" if made is None else "success", "patch": patches.encode_patch(whole), "result": None if made is None else write(made) if write else encode(made)}


CHAIN = {"status": "string", "error": "string", "patch": "string", "result": "string"}


def patch_row(space: Space, name: str, source: str | None, target: str | None, options: Options) -> dict:
    """The patch alone."""
    try:
        a, b = parsed(space, name, source, target)
    except ParseError as e:
        return {"status": "parse-error", "error": str(e)}
    return {"status": "success", "patch": patches.encode_patch(patches.diff(space, a, b, options))}


def compose_row(space: Space, second: str | None, first: str | None) -> dict:
    """The patch that does first, then second."""
    if second is None or first is None:
        return {"status": "no-patch"}
    both = patches.compose(space, patches.decode_patch(space, second), patches.decode_patch(space, first))
    return {"status": "compose-fail"} if both is None else {"status": "success", "patch": patches.encode_patch(both)}


def chain_patches_row(space: Space, chain: list | None) -> dict:
    """The patch that does what the patches of the chain do one after another."""
    if chain is None or not chain:
        return {"status": "no-such-version" if chain is None else "empty"}
    if None in chain:
        return {"status": "no-patch"}
    whole = patches.decode_patch(space, chain[0])
    for p in chain[1:]:
        if (whole := patches.compose(space, patches.decode_patch(space, p), whole)) is None:
            return {"status": "compose-fail"}
    return {"status": "success", "patch": patches.encode_patch(whole)}


def apply_row(space: Space, name: str, patch: str | None, text: str | None) -> dict:
    try:
        [t] = parsed(space, name, text)
        p = patches.decode_patch(space, patch) if patch is not None else _missing()
    except ParseError as e:
        return {"status": "parse-error", "error": str(e)}
    try:
        made = patches.apply(space, p, t)
    except ValueError as e:
        return {"status": "error", "error": str(e)}
    write = unparser(name)
    return {"status": "apply-fail" if made is None else "success", "result": None if made is None else write(made) if write else encode(made)}


APPLY = {"status": "string", "error": "string", "result": "string"}


def composes_row(space: Space, second: str | None, first: str | None) -> dict:
    if second is None or first is None:
        return {"parse_error": "there is no patch"}
    return {"composes": patches.patch_composes(space, patches.decode_patch(space, second), patches.decode_patch(space, first))}


def show_row(space: Space, name: str, source: str | None, target: str | None, width: int) -> dict:
    """The tree of source and, with a target, the patch to it, over lines of at most `width` characters."""
    try:
        trees = parsed(space, name, source, *([target] if target is not None else []))
    except ParseError as e:
        return {"parse_error": str(e)}
    out = {"tree_text": layout.pretty(trees[0], width)}
    return out if target is None else out | {"patch_text": layout.pretty(patches.diff(space, *trees, Options()), width)}


SHOW = {"tree_text": "string", "patch_text": "string", "parse_error": "string"}


def canonical_row(space: Space, patch: str | None) -> dict:
    """Digests of the patch as one change and of each of its changes that isn't a copy, equal up to the names of variables."""
    if patch is None:
        return {"parse_error": "there is no patch"}
    p = patches.decode_patch(space, patch)
    changed = [c for c in patches.leaves(p) if c.delete is not c.insert]
    return {"patch_digest": patches.change_digest(space, patches.distribute(space, p)), "edit_digests": [patches.change_digest(space, c) for c in changed], "edits": [patches.show_change(patches.canonical(space, c)) for c in changed]}


CANONICAL = {"patch_digest": "string", "edit_digests": "array<string>", "edits": "array<string>", "parse_error": "string"}


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: bit-parallel, one big integer operation for each element of b."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def register_sql(spark: SparkSession, seconds: float = 0) -> None:
    """tree_ast(grammar, text), tree_diff(grammar, a, b), tree_apply(grammar, patch, text), tree_merge(grammar, a, o, b) for Spark SQL,
    and the table function tree_nodes(grammar, text), to be joined with LATERAL: the node table of each row's text. Results are JSON but for tree_ast's s-expression (null where there is none). seconds: limit of a row (0: none)."""
    options = Options()

    def ast_text(name, text):
        row = parse_row(space := Space(), name, text)
        return render(space.decode(row["ast"])) if "ast" in row else None

    registered = registry()

    def found(work, outputs: dict[str, str], *args) -> dict:
        install(*registered)
        return guarded(work, outputs, seconds)(Space(), *args)

    def row(work, outputs: dict[str, str]):
        """work's row as JSON; what goes wrong is its status."""
        return lambda *args: json.dumps(found(work, outputs, *args))

    functions = {
        "tree_ast": lambda name, text: found(lambda s: {"text": ast_text(name, text)}, {"status": "string"}).get("text"),
        "tree_diff": row(lambda s, g, a, b: diff_row(s, g, a, b, options), DIFF),
        "tree_apply": row(apply_row, APPLY),
        "tree_merge": row(lambda s, g, a, o, b: merge_row(s, g, a, o, b, None, options), MERGE),
    }
    for name, f in functions.items():
        spark.udf.register(name, F.udf(f, "string", useArrow=True))

    class TreeNodes:
        def eval(self, name: str, text: str):
            install(*registered)
            found = guarded(lambda: {"nodes": node_columns(parsed(Space(), name, text)[0], frozenset(PLAIN))}, {"status": "string"}, seconds)()
            if "nodes" in found:  # as in a node table, a text without a tree has no rows
                yield from zip(*(found["nodes"][c] for c in PLAIN), strict=True)

    spark.udtf.register("tree_nodes", F.udtf(TreeNodes, returnType=", ".join(f"{c} {NODE[c]}" for c in PLAIN), useArrow=True))
