"""Differences over streams. The kernels keep nothing between rows, so that api functions work on a stream as they are; what needs the
previous version of a document keeps it as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arbordiff.functions.kernels import DIFF, diff_row, guarded
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import Space
from arbordiff.sources.grammars import install, registry


def version_diffs(stream: DataFrame, key: str, order: str, text: str, grammar: str, idle_ms: int = 0, min_height: int = 1, mode: str = "nonest", seconds: float = 0) -> DataFrame:
    """(key, order, status, n_changes, cost, patch): each version of a key against the one before it, in the order of the column `order`
    within a batch and of arrival between batches; the first version of a key has status 'first'. State: one text for each key, dropped
    after idle_ms milliseconds without a version (0: never). seconds: limit of a difference, as for diff_pairs."""
    kinds = dict(stream.dtypes)
    options = Options(min_height, mode)
    compare, registered = guarded(lambda a, b: diff_row(Space(), grammar, a, b, options), DIFF, seconds), registry()

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        install(*registered)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        before, out = (state.get[0] if state.exists else None), []
        for place, now in zip(rows[order], rows[text], strict=True):
            found = {"status": "first"} if before is None else compare(before, now)
            out.append((k[0], place, found["status"], found.get("n_changes"), found.get("cost"), found.get("patch")))
            before = now if now is not None else before
        if before is not None:
            state.update((before,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        frame = pd.DataFrame(out, columns=[key, order, "status", "n_changes", "cost", "patch"])
        yield frame.astype({"n_changes": "Int64", "cost": "Int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, status string, n_changes long, cost long, patch string"
    return stream.groupBy(key).applyInPandasWithState(work, schema, "text string", "append", timeout)
