"""Three-way merges over a stream of versions: the base and two sides of each key, in any order and over many batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arbordiff.functions.kernels import MERGE, guarded, merge_row
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import Space
from arbordiff.sources.grammars import install, registry

#: What a row can be.
ROLES = ("o", "a", "b")


class _Merges(StatefulProcessor):
    """State of a key: its texts (base and the latest version of either side), the next version of each side, and what came too early. A
    timer runs while something waits: when it ends, the missing versions are given up."""

    def __init__(self, key: str, role: str, version: str, text: str, grammar: str, wait_ms: int, options: Options, seconds: float, registered: tuple):
        self.names, self.grammar, self.wait_ms, self.options, self.seconds, self.registered = (key, role, version, text), grammar, wait_ms, options, seconds, registered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "role string", "text string, next long")
        self.early = handle.getMapState("early", "role string, version long", "text string")
        self.timer = handle.getValueState("timer", "at long")
        self.merge = guarded(lambda a, o, b: merge_row(Space(), self.grammar, a, o, b, None, self.options), MERGE, self.seconds)
        install(*self.registered)

    def _held(self, role: str) -> tuple[str | None, int]:
        return self.texts.getValue((role,)) if self.texts.containsKey((role,)) else (None, 0)

    def _advance(self, role: str) -> bool:
        """Takes in what has come of a side, as far as no version is missing."""
        text, after = self._held(role)
        moved = False
        while self.early.containsKey((role, after)):
            text, moved = self.early.getValue((role, after))[0], True
            self.early.removeKey((role, after))
            after += 1
        if moved:
            self.texts.updateValue((role,), (text, after))
        return moved

    def _result(self, key: tuple) -> pd.DataFrame:
        (o, base), (a, at), (b, bt) = (self._held(r) for r in ROLES)
        if not (base and at and bt):
            return pd.DataFrame()
        found = self.merge(a, o, b)
        row = (key[0], at - 1, bt - 1, found["status"], found.get("merged"), ",".join(found.get("labels") or []))
        return pd.DataFrame([row], columns=[self.names[0], "a_version", "b_version", "status", "merged", "labels"])

    def _set_timer(self, now: int) -> None:
        waiting = next(iter(self.early.keys()), None) is not None
        if self.timer.exists() and not waiting:
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        elif waiting and self.wait_ms and not self.timer.exists():
            self.handle.registerTimer(now + self.wait_ms)
            self.timer.update((now + self.wait_ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, role, version, text = self.names
        moved = False
        for frame in rows:
            for r, v, t in zip(frame[role], frame[version], frame[text], strict=True):
                v = 0 if r == "o" else int(v)
                if r in ROLES and v >= self._held(r)[1]:  # what came before stays as it was
                    self.early.updateValue((r, v), (t,))
        for r in ROLES:
            moved |= self._advance(r)
        self._set_timer(timerValues.getCurrentProcessingTimeInMs())
        if moved and len(out := self._result(key)):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        least: dict[str, int] = {}
        for r, v in list(self.early.keys()):
            least[r] = min(v, least.get(r, v))
        for r, v in least.items():
            self.texts.updateValue((r,), (self._held(r)[0], v))
            self._advance(r)
        self._set_timer(timerValues.getCurrentProcessingTimeInMs())
        if least and len(out := self._result(key)):
            yield out

    def close(self) -> None:
        pass


def merge_versions(stream: DataFrame, key: str, role: str, version: str, text: str, grammar: str, wait_ms: int = 0, min_height: int = 1, mode: str = "nonest", seconds: float = 0) -> DataFrame:
    """(key, a_version, b_version, status, merged, labels): the merge of the latest versions of both sides, whenever one of them or the base
    has come. role is o (the base; its first text counts), a or b; versions of a side count from 0. A version that comes before the ones
    ahead of it waits for them, over batches and restarts, at most wait_ms milliseconds (0: for ever); then those are given up. Rows of
    other roles and versions that came already are left out; of one version the last row of a batch counts.

    The state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    kinds = dict(stream.dtypes)
    processor = _Merges(key, role, version, text, grammar, wait_ms, Options(min_height, mode), seconds, registry())
    rows = stream.select(key, role, version, text).where(f"`{key}` is not null and `{role}` is not null and (`{role}` = 'o' or `{version}` is not null)")
    schema = f"{key} {kinds[key]}, a_version long, b_version long, status string, merged string, labels string"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if wait_ms else "None")
