"""Bounded rings of samples per symbol as list state.

A symbol keeps its last samples, at least a spacing apart, no more than a number
and none older than an age behind the newest; so the state of a symbol is bounded
whatever arrives. A ring can begin with the samples of a table. Idle symbols go by
the state store's own time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SAMPLES = "symbol string, ms long, snap string"
KEPT = "symbol string, ms long, snap string, size int, oldest_ms long"
#: Samples of a ring, milliseconds between two, milliseconds that the oldest may lie behind the newest.
KEEP, SPACING_MS, AGE_MS = 720, 5_000, 3_600_000


def push(ring: list[tuple[int, str]], ms: int, snap: str, keep: int, spacing_ms: int, age_ms: int) -> bool:
    """Adds a sample that is in order and far enough from the last; what no longer belongs goes. Whether it was added."""
    if ring and ms - ring[-1][0] < spacing_ms:
        return False
    ring.append((ms, snap))
    while len(ring) > keep or ms - ring[0][0] > age_ms:
        ring.pop(0)
    return True


class _Rings(StatefulProcessor):
    def __init__(self, keep: int, spacing_ms: int, age_ms: int, ttl_ms: int | None):
        self.keep, self.spacing_ms, self.age_ms, self.ttl_ms = keep, spacing_ms, age_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "ms long, snap string", self.ttl_ms)

    def _add(self, key, rows: pd.DataFrame) -> list[tuple]:
        ring = [(int(ms), snap) for ms, snap in self.samples.get()]
        out = []
        given = rows.dropna(subset=["ms"]).sort_values("ms", kind="stable")
        for ms, snap in zip(given["ms"].astype("int64").tolist(), given["snap"].tolist(), strict=True):
            if push(ring, ms, snap, self.keep, self.spacing_ms, self.age_ms):
                out.append((key[0], ms, snap, len(ring), ring[0][0]))
        if out:
            self.samples.put(ring)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self._add(key, pd.concat(list(rows)))
        yield pd.DataFrame(out, columns=["symbol", "ms", "snap", "size", "oldest_ms"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(key, initialState)

    def close(self) -> None:
        pass


def rings(samples: DataFrame, keep: int = KEEP, spacing_ms: int = SPACING_MS, age_ms: int = AGE_MS, ttl_ms: int | None = None, begin: DataFrame | None = None) -> DataFrame:
    """The samples that enter their symbol's ring (SAMPLES), with the ring's size and oldest time after each.

    begin: SAMPLES of a table that the rings start from. ttl_ms: milliseconds of the clock after which an idle ring goes; such
    a query is never done (each batch looks at the clock), so it runs by a trigger of time, not once over what is there.
    Samples not after the last one of their symbol by the spacing are left out, late ones too.
    """
    grouped = samples.where("symbol IS NOT NULL").select("symbol", "ms", "snap").groupBy("symbol")
    first = None if begin is None else begin.where("symbol IS NOT NULL").select("symbol", "ms", "snap").groupBy("symbol")
    return grouped.transformWithStateInPandas(_Rings(keep, spacing_ms, age_ms, ttl_ms), KEPT, "append", "none" if ttl_ms is None else "processingTime", first)
