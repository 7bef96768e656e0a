"""Pump and dump legs as keyed state: what `operators.legs.leg_events` gives, as observations arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.legs import COLUMNS, EVENTS, Leg, fold


class _Legs(StatefulProcessor):
    def __init__(self, rise: float):
        self.rise = rise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.legs = handle.getMapState("legs", "kind string", "start_ms long, start double, extreme double, open boolean")
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        legs = {kind: Leg(*self.legs.getValue((kind,))) if self.legs.containsKey((kind,)) else Leg() for kind in ("pump", "dump")}
        last = self.seen.get()[0] if self.seen.exists() else None
        given = pd.concat(list(rows)).sort_values("ms", kind="stable")
        given = given if last is None else given[given["ms"] > last]
        if len(given):
            out = fold(key[0], legs, zip(given["ms"].tolist(), given["price"].tolist(), given["change"].tolist(), strict=True), self.rise)
            for kind, leg in legs.items():
                self.legs.updateValue((kind,), (leg.start_ms, leg.start, leg.extreme, leg.open))
            self.seen.update((int(given["ms"].iloc[-1]),))
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def leg_events(observations: DataFrame, rise: float = 0.15) -> DataFrame:
    """EVENTS as they happen; an observation not after the last one of its symbol is dropped. The state is two legs a symbol."""
    given = observations.where("symbol IS NOT NULL AND ms IS NOT NULL").select("symbol", "ms", "price", "change")
    return given.groupBy("symbol").transformWithStateInPandas(_Legs(rise), EVENTS, "append", "none")
