"""The zone registry as keyed state: one map of zones a symbol, brought forward tick by tick.

Equal to `operators.registry.updated` applied to the same ticks in turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.registry import BAR_S, CONFIRM, ENDED, EXPIRE_BARS, SIGHTINGS, TOLERANCE, ZONES

TICKS = f"tick_ms long, price double, {SIGHTINGS}"
CHANGES = f"tick_ms long, event string, {ZONES}"
_COLUMNS = [f.split()[0] for f in ZONES.split(", ")]
_RECORD = ZONES.split(", ", 2)[2]


def _plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


def _look(z: dict, price: float, buffer: float) -> None:
    long = z["direction"] == "long"
    inside = z["lo"] <= price <= z["hi"]
    z["touches"] += inside and not z["in_zone"]
    z["in_zone"] = inside
    edge = z["hi"] if long else z["lo"]
    if z["touches"] and z["target"] is not None and (span := z["target"] - edge if long else edge - z["target"]) > 0:
        way = (price - edge if long else edge - price) / span
        if way > 0:
            z["progress"] = max(z["progress"] or 0.0, _rounded(way))
        z["reactions"] += way >= 1 and z["reactions"] < z["touches"]
    past = (z["lo"] - price) / z["lo"] * 100 if long else (price - z["hi"]) / z["hi"] * 100
    if past > 0:
        z["adverse"] = max(z["adverse"] or 0.0, _rounded(past))
    if z["status"] in ENDED:
        return
    reached = z["target"] is not None and (price >= z["target"] if long else price <= z["target"])
    if (z["adverse"] or 0.0) >= buffer * 100:
        z["status"] = "broken"
    elif reached and z["reactions"]:
        z["status"] = "worked"
    elif z["reactions"] >= CONFIRM:
        z["status"] = "confirmed"


def _rounded(x: float) -> float:
    """Half away from zero, as Spark rounds."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def tick(book: dict[str, dict], sighted: list[dict], price: float | None, now_ms: int, buffer: float, tolerance: float = TOLERANCE) -> list[tuple[str, str]]:
    """Brings a symbol's zones (by zone_id) to a tick; (zone_id, event) of each change."""
    narrowest = lambda s: (s["hi"] - s["lo"], s["lo"], s["anchor"], s["horizon"])
    usable = {tuple(s.items()): s for s in sighted if s["lo"] is not None and s["hi"] is not None and s["lo"] <= s["hi"] and (s["anchor"] or 0) > 0}
    seen: dict[str, list[dict]] = {}
    alone: dict[tuple, list[dict]] = {}
    for s in usable.values():
        same = [(abs(s["anchor"] / z["anchor"] - 1), k) for k, z in book.items() if z["direction"] == s["direction"] and z["kind"] == s["kind"] and z["anchor"] > 0]
        near = [x for x in same if x[0] <= tolerance]
        if near:
            seen.setdefault(min(near)[1], []).append(s)
        else:
            alone.setdefault((s["direction"], s["kind"]), []).append(s)
    for (direction, kind), several in alone.items():
        groups: list[list[dict]] = []
        for s in sorted(several, key=lambda s: s["anchor"]):
            if not groups or s["anchor"] > groups[-1][0]["anchor"] * (1 + tolerance):
                groups.append([])
            groups[-1].append(s)
        for group in groups:
            first = min(group, key=narrowest)
            bucket = math.floor(math.log(first["anchor"]) / math.log(1 + tolerance))
            seen.setdefault(f"{first['horizon']}:{direction}:{kind}:{bucket}", []).extend(group)
    changes, broken = [], []
    for key, several in seen.items():
        s, z = min(several, key=narrowest), book.get(key)
        new = z is None
        if new:
            z = book[key] = {c: s.get(c) for c in _COLUMNS} | {"zone_id": key, "first_ms": now_ms, "seen": 0, "touches": 0, "reactions": 0, "status": "forming", "in_zone": False}
        elif s["hi"] - s["lo"] <= z["hi"] - z["lo"] or z["hi"] <= z["lo"]:
            z |= {c: s[c] for c in ("lo", "hi", "anchor")}
        z |= {"target": s["target"], "last_ms": now_ms, "seen": z["seen"] + len(several)}
        before = z["status"]
        if price is not None and price > 0:
            _look(z, price, buffer)
        if z["status"] != before or new:
            changes.append((key, z["status"] if z["status"] != before else "created"))
        if z["status"] == "broken" != before:
            broken.append(z)
    for key, z in book.items():
        if key not in seen and z["status"] not in ENDED and now_ms - z["last_ms"] > BAR_S.get(z["horizon"], 3600) * 1000 * EXPIRE_BARS:
            z["status"] = "expired"
            changes.append((key, "expired"))
    for z in sorted(broken, key=lambda z: z["zone_id"]):
        other = "short" if z["direction"] == "long" else "long"
        key = f"{z['horizon']}:{other}:flip:{z['zone_id'].rsplit(':', 1)[-1]}"
        if key not in book:
            book[key] = {c: z[c] for c in _COLUMNS} | {"zone_id": key, "direction": other, "kind": "flip", "target": None, "first_ms": now_ms, "last_ms": now_ms, "seen": 1, "touches": 0, "reactions": 0, "progress": None, "adverse": None, "status": "forming", "in_zone": False, "flipped_from": z["zone_id"]}
            changes.append((key, "created"))
    return changes


class _Registry(StatefulProcessor):
    def __init__(self, buffer: float, tolerance: float):
        self.buffer, self.tolerance = buffer, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.zones = handle.getMapState("zones", "zone_id string", _RECORD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (symbol,) = key
        names = _COLUMNS[2:]
        book = {k[0]: {"symbol": symbol, "zone_id": k[0]} | {c: _plain(x) for c, x in zip(names, v, strict=True)} for k, v in self.zones.iterator()}
        ticks: dict[int, list[dict]] = {}
        for pdf in rows:
            for row in pdf.to_dict("records"):
                ticks.setdefault(int(row["tick_ms"]), []).append({c: _plain(x) for c, x in row.items()})
        out, touched = [], set()
        for now in sorted(ticks):
            sighted = [{c: r[c] for c in ("symbol", "horizon", "direction", "kind", "lo", "hi", "anchor", "target")} for r in ticks[now] if r["direction"] is not None]
            price = max((r["price"] for r in ticks[now] if r["price"] is not None), default=None)
            for zone, event in tick(book, sighted, price, now, self.buffer, self.tolerance):
                out.append((now, event, *[book[zone][c] for c in _COLUMNS]))
            touched |= {k for k, z in book.items() if z["last_ms"] == now or z["status"] == "expired"}
        for k in touched:
            self.zones.updateValue((k,), tuple(book[k][c] for c in names))
        yield pd.DataFrame(out, columns=["tick_ms", "event", *_COLUMNS]).astype(object)

    def close(self) -> None:
        pass


def zone_registry(ticks: DataFrame, buffer: float = 0.02, tolerance: float = TOLERANCE) -> DataFrame:
    """CHANGES of every symbol's zones. ticks: TICKS; a tick that shows no zone is a row without direction.

    Ticks of a symbol arrive in order; those of one micro-batch are sorted. Needs the RocksDB state store.
    """
    return ticks.groupBy("symbol").transformWithStateInPandas(_Registry(buffer, tolerance), CHANGES, "append", "none")
