"""Pump and dump legs: episodes that the price opens and closes.

A leg opens when the price has moved far enough over a lookback and none of its
kind is open, follows its extreme, and closes when half of the way is given back,
or unresolved when its time is over; then the symbol may open another. What opens
depends on what has closed, so a symbol's observations are folded in order, the
same step by step in a batch and in the stream of `streaming.legs`; symbols and
kinds run side by side, and bars of one width are bounded.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share given back, hours to resolve, hours between the starts of two legs of a kind.
RETRACE, RESOLVE_H, APART_H = 0.5, 48, 24
HOUR_MS = 3_600_000
EVENTS = "symbol string, kind string, ms long, event string, price double, start_ms long, start double, extreme double, fraction double"
COLUMNS = [f.split()[0] for f in EVENTS.split(", ")]


@dataclass
class Leg:
    """What is known of a symbol's legs of one kind: the last start, and the open leg's price and extreme."""

    start_ms: int | None = None
    start: float = 0.0
    extreme: float = 0.0
    open: bool = False


def observe(leg: Leg, kind: str, ms: int, price: float, change: float | None, rise: float) -> tuple | None:
    """One observation; the event (ms, event, price, start_ms, start, extreme, fraction) it makes, if any."""
    sign = 1 if kind == "pump" else -1
    if leg.open:
        leg.extreme = max(leg.extreme, price) if sign > 0 else min(leg.extreme, price)
        way = sign * (leg.extreme - leg.start)
        fraction = sign * (leg.extreme - price) / way if way > 0 else 0.0
        end = "retrace_hit" if fraction + 1e-9 >= RETRACE else "retrace_miss" if ms - leg.start_ms > RESOLVE_H * HOUR_MS else None
        leg.open = end is None
        return end and (ms, end, price, leg.start_ms, leg.start, leg.extreme, fraction)
    rested = leg.start_ms is None or ms - leg.start_ms >= APART_H * HOUR_MS
    if change is None or change != change or sign * change < rise or not rested:
        return None
    leg.start_ms, leg.start, leg.extreme, leg.open = ms, price, price, True
    return ms, f"leg_{kind}", price, ms, price, price, 0.0


def fold(symbol: str, legs: dict[str, Leg], rows: Iterable[tuple[int, float, float | None]], rise: float) -> list[tuple]:
    """The events of observations (ms, price, change) in order of time; legs are changed."""
    out = []
    for ms, price, change in rows:
        if price is None or not price > 0:
            continue
        for kind in ("pump", "dump"):
            event = observe(legs[kind], kind, int(ms), price, change, rise)
            if event:
                out.append((symbol, kind, event[0], event[1], *event[2:]))
    return out


def leg_events(observations: DataFrame, rise: float = 0.15) -> DataFrame:
    """EVENTS of all legs. observations: symbol, ms, price, change (over the lookback, a share), one row per symbol and ms."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ms", kind="stable")
        rows = zip(pdf["ms"].tolist(), pdf["price"].tolist(), pdf["change"].tolist(), strict=True)
        return pd.DataFrame(fold(pdf["symbol"].iat[0], {"pump": Leg(), "dump": Leg()}, rows, rise), columns=COLUMNS)

    given = observations.where("symbol IS NOT NULL AND ms IS NOT NULL").select("symbol", "ms", "price", "change")
    return given.groupBy("symbol").applyInPandas(run, EVENTS)


def history(events: DataFrame) -> DataFrame:
    """Per symbol the legs, how many were resolved and how, and how fast they gave back."""
    hours = F.when(F.col("event") == "retrace_hit", (F.col("ms") - F.col("start_ms")) / HOUR_MS)
    out = events.groupBy("symbol").agg(
        F.count_if(F.col("event") == "leg_pump").alias("pumps"), F.count_if(F.col("event") == "leg_dump").alias("dumps"),
        F.count_if(F.col("event").startswith("retrace")).alias("resolved"), F.count_if(F.col("event") == "retrace_hit").alias("hits"), F.avg(hours).alias("retrace_hours"),
    )
    return out.withColumn("retrace_pct", 100 * F.try_divide("hits", "resolved"))


def score_bonus(bias: str = "both") -> tuple[Column, Column]:
    """Points and flags of a symbol's history: repeats, legs that give back, legs that stick, fast ones."""
    n, rate, hours = F.col("pumps"), F.col("retrace_pct"), F.col("retrace_hours")
    # Fixed values.
    rules = [("repeat_pumper", n >= 2, 4.0), ("retrace_friendly", (n >= 2) & (rate >= 55), 6.0 if bias in ("short", "both") else 0.0), ("sticky_pump", (n >= 3) & (rate < 30), -4.0), ("fast_retrace", (n >= 2) & (hours <= 4), 3.0)]
    points = sum((F.when(c, w).otherwise(0.0) for _, c, w in rules), F.lit(0.0))
    return points, F.array_compact(F.array(*[F.when(c, name) for name, c, _ in rules]))
