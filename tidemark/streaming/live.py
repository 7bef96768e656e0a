"""Structured Streaming forms of the bar and state operators.

The batch operators are used as they are where a streaming aggregate can run
them; keyed state is used where an update depends on the last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import bars as B


def stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 10) -> DataFrame:
    """New Parquet files of a landing folder, of a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def live_bars(trades: DataFrame, width: str = "1 hour", delay: str = "12 seconds") -> DataFrame:
    """Bars of a trade stream; a bar is emitted once, when the watermark has passed its end."""
    return B.bars(trades.withWatermark("ts", delay), width)


def once_each(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Repeated deliveries dropped: the first of equal keys within the delay stays."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sampled_books(books: DataFrame, every: str = "5 seconds", delay: str = "12 seconds") -> DataFrame:
    """At most one book per symbol and interval: its first."""
    out = books.withWatermark("ts", delay).groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by(F.struct("ts", "bids", "asks"), "ts").alias("b"))
    return out.select("symbol", "b.*")


BAR_STATE = "open_s long, close double, received_ms long"
REVISIONS = "symbol string, open_s long, close double, revision boolean"


def _revise(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest bar of a symbol: a later bar replaces it, the same bar is revised by what arrived last, an earlier one is dropped."""
    now = state.get if state.exists else None
    out = []
    for pdf in batches:
        for r in pdf.sort_values(["open_s", "received_ms"], kind="stable").itertuples(index=False):
            if now is None or r.open_s > now[0] or (r.open_s == now[0] and r.received_ms >= now[2]):
                out.append((key[0], r.open_s, r.close, now is not None and r.open_s == now[0]))
                now = (r.open_s, r.close, r.received_ms)
    if now is not None:
        state.update(tuple(now))
    yield pd.DataFrame(out, columns=["symbol", "open_s", "close", "revision"])


def last_bars(updates: DataFrame) -> DataFrame:
    """Accepted updates of each symbol's newest bar; the state is one bar a symbol. updates: symbol, open_s, close, received_ms."""
    return updates.groupBy("symbol").applyInPandasWithState(_revise, REVISIONS, BAR_STATE, "append", GroupStateTimeout.NoTimeout)


PHASES = {"registered": ("armed", "closed"), "armed": ("triggered", "invalidated", "closed"), "triggered": ("tp1_managed", "invalidated", "closed"), "tp1_managed": ("closed",), "invalidated": ("closed",), "closed": ()}
TRADE_STATE = "phase string, stop double, best double, opened_ms long, seen_ms long"
TRANSITIONS = "trade_id long, event_ms long, phase string, reason string, stop double"
HOUR_MS = 3_600_000
# Hours by direction (long, short) to an orphan's end, a stall (no target, less than STALL in favour), a timeout;
# the gain from which a stop goes to entry early, and from which it trails.
ORPHAN, STALLED, TIMEOUT = (48, 12), (120, 8), (504, 48)
STALL, EARLY, TRAIL = 0.01, 0.02, 0.025


def _step(r, phase: str, stop: float, best: float | None, opened: int) -> tuple[str, float, float | None, int, list[tuple[str, str]]]:
    """One observation: time rules first, then the stop, then the targets; a stop only ever moves nearer."""
    short = r.direction != "long"
    sign, age = (-1.0 if short else 1.0), (r.event_ms - opened) / HOUR_MS
    adverse, favour = (r.high, r.low) if short else (r.low, r.high)
    done = lambda why: ("closed", stop, best, opened, [("closed", why)])
    if phase in ("registered", "armed"):
        steps = [("armed", "seen")] if phase == "registered" else []
        if not steps and age > ORPHAN[short]:
            return done("orphan")
        if r.low <= r.entry <= r.high and not steps:
            return "triggered", stop, r.entry, r.event_ms, [("triggered", "entry")]
        if r.low <= r.entry <= r.high:
            return "triggered", stop, r.entry, r.event_ms, [*steps, ("triggered", "entry")]
        return "armed", stop, best, opened, steps
    gain = sign * (best / r.entry - 1)
    if phase == "triggered" and age > STALLED[short] and gain < STALL:
        return done("stall")
    if age > TIMEOUT[short]:
        return done("timeout")
    if sign * (adverse - stop) <= 0:
        return done("stop" if phase == "triggered" and sign * (stop - r.entry) < 0 else "trail")
    if sign * (favour - r.tp2) >= 0:
        return done("tp2")
    best = favour if sign * (favour - best) > 0 else best
    gain = sign * (best / r.entry - 1)
    if phase == "triggered" and sign * (favour - r.tp1) >= 0:
        return "tp1_managed", r.entry if sign * (r.entry - stop) > 0 else stop, best, opened, [("tp1_managed", "tp1")]
    if gain >= EARLY and sign * (r.entry - stop) > 0:
        stop = r.entry
    if phase == "tp1_managed" and gain > TRAIL:
        trail = r.entry + 0.5 * (best - r.entry)
        stop = trail if sign * (trail - stop) > 0 else stop
    return phase, stop, best, opened, []


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        phase, stop, _, _, seen = state.get
        state.remove()
        yield pd.DataFrame([(key[0], seen, "closed", "unseen", stop)], columns=["trade_id", "event_ms", "phase", "reason", "stop"])
        return
    phase, stop, best, opened, seen = state.get if state.exists else ("registered", None, None, None, None)
    out = []
    for pdf in batches:
        for r in pdf.sort_values("event_ms", kind="stable").itertuples(index=False):
            if phase == "closed" or seen is not None and r.event_ms < seen:
                continue  # later than what it would change
            stop, opened, seen = (r.stop if stop is None else stop), (r.event_ms if opened is None else opened), r.event_ms
            phase, stop, best, opened, steps = _step(r, phase, stop, best, opened)
            out += [(key[0], r.event_ms, p, why, stop) for p, why in steps]
    if phase == "closed":
        state.remove()
    else:
        state.update((phase, stop, best, opened, seen))
        state.setTimeoutTimestamp(int(max(seen + UNSEEN_MS, state.getCurrentWatermarkMs() + 1)))
    yield pd.DataFrame(out, columns=["trade_id", "event_ms", "phase", "reason", "stop"])


#: A trade that no observation reaches for so long is closed, so its state does not stay.
UNSEEN_MS = 30 * 24 * HOUR_MS


def _in_time() -> Column:
    """The time of an event, a millisecond on: Spark drops what lies at the watermark itself, and that is still in time."""
    return F.timestamp_millis(F.col("event_ms") + 1)


def trade_lifecycle(observations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Transitions of each trade. observations: trade_id, event_ms, direction, entry, stop, tp1, tp2, high, low.

    The state of a trade goes when it is closed, or when the watermark is UNSEEN_MS past its last observation. An
    observation of a trade closed before opens it anew, so the source must not repeat what is older than the delay.
    """
    timed = observations.withColumn("__ts", _in_time()).withWatermark("__ts", delay)
    return timed.groupBy("trade_id").applyInPandasWithState(_advance, TRANSITIONS, TRADE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


ZONE_STATE = "status string, reactions int, lo double, hi double, seen_ms long"
ZONE_CHANGES = "symbol string, zone_id string, event_ms long, status string, role string, lo double, hi double"


def _zone(expire_ms: int, confirm: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["symbol", "zone_id", "event_ms", "status", "role", "lo", "hi"]
        if state.hasTimedOut:
            status, _, lo, hi, seen = state.get
            state.remove()
            yield pd.DataFrame([(*key, seen, "expired", None, lo, hi)], columns=columns)
            return
        status, reactions, lo, hi, seen = state.get if state.exists else (None, 0, None, None, None)
        out = []
        for pdf in batches:
            for r in pdf.sort_values("event_ms", kind="stable").itertuples(index=False):
                if seen is not None and r.event_ms < seen:
                    continue
                now, lo, hi, seen = status or "forming", r.lo, r.hi, r.event_ms
                role = "support" if r.side == "long" else "resistance"
                if now in ("forming", "confirmed"):
                    broken = r.close < r.lo if r.side == "long" else r.close > r.hi
                    reactions += int(r.reacted)
                    if broken:
                        now, role = "broken", "resistance" if r.side == "long" else "support"
                    elif r.worked:
                        now = "worked"
                    elif reactions >= confirm:
                        now = "confirmed"
                if now != status:
                    out.append((*key, r.event_ms, now, role, lo, hi))
                status = now
        state.update((status, reactions, lo, hi, seen))
        state.setTimeoutTimestamp(int(max(seen + expire_ms, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(out, columns=columns)

    return run


def zone_lifecycle(sightings: DataFrame, bar_ms: int = HOUR_MS, bars: int = 8, confirm: int = 1, delay: str = "1 hour") -> DataFrame:
    """Changes of status of each zone: forming, confirmed (a reaction), worked, broken (its role turns), expired (unseen for `bars` bars).

    sightings: symbol, zone_id, event_ms, side, lo, hi, close, reacted, worked. Only changes are emitted; an expired
    zone's state goes.
    """
    timed = sightings.withColumn("__ts", _in_time()).withWatermark("__ts", delay)
    return timed.groupBy("symbol", "zone_id").applyInPandasWithState(_zone(bars * bar_ms, confirm), ZONE_CHANGES, ZONE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_each(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to `sink`; without `every`, all that is there now and then stops."""
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def replayed(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a Parquet folder, and reads it."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
