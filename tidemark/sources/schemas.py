"""Declared schemas: nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _S, _TS = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TRADES = _struct(symbol=_S, trade_id=_L, ts=_TS, price=_D, qty=_D, is_buy=T.BooleanType())
BARS = _struct(symbol=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=_D, taker_buy=_D, trades=_L)
METRIC = _struct(symbol=_S, ts=_TS, value=_D)
LEVEL = _struct(price=_D, qty=_D)
BOOK = _struct(symbol=_S, ts=_TS, bids=T.ArrayType(LEVEL), asks=T.ArrayType(LEVEL))
LIQUIDATIONS = _struct(symbol=_S, venue=_S, ts=_TS, side=_S, qty=_D, price=_D)
PLANES = _struct(symbol=_S, venue=_S, plane=_S, value=_D, source=_S, received_ms=_L, event_ms=_L, bound_ms=_L)
CLOSED_TRADES = _struct(
    trade_id=_L, symbol=_S, direction=_S, opened_at=_TS, closed_at=_TS, entry=_D, stop=_D, tp1=_D, exit=_D, tp1_hit=T.BooleanType(), partial_pct=_D, close_reason=_S, phase=_S, cost_pct=_D
)
LEDGER_EVENTS = _struct(event=_S, symbol=_S, direction=_S, ts=_TS, blockers=T.ArrayType(_S), score=_D)
