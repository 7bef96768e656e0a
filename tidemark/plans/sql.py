"""Parts of the comparison SQL."""

from __future__ import annotations

#: events as a tape.
TRADES = "trades AS (SELECT event_type AS symbol, event_id AS trade_id, epoch_us(ts) AS us, value AS price, 1.0::DOUBLE AS qty, event_id % 2 = 0 AS is_buy FROM events WHERE value IS NOT NULL)"


def bars(seconds: int = 3600) -> str:
    """CTEs trades and b: bars with ts_s (epoch seconds) and rn (number within the symbol)."""
    return f"""{TRADES}, bars AS (
  SELECT symbol, (us // {seconds}000000) * {seconds} AS ts_s,
    arg_min(price, struct_pack(a := us, b := trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(a := us, b := trade_id)) AS close,
    sum(qty) AS volume, sum(price * qty) AS quote_volume, sum(CASE WHEN is_buy THEN qty ELSE 0.0 END) AS taker_buy, count(*) AS trades
  FROM trades GROUP BY 1, 2
), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s) AS rn FROM bars)"""


def r(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0)"


def over(n: int, end: int = 0) -> str:
    first = n - 1 - end
    return f"OVER (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN {first} PRECEDING AND {'CURRENT ROW' if end == 0 else f'{-end} PRECEDING'})"


LINE = "OVER (PARTITION BY symbol ORDER BY ts_s)"


def full(n: int, x: str, count: str = "rn") -> str:
    """x where n rows are there, else NULL."""
    return f"CASE WHEN {count} >= {n} THEN {x} END"


def recursion(name: str, source: str, x: str, alpha: float, n: int, offset: int = 0) -> str:
    """A CTE with y = y + alpha (x - y), seeded at row offset + n with the mean of the n rows up to it."""
    first = offset + n
    return f"""{name}_seed AS (SELECT symbol, avg({x}) AS y FROM {source} WHERE rn BETWEEN {offset + 1} AND {first} GROUP BY symbol HAVING count(*) = {n}),
{name} AS (
  SELECT symbol, {first}::BIGINT AS rn, y FROM {name}_seed
  UNION ALL
  SELECT s.symbol, s.rn, e.y + {alpha!r} * (s.{x} - e.y) FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1
)"""
