"""Scalar column functions. NULL means "not measured"; no function turns it into a number unless a fill is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL, NaN and infinities become NULL."""
    c = col(c)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF), c)


def finite_or(c: Column | str, fill: float) -> Column:
    return F.coalesce(finite(c), F.lit(float(fill)))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Into [low, high]; NULL stays."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def normal_label(c: Column | str, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first cut that the value reaches, from the top; NULL stays NULL."""
    c, out = col(c), F.lit(otherwise)
    for cut, label in sorted(cuts):
        out = F.when(c >= cut, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def weighted_available(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted mean of the parts that are not NULL, and the share of weight they have."""
    total = float(sum(w for _, w in parts))
    have = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts])
    value = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    return ratio(value, have), have / total


def trend_stack(close: Column, fast: Column, middle: Column, slow: Column) -> Column:
    """1 if close > fast > middle > slow, -1 if all the other way, else 0."""
    up = (close > fast) & (fast > middle) & (middle > slow)
    down = (close < fast) & (fast < middle) & (middle < slow)
    return F.when(up, 1).when(down, -1).otherwise(0)


def oi_regime(oi_change: Column, price_change: Column, oi_least: float = 15.0, price_least: float = 5.0) -> Column:
    """Open interest against price, both in percent: who is entering or leaving."""
    oi_up, oi_down = oi_change >= oi_least, oi_change <= -oi_least
    up, down = price_change >= price_least, price_change <= -price_least
    return (
        F.when(oi_up & up, "new_money_long").when(oi_up & down, "new_money_short").when(oi_down & up, "squeeze").when(oi_down & down, "flush").when(oi_up, "coiling").otherwise("neutral")
    )


def to_tick(price: Column, tick: float, mode: str = "nearest") -> Column:
    """Decimal quantisation: `down` for floors, `up` for ceilings."""
    p, t = price.cast("decimal(28,10)"), F.lit(str(tick)).cast("decimal(18,10)")
    steps = {"nearest": lambda x: F.bround(x, 0), "down": F.floor, "up": F.ceil}[mode](p / t)
    return (steps.cast("decimal(28,10)") * t).cast("double")


def epoch_time(value: Column) -> Column:
    """Timestamp of an epoch number whose unit follows from its size: s, ms, us or ns."""
    v = value.cast("long")
    micros = F.when(F.abs(v) >= 10**18, F.floor(v / 1000).cast("long")).when(F.abs(v) >= 10**15, v).when(F.abs(v) >= 10**11, v * 1000).otherwise(v * 1_000_000)
    return F.timestamp_micros(micros)
