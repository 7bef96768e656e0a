"""Prices of a symbol: which source to take, whether it is plausible, where it stands in the session, what a trade made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def middle(bid: Column, ask: Column) -> Column:
    """Of a bid and an ask that don't cross; NULL otherwise."""
    return F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)


def resolved(last: Column, bid: Column, ask: Column, book_bid: Column, book_ask: Column, mark: Column) -> tuple[Column, Column]:
    """The freshest executable price and its source: last trade, best quotes' middle, book's middle, mark."""
    ranked = [("ticker", _positive(last)), ("bbo_mid", middle(bid, ask)), ("book_mid", middle(book_bid, book_ask)), ("mark", _positive(mark))]
    source = F.lit(None).cast("string")
    for name, c in reversed(ranked):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.coalesce(*[c for _, c in ranked]), source


def implausible(price: Column, references: Column, most_pct: float = 25.0) -> Column:
    """Why a price can't be trusted: it is missing, or too far from the mean of its positive references (an array); NULL if it can."""
    good = F.filter(references, lambda x: x > 0)
    mean = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good))
    return F.when(~F.coalesce(price > 0, F.lit(False)), "missing_price").when(F.abs(price - mean) / mean * 100 > most_pct, "price_deviation")


def session_stats(bars: DataFrame, last: DataFrame, n: int = 1440) -> DataFrame:
    """symbol, high, low, range_pct, position (of the last price, 0.5 in a flat range), bars_used over the last n bars. last: symbol, price."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    s = bars.withColumn("__n", place).where(F.col("__n") <= n).groupBy("symbol").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("bars_used")).join(last, "symbol")
    at = F.when(F.col("high") > F.col("low"), clip((F.col("price") - F.col("low")) / (F.col("high") - F.col("low")), 0, 1)).otherwise(0.5)
    return s.select("symbol", "high", "low", (100 * (F.when(F.col("low") > 0, F.col("high") / F.col("low")) - 1)).alias("range_pct"), at.alias("position"), "bars_used")


def result_pct(direction: Column, lo: Column, hi: Column, exit_: Column, tp1: Column, tp1_hit: Column, fixed_pct: Column) -> tuple[Column, Column]:
    """A trade's result in percent from the worse edge of its entry band, and its basis: whole, or partly closed at the first target."""
    up = direction == "long"
    base = _positive(F.when(lo.isNotNull() & hi.isNotNull(), F.when(up, hi).otherwise(lo)).otherwise(F.coalesce(lo, hi)))
    leg = lambda price: F.when(up, 1).otherwise(-1) * ratio(price - base, base) * 100
    part = F.coalesce(tp1_hit & (tp1 > 0) & (fixed_pct > 0) & (fixed_pct < 100), F.lit(False))
    share = fixed_pct / 100
    value = F.when(part, share * leg(tp1) + (1 - share) * leg(exit_)).otherwise(leg(exit_))
    return value, F.when(value.isNotNull(), F.when(part, "partial").otherwise("full"))
