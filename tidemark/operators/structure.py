"""Price structure: swings, breaks, levels touched, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import by_symbol


def last_swings(swings: DataFrame, flag: str, price: str, n: int) -> DataFrame:
    """symbol and v: the prices of the last n rows with the flag, newest first. Only n rows a symbol are collected."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    last = swings.where(F.col(flag)).select("symbol", "ts", F.col(price).alias("p"), place.alias("n")).where(F.col("n") <= n)
    return last.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("v"))


def last_two_structure(swings: DataFrame) -> DataFrame:
    """up: the last two highs and lows both rise; down: both fall; else range. Input has flags ph and pl."""
    high = last_swings(swings, "ph", "high", 2).select("symbol", F.col("v").alias("h"))
    low = last_swings(swings, "pl", "low", 2).select("symbol", F.col("v").alias("l"))
    h, l = (lambda i: F.try_element_at("h", F.lit(i))), (lambda i: F.try_element_at("l", F.lit(i)))  # noqa: E741
    label = F.when((h(1) > h(2)) & (l(1) > l(2)), "up").when((h(1) < h(2)) & (l(1) < l(2)), "down").otherwise("range")
    return high.join(low, "symbol").where((F.size("h") == 2) & (F.size("l") == 2)).select("symbol", label.alias("structure"))


def breaks(bars: DataFrame, lookback: int = 20, buffer: float = 0.003) -> DataFrame:
    """1 where the close first passes the highest high of `lookback` bars before by the buffer, -1 for lows, 0 else."""
    w = by_symbol().rowsBetween(-lookback, -1)
    full = F.count("close").over(w) == lookback
    state = F.when(full & (F.col("close") > F.max("high").over(w) * (1 + buffer)), 1).when(full & (F.col("close") < F.min("low").over(w) * (1 - buffer)), -1).otherwise(0)
    out = bars.withColumn("state", state)
    return out.withColumn("bos", F.when(F.col("state") != F.coalesce(F.lag("state").over(by_symbol()), F.lit(0)), F.col("state")).otherwise(0))


def runs(bars: DataFrame, inside: Column, gap: int = 2) -> DataFrame:
    """symbol, first, last, n of each run of bars that are inside, runs no more than `gap` bars apart joined."""
    numbered = bars.withColumn("__rn", F.row_number().over(by_symbol())).where(inside)
    far = F.coalesce(F.col("__rn") - F.lag("__rn").over(by_symbol()) > gap + 1, F.lit(False)).cast("int")
    grouped = numbered.withColumn("__far", far).withColumn("__run", F.sum("__far").over(by_symbol()))
    return grouped.groupBy("symbol", "__run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("__run")


def confirmation_bodies(level: Column) -> Column:
    """How many bodies up to this bar lie wholly above the level, without a break."""
    above = F.least("open", "close") > level
    n = F.row_number().over(by_symbol())
    return n - F.coalesce(F.max(F.when(~above, n)).over(by_symbol().rowsBetween(W.unboundedPreceding, 0)), F.lit(0))


def stop_volume(bars: DataFrame, n: int = 6) -> DataFrame:
    """Per symbol, the n bars that trade most volume in the narrowest range, as a share of the mean volume."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    mean = F.avg("volume").over(W.partitionBy("symbol"))
    width = (F.max("high").over(w) - F.min("low").over(w)) / F.avg("close").over(w)
    score = F.try_divide(F.avg("volume").over(w) / mean, F.greatest(width, F.lit(0.01)))
    scored = bars.withColumns({"score": F.when(F.count("close").over(w) == n, score), "lo": F.min("low").over(w), "hi": F.max("high").over(w)})
    return scored.where("score IS NOT NULL").groupBy("symbol").agg(F.max_by(F.struct("ts", "lo", "hi", "score"), F.struct("score", "ts")).alias("v")).select("symbol", "v.*")


def level_worked(bars: DataFrame, level: Column, tolerance: float = 0.006, move: float = 0.025, within: int = 5, skip_last: int = 3) -> DataFrame:
    """Per symbol, touches of the level that a move away of `move` followed within some bars; the newest bars don't count."""
    from_end = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    ahead = F.max("high").over(by_symbol().rowsBetween(1, within))
    hit = (F.abs(F.col("low") / level - 1) <= tolerance) & (ahead >= level * (1 + move)) & (F.col("__end") > skip_last)
    return bars.withColumns({"__end": from_end, "__hit": F.lit(0)}).withColumn("__hit", hit.cast("int")).groupBy("symbol").agg(F.sum("__hit").alias("worked"))
