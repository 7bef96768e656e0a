"""What trades and book history say about displayed depth: icebergs, absorption, vanished walls; caps and ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.operators.stats import trailing_sums
from tidemark.operators.zones import clusters


def price_bucket(price: Column | str, width: float) -> Column:
    return F.floor((F.col(price) if isinstance(price, str) else price) / width).cast("long")


def icebergs(trades: DataFrame, levels: DataFrame, width: float, least: float = 1.4) -> DataFrame:
    """symbol, bucket, filled, displayed, ratio: price buckets where more traded than the book showed."""
    filled = trades.groupBy("symbol", price_bucket("price", width).alias("bucket")).agg(F.sum("qty").alias("filled"))
    displayed = levels.groupBy("symbol", price_bucket("price", width).alias("bucket")).agg(F.sum("qty").alias("displayed"))
    return filled.join(displayed, ["symbol", "bucket"]).withColumn("ratio", ratio("filled", "displayed")).where(F.col("ratio") > least)


def absorption(footprint: DataFrame, walls: DataFrame, least: float = 0.2) -> DataFrame:
    """Walls (symbol, side, bucket, notional) whose bucket traded against them: selling into bids, buying into asks."""
    share = ratio(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell"))
    met = walls.join(footprint, ["symbol", "bucket"]).withColumn("delta", share)
    return met.where(((F.col("side") == "bid") & (F.col("delta") <= -least)) | ((F.col("side") == "ask") & (F.col("delta") >= least))).select("symbol", "side", "bucket", "notional", "delta")


def vanished(history: DataFrame, now_sample: Column, samples: int = 3, keep: float = 0.25) -> DataFrame:
    """Levels seen in at least `samples` samples before the one given that show less than `keep` of their mean size in it.

    history: symbol, sample, side, price, notional.
    """
    past, now = F.col("sample") < now_sample, F.col("sample") == now_sample
    seen = history.groupBy("symbol", "side", "price").agg(
        F.countDistinct(F.when(past, F.col("sample"))).alias("samples"), F.avg(F.when(past, F.col("notional"))).alias("before"), F.coalesce(F.sum(F.when(now, F.col("notional"))), F.lit(0.0)).alias("now")
    )
    return seen.where((F.col("samples") >= samples) & (F.col("now") < keep * F.col("before")))


def within_caps(signals: DataFrame, per_day: int, burst: int, burst_s: int) -> DataFrame:
    """Signals (signal_id, symbol, direction, ts) with whether the day's cap of their symbol and direction and the burst cap over all still leave room.

    The burst cap looks at all symbols; its counts are trailing sums by time, which no single task makes.
    """
    day = F.floor(F.unix_seconds("ts") / 86_400)
    nth = F.row_number().over(W.partitionBy("symbol", "direction", day).orderBy("ts", "signal_id"))
    timed = signals.withColumn("__t", F.unix_micros("ts"))
    counted = trailing_sums(timed, [], "__t", burst_s * 1_000_000, F.lit(1)).withColumnRenamed("total", "in_burst")
    return timed.withColumn("nth", nth).join(counted, "__t").drop("__t").withColumns({"day_ok": F.col("nth") <= per_day, "burst_ok": F.col("in_burst") <= burst})


def merged_ladder(levels: DataFrame, key: str = "symbol", tolerance: float = 0.015) -> DataFrame:
    """key, price, n: each key's prices (column price), runs within tolerance of their running mean become that mean. Equal prices count once."""
    points = levels.select(key, "price").distinct().withColumn("weight", F.lit(0.0))
    return clusters(points, [key], tolerance).select(key, F.col("mean").alias("price"), "n")
