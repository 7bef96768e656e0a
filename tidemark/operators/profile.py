"""Volume profiles: histogram over price, point of control, value area, high and low nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(bars: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def histogram(bars: DataFrame, buckets: int = 60) -> DataFrame:
    """symbol, bucket, volume, p_min, size: each bar's volume spread evenly over the buckets from its low to its high.

    A bar spans at most `buckets` rows and sums combine before the shuffle.
    """
    bounds = bars.groupBy("symbol").agg(F.min("low").alias("p_min"), F.max("high").alias("p_max"))
    size = (F.col("p_max") - F.col("p_min")) / buckets
    at = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("p_min")) / F.col("size")), F.lit(0)), F.lit(buckets - 1)).cast("int")
    spread = bars.join(bounds, "symbol").withColumn("size", size).where("size > 0").withColumns({"b0": at("low"), "b1": at("high")})
    rows = spread.select("symbol", "p_min", "size", F.explode(F.sequence("b0", "b1")).alias("bucket"), (F.col("volume") / (F.col("b1") - F.col("b0") + 1)).alias("v"))
    return rows.groupBy("symbol", "bucket").agg(F.round(F.sum("v"), 9).alias("volume"), F.first("p_min").alias("p_min"), F.first("size").alias("size"))


def dense(hist: DataFrame, buckets: int) -> DataFrame:
    """symbol, p_min, size, v: the volumes of all buckets as one array (of fixed length)."""
    grouped = hist.groupBy("symbol").agg(F.first("p_min").alias("p_min"), F.first("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("bucket", "volume"))).alias("m"))
    return grouped.select("symbol", "p_min", "size", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("v"))


def control_bucket(v: Column, buckets: int) -> Column:
    """The fullest bucket; of equals the one nearest the centre, then the lower."""
    ranked = F.transform(v, lambda x, i: F.struct((-x).alias("a"), F.abs(i - (buckets - 1) / 2).alias("d"), i.alias("i")))
    return F.array_min(ranked)["i"]


def value_area(v: Column, poc: Column, buckets: int, share: float = 0.7) -> Column:
    """struct(lo, hi): grows from the control bucket by the fuller neighbour (the upper of equals) up to the share."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    at = lambda i: F.when((i >= 0) & (i < buckets), F.get(v, i)).otherwise(F.lit(-1.0))

    def step(s: Column, _: Column) -> Column:
        left, right = at(s["lo"] - 1), at(s["hi"] + 1)
        more = s["acc"] < share * s["total"]
        up = more & (right >= left) & (right >= 0)
        down = more & ~up & (left >= 0)
        return F.struct(
            F.when(down, s["lo"] - 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
            F.when(up, s["acc"] + right).when(down, s["acc"] + left).otherwise(s["acc"]).alias("acc"), s["total"].alias("total"),
        )

    start = F.struct(poc.alias("lo"), poc.alias("hi"), F.get(v, poc).alias("acc"), total.alias("total"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(buckets - 1)), start, step)


def levels(bars: DataFrame, buckets: int = 60, share: float = 0.7) -> DataFrame:
    """symbol, poc, vah, val as bucket middles, upper and lower edges."""
    d = dense(histogram(bars, buckets), buckets).withColumn("b", control_bucket(F.col("v"), buckets))
    d = d.withColumn("area", value_area(F.col("v"), F.col("b"), buckets, share))
    price = lambda b: F.col("p_min") + b * F.col("size")
    return d.select("symbol", price(F.col("b") + 0.5).alias("poc"), price(F.col("area.hi") + 1).alias("vah"), price(F.col("area.lo")).alias("val"))


def nodes(hist: DataFrame, top: int = 3, high: float = 1.3, low: float = 0.5) -> DataFrame:
    """symbol, kind, rank, bucket, volume: buckets well over (hvn) or under (lvn) the mean of those that traded."""
    mean = F.avg("volume").over(W.partitionBy("symbol"))
    kind = F.when(F.col("volume") > high * mean, "hvn").when(F.col("volume") < low * mean, "lvn")
    marked = hist.withColumn("kind", kind).where("kind IS NOT NULL")
    sign = F.when(F.col("kind") == "hvn", -F.col("volume")).otherwise(F.col("volume"))
    rank = F.row_number().over(W.partitionBy("symbol", "kind").orderBy(sign, "bucket"))
    return marked.withColumn("rank", rank).where(F.col("rank") <= top).select("symbol", "kind", "rank", "bucket", "volume")


def poc_stability(bars: DataFrame, counts: tuple[int, ...] = (40, 60, 90, 120), most: float = 0.15) -> DataFrame:
    """Per symbol, the spread of the control price over several bucket counts, and whether it is within a share of the range."""
    parts = [levels(bars, n).select("symbol", "poc") for n in counts]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    width = bars.groupBy("symbol").agg((F.max("high") - F.min("low")).alias("width"))
    return union.groupBy("symbol").agg((F.max("poc") - F.min("poc")).alias("spread")).join(width, "symbol").withColumn("stable", F.col("spread") <= most * F.col("width"))


def naked(bars: DataFrame, poc: DataFrame, lookback: int) -> DataFrame:
    """Control prices (symbol, poc) that none of the newest bars touched."""
    touched = newest(bars, lookback).join(poc, "symbol").where(F.col("poc").between(F.col("low"), F.col("high"))).select("symbol").distinct()
    return poc.join(touched, "symbol", "left_anti")
