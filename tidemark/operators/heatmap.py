"""Liquidation heatmaps: realised events by price bucket, merged with forward zones, summed to risk on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio

#: Buckets over the reach (a share of the price) either way.
BUCKETS, REACH = 48, 0.12
# Shares at which a zone is shown, leans to a side, or a cascade is named; the least notional of a cascade.
SHOWN, LEANS, CASCADE, CASCADE_LEAST = 0.12, 1.3, 1.5, 25_000.0


def realised(events: DataFrame, prices: DataFrame, now: Column, window_s: int, buckets: int = BUCKETS, reach: float = REACH) -> DataFrame:
    """symbol, bucket, longs, shorts, events of the liquidations in the window before `now`.

    events: symbol, ts, side (BUY closes shorts), qty, price; prices: symbol, ref (one row each).
    """
    near = events.where((F.col("ts") >= F.timestamp_seconds(F.unix_seconds(now) - window_s)) & (F.col("ts") <= now)).join(prices, "symbol").where("ref > 0")
    low, size = F.col("ref") * (1 - reach), F.col("ref") * 2 * reach / buckets
    inside = near.where(F.col("price").between(low, F.col("ref") * (1 + reach))).withColumn("bucket", F.least(F.floor((F.col("price") - low) / size), F.lit(buckets - 1)).cast("int"))
    money = F.col("qty") * F.col("price")
    return inside.groupBy("symbol", "bucket").agg(F.sum(F.when(F.col("side") != "BUY", money).otherwise(0.0)).alias("longs"), F.sum(F.when(F.col("side") == "BUY", money).otherwise(0.0)).alias("shorts"), F.count("*").alias("events"))


def merged(maps: list[tuple[DataFrame, float]]) -> DataFrame:
    """One map of several (symbol, bucket, longs, shorts, and events where they are realised), each with a weight for its notional."""
    parts = [m.select("symbol", "bucket", (F.col("longs") * w).alias("longs"), (F.col("shorts") * w).alias("shorts"), (F.col("events") if "events" in m.columns else F.lit(0)).cast("long").alias("events")) for m, w in maps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("symbol", "bucket").agg(F.sum("longs").alias("longs"), F.sum("shorts").alias("shorts"), F.sum("events").alias("events"))


def density(heatmap: DataFrame, prices: DataFrame, most: int = 8, buckets: int = BUCKETS, reach: float = REACH) -> DataFrame:
    """The `most` fullest buckets of a symbol with centre, intensity (of its fullest), side, and whether it is spent."""
    total = F.col("longs") + F.col("shorts")
    top = F.max("total").over(W.partitionBy("symbol"))
    centre = F.col("ref") * (1 - reach) + (F.col("bucket") + 0.5) * F.col("ref") * 2 * reach / buckets
    rows = heatmap.withColumn("total", total).withColumn("intensity", F.coalesce(ratio(F.col("total"), top), F.lit(0.0))).join(prices, "symbol").withColumn("price", centre)
    side = F.when(F.col("longs") > F.col("shorts") * LEANS, "long_liq").when(F.col("shorts") > F.col("longs") * LEANS, "short_liq")
    shown = rows.where((F.col("intensity") >= SHOWN) | (F.col("events") > 0)).withColumns({"side": side, "spent": (F.col("events") == 0) & (F.col("intensity") < 0.25)})
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("total"), "bucket"))
    return shown.withColumn("rank", place).where(F.col("rank") <= most).select("symbol", "rank", "bucket", "price", "longs", "shorts", "intensity", "events", "side", "spent")


def at_risk(heatmap: DataFrame, prices: DataFrame, buckets: int = BUCKETS, reach: float = REACH) -> DataFrame:
    """Per symbol: longs below and shorts above the price, the nearest of each, and the cascade that they threaten."""
    centre = F.col("ref") * (1 - reach) + (F.col("bucket") + 0.5) * F.col("ref") * 2 * reach / buckets
    rows = heatmap.join(prices, "symbol").withColumn("price", centre)
    below, above = F.col("price") < F.col("ref"), F.col("price") > F.col("ref")
    out = rows.groupBy("symbol").agg(
        F.coalesce(F.sum(F.when(below, F.col("longs"))), F.lit(0.0)).alias("longs"), F.coalesce(F.sum(F.when(above, F.col("shorts"))), F.lit(0.0)).alias("shorts"),
        F.max(F.when(below, F.col("price"))).alias("nearest_long"), F.min(F.when(above, F.col("price"))).alias("nearest_short"),
    )
    l, s = F.col("longs"), F.col("shorts")  # noqa: E741
    return out.withColumn("cascade", F.when((l > s * CASCADE) & (l >= CASCADE_LEAST), "long_flush").when((s > l * CASCADE) & (s >= CASCADE_LEAST), "short_squeeze"))


def squeeze_fuel(funding: Column, long_short: Column, longs: Column, shorts: Column) -> tuple[Column, Column]:
    """Fuel of a long and of a short squeeze in [0, 1]: the mean of the parts that are measured; NULL if none is."""
    total = longs + shorts

    def mean(parts: list[Column]) -> Column:
        have = F.array_compact(F.array(*parts))
        return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have))

    crowd, risk = long_short > 0, total > 0
    long = [F.when(crowd, clip(long_short - 1, 0, 1)), clip(funding / 0.0005, 0, 1), F.when(risk, clip(longs / total, 0, 1))]
    short = [F.when(crowd, clip((1 - long_short) / 0.5, 0, 1)), clip(-funding / 0.0005, 0, 1), F.when(risk, clip(shorts / total, 0, 1))]
    return mean(long), mean(short)
