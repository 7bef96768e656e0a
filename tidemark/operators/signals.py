"""Graded signals: joins and column expressions over all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio


def risk_reward(direction: Column, entry: Column, stop: Column, target: Column) -> Column:
    up = direction == "long"
    return ratio(F.when(up, target - entry).otherwise(entry - target), F.when(up, entry - stop).otherwise(stop - entry))


def quality(touches: Column, density: Column) -> Column:
    return clip(1 + clip(0.03 * (touches - 4), -0.15, 0.15) + clip(0.1 * (density - 1), -0.1, 0.15), 0.8, 1.2)


def strength(*multipliers: Column) -> Column:
    out = F.lit(0.5)
    for m in multipliers:
        out = out * m
    return clip(out, 0, 1)


def grade(value: Column) -> Column:
    return F.when(value >= 0.55, "A").when(value >= 0.4, "B").otherwise("C")


def signals(bars: DataFrame, zones: DataFrame, buffer: float = 0.02, most_stop: float = 0.06, least_rr: float = 2.0) -> DataFrame:
    """Retest candidates of each symbol's zones at its last price, with geometry, gates and grade; abstentions say why."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    met = zones.join(last, "symbol")
    direction = F.when(F.col("price") > F.col("hi"), "long").when(F.col("price") < F.col("lo"), "short")
    entry = F.when(F.col("price") > F.col("hi"), F.col("hi")).otherwise(F.col("lo"))
    out = met.withColumns({"direction": direction, "entry": entry}).where("direction IS NOT NULL")
    up = F.col("direction") == "long"
    out = out.withColumn("stop", F.when(up, F.greatest(F.col("lo") * (1 - buffer), F.col("entry") * (1 - most_stop))).otherwise(F.least(F.col("hi") * (1 + buffer), F.col("entry") * (1 + most_stop))))
    near = zones.select("symbol", F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    goal = F.when(up, F.when(F.col("t_lo") > F.col("entry") * 1.003, F.col("t_lo"))).otherwise(F.when(F.col("t_hi") < F.col("entry") * 0.997, F.col("t_hi")))
    keys = ["symbol", "lo", "hi", "touches", "volume", "price", "direction", "entry", "stop"]
    # A symbol has a few zones, so the meeting of zones with zones is bounded.
    targeted = out.join(near, "symbol").withColumn("goal", goal).groupBy(*keys).agg(F.min("goal").alias("up_goal"), F.max("goal").alias("down_goal"))
    targeted = targeted.withColumn("target", F.when(up, F.col("up_goal")).otherwise(F.col("down_goal"))).drop("up_goal", "down_goal")
    density = ratio("volume", F.avg("volume").over(W.partitionBy("symbol")))
    scored = targeted.withColumns({"rr": risk_reward(F.col("direction"), F.col("entry"), F.col("stop"), F.col("target")), "strength": strength(quality(F.col("touches"), density))})
    reason = F.when(F.col("target").isNull(), "no_target").when(F.col("rr") < least_rr, "low_rr")
    return scored.withColumns({"abstain": reason, "grade": grade(F.col("strength"))})
