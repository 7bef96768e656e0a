"""Candidate setups at the last price of each symbol, by rule. Each gives symbol, candidate, direction, entry, lo, hi.

Zones of a symbol are few (a bounded list); what meets inside a symbol is zones, levels and its last bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import figures as G

# Half width of "at a level" without bars, edge shares of a box, distances (percent) of forward zones.
NEAR, EDGE, BESIDE, THIRD = 0.007, 0.35, 0.006, 1 / 3
FORWARD, DEEP, CHAIN = (0.5, 20.0), (0.5, 12.0), 0.02
PENNANT_BARS, PENNANT_TOUCHES = 40, 6
SHAPE = ("symbol", "candidate", "direction", "entry", "lo", "hi")


def context(bars: DataFrame, n: int = 96) -> DataFrame:
    """symbol, price (the last close), delta (mean absolute change of the last n closes, as a share)."""
    recent = G.newest(bars, n)
    step = F.abs(F.try_divide("close", F.lag("close").over(W.partitionBy("symbol").orderBy("i"))) - 1)
    return recent.withColumn("__step", step).groupBy("symbol").agg(F.max_by("close", "i").alias("price"), F.coalesce(F.avg("__step"), F.lit(NEAR)).alias("delta"))


def worked(levels: DataFrame, bars: DataFrame, n: int = 60, tolerance: float = 0.006, move: float = 0.025, within: int = 5, skip: int = 3) -> DataFrame:
    """levels (symbol, level, side, ...) with worked: a bar that touched the level and a move away of `move` soon after.

    long levels are touched by lows and left upwards, short ones the other way; the newest bars don't count.
    """
    recent = G.newest(bars, n)
    ahead = W.partitionBy("symbol").orderBy("i").rowsBetween(1, within)
    wide = recent.select("symbol", "i", "end", "high", "low", F.max("high").over(ahead).alias("__top"), F.min("low").over(ahead).alias("__bottom"))
    level = F.col("level")
    up = (F.abs(F.col("low") / level - 1) <= tolerance) & (F.col("__top") >= level * (1 + move))
    down = (F.abs(F.col("high") / level - 1) <= tolerance) & (F.col("__bottom") <= level * (1 - move))
    hit = F.coalesce(F.when(F.col("side") == "long", up).otherwise(down), F.lit(False)) & (F.col("i") <= F.col("end") - skip)
    return levels.join(wide, "symbol").groupBy(*levels.columns).agg(F.bool_or(hit).alias("worked"))


def allowed(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidates whose entry level is neither broken through, nor sawed, nor worked already."""
    keyed = candidates.select("symbol", F.col("entry").alias("level"), F.col("direction").alias("side")).distinct()
    judged = worked(G.saws(G.touches(keyed, bars), bars), bars)
    good = judged.where("NOT (touch <=> 'proboy') AND NOT saw AND NOT worked").select("symbol", F.col("level").alias("entry"), F.col("side").alias("direction"))
    return candidates.join(good, ["symbol", "entry", "direction"], "left_semi").select(*SHAPE)


def _as(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("candidate", F.lit(name)).select(*SHAPE)


def zone_retest(zones: DataFrame, now: DataFrame, bars: DataFrame) -> DataFrame:
    """The price is outside a zone: back to its near edge."""
    met = zones.join(now, "symbol").where("price > hi OR price < lo")
    up = F.col("price") > F.col("hi")
    return allowed(_as(met.withColumns({"direction": F.when(up, "long").otherwise("short"), "entry": F.when(up, F.col("hi")).otherwise(F.col("lo"))}), "zone_retest"), bars)


def zone_edge(zones: DataFrame, now: DataFrame, bars: DataFrame) -> DataFrame:
    """The price is in a zone (or just beside it), near one edge: towards the other."""
    met = zones.join(now, "symbol").where(F.col("price").between(F.col("lo") * (1 - BESIDE), F.col("hi") * (1 + BESIDE)) & (F.col("hi") > F.col("lo")))
    at = (F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    met = met.withColumns({"direction": F.when(at <= EDGE, "long").when(at >= 1 - EDGE, "short"), "entry": F.when(at <= EDGE, F.col("lo")).otherwise(F.col("hi"))}).where("direction IS NOT NULL")
    return allowed(_as(met, "zone_edge"), bars)


def forward_zone(zones: DataFrame, now: DataFrame) -> DataFrame:
    """The nearest zone below against the best-scored one above, between FORWARD percent away; the better score, the one above of equals."""
    met = zones.join(now, "symbol").withColumn("up", F.col("price") > F.col("hi")).where("price > hi OR price < lo")
    edge = F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo"))
    met = met.withColumn("entry", edge).withColumn("dist", F.abs(edge - F.col("price")) / F.col("price") * 100).where(F.col("dist").between(*FORWARD))
    met = met.withColumn("score", F.col("volume") / (1 + F.col("dist") / 10))
    rank = F.when(F.col("up"), -F.col("dist")).otherwise(F.col("score"))
    best = met.groupBy("symbol", "up").agg(F.max_by(F.struct("score", (~F.col("up")).alias("above"), "entry", "lo", "hi"), F.struct(rank, -F.col("lo"))).alias("b"))
    won = best.groupBy("symbol").agg(F.max_by("b", F.struct("b.score", "b.above")).alias("b"))
    return _as(won.select("symbol", F.when(F.col("b.above"), "short").otherwise("long").alias("direction"), "b.entry", "b.lo", "b.hi"), "forward_zone")


def forward_deep(bars: DataFrame, now: DataFrame, n: int = 150) -> DataFrame:
    """The best cluster of pivot lows below the price: lows that follow one another within CHAIN, by touches x (1 + distance / 10)."""
    lows = G.pivots(G.newest(bars, n)).where("kind = 'low'").select("symbol", "price")
    line = W.partitionBy("symbol").orderBy("price")
    apart = F.coalesce(F.col("price") > F.lag("price").over(line) * (1 + CHAIN), F.lit(False)).cast("int")
    chained = lows.withColumn("__apart", apart).withColumn("__chain", F.sum("__apart").over(line.rowsBetween(W.unboundedPreceding, 0)))
    sets = chained.groupBy("symbol", "__chain").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("touches"))
    dist = (F.col("price") - F.col("hi")) / F.col("price") * 100
    met = sets.join(now, "symbol").withColumn("dist", dist).where(F.col("dist").between(*DEEP)).withColumn("score", F.col("touches") * (1 + F.col("dist") / 10))
    best = met.groupBy("symbol").agg(F.max_by(F.struct("lo", "hi"), F.struct("score", "hi")).alias("b"))
    return _as(best.select("symbol", F.lit("long").alias("direction"), F.col("b.hi").alias("entry"), "b.lo", "b.hi"), "forward_deep")


def trend_flip(bars: DataFrame, now: DataFrame, n: int = 150, bodies: int = 2) -> DataFrame:
    """The price tests the wick zone of a confirmed flip; true flips before early ones, long before short."""
    met = G.flips(bars, n).where(F.col("bodies") >= bodies).join(now, "symbol").where(F.col("price").between(F.col("zone_lo") * (1 - F.col("delta")), F.col("zone_hi") * (1 + F.col("delta"))))
    order = F.struct(F.col("side") == "long", F.col("kind") == "true")
    best = met.groupBy("symbol").agg(F.max_by(F.struct("side", "zone_lo", "zone_hi"), order).alias("b"))
    return _as(best.select("symbol", F.col("b.side").alias("direction"), F.when(F.col("b.side") == "long", F.col("b.zone_lo")).otherwise(F.col("b.zone_hi")).alias("entry"), F.col("b.zone_lo").alias("lo"), F.col("b.zone_hi").alias("hi")), "trend_flip")


def trap_flip(zones: DataFrame, now: DataFrame, bars: DataFrame) -> DataFrame:
    """A zone's edge is broken by bodies and the price is at it again: with the break."""
    edges = zones.select("symbol", "lo", "hi", F.explode(F.array(F.struct(F.col("hi").alias("level"), F.lit("short").alias("side")), F.struct(F.col("lo").alias("level"), F.lit("long").alias("side")))).alias("e")).select("symbol", "lo", "hi", "e.*")
    broken = G.touches(edges, bars).where("touch = 'proboy'").join(now, "symbol").where(F.abs(F.col("price") / F.col("level") - 1) <= F.col("delta"))
    return _as(broken.select("symbol", F.when(F.col("side") == "short", "long").otherwise("short").alias("direction"), F.col("level").alias("entry"), "lo", "hi"), "trap_flip")


def stop_volume(volumes: DataFrame, now: DataFrame, bias: DataFrame) -> DataFrame:
    """Inside a stop volume's range with the bias, in its trend-side third at the price; outside it, back to the near edge."""
    met = volumes.select("symbol", "lo", "hi").join(now, "symbol").join(bias, "symbol", "left").where("hi > lo")
    at = (F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    inside = ((F.col("bias") == "long") & at.between(0, THIRD)) | ((F.col("bias") == "short") & at.between(1 - THIRD, 1))
    a = _as(met.where(inside).withColumns({"direction": F.col("bias"), "entry": F.col("price")}), "stop_volume_in")
    up = F.col("price") > F.col("hi")
    b = _as(met.where("price > hi OR price < lo").withColumns({"direction": F.when(up, "long").otherwise("short"), "entry": F.when(up, F.col("hi")).otherwise(F.col("lo"))}), "stop_volume_out")
    return a.unionAll(b)


def pennant(narrowed: DataFrame, bars: DataFrame, now: DataFrame, bias: DataFrame, n: int = PENNANT_BARS) -> DataFrame:
    """A narrowing that is no wedge, with PENNANT_TOUCHES pivots, and the price at the last pivot of the bias's side: with the bias.

    narrowed: symbol, narrow, wedge.
    """
    recent = G.newest(bars, n)
    box = recent.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    last = lambda kind: F.max_by("price", F.when(F.col("kind") == kind, F.col("i")))
    p = G.pivots(recent).groupBy("symbol").agg(F.count("*").alias("touches"), last("low").alias("last_low"), last("high").alias("last_high"))
    met = narrowed.where("narrow AND NOT wedge").select("symbol").join(p.where(F.col("touches") >= PENNANT_TOUCHES), "symbol").join(box, "symbol").join(now, "symbol").join(bias, "symbol")
    edge = F.when(F.col("bias") == "long", F.col("last_low")).when(F.col("bias") == "short", F.col("last_high"))
    at = met.withColumn("__edge", edge).where(F.col("price").between(F.col("__edge") * (1 - F.col("delta")), F.col("__edge") * (1 + F.col("delta"))))
    return _as(at.withColumns({"direction": F.col("bias"), "entry": F.col("price")}), "pennant")
