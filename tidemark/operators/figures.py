"""Figures of the newest bars of a symbol: trend flips, head and shoulders, touches of a level, saws.

All work on the last n bars of each symbol, so what meets inside a symbol is bounded by n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bars beside a pivot, pivots of the current leg, pivots searched for a figure.
LEFT, RIGHT, LEG, SCAN = 3, 1, 6, 6
# How far a head stands out, shoulders may differ, a neckline may lean.
PROMINENCE, SHOULDERS, NECKLINE = 0.03, 0.08, 0.05


def newest(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol with i (0, 1, ... in order of time) and end (the last i)."""
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    size = F.count("*").over(W.partitionBy("symbol"))
    return bars.withColumn("__back", back).where(F.col("__back") <= n).withColumn("end", (size - 1).cast("int")).withColumn("i", F.col("end") - F.col("__back") + 1).drop("__back")


def pivots(recent: DataFrame) -> DataFrame:
    """symbol, i, kind (high, low), price, zone_lo, zone_hi (the wick), seq (from 1 in order of i, highs first) of newest bars."""
    w = W.partitionBy("symbol").orderBy("i")
    before, after = w.rowsBetween(-LEFT, -1), w.rowsBetween(1, RIGHT)
    there = (F.count("*").over(before) == LEFT) & (F.count("*").over(after) == RIGHT)
    flagged = recent.withColumns({
        "__high": there & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)),
        "__low": there & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)),
    })
    top = F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"), F.greatest("open", "close").alias("zone_lo"), F.col("high").alias("zone_hi"))
    bottom = F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"), F.col("low").alias("zone_lo"), F.least("open", "close").alias("zone_hi"))
    found = flagged.select("symbol", "i", F.explode(F.array_compact(F.array(F.when(F.col("__high"), top), F.when(F.col("__low"), bottom)))).alias("p")).select("symbol", "i", "p.*")
    return found.withColumn("seq", F.row_number().over(W.partitionBy("symbol").orderBy("i", "kind")))


def bodies_beyond(levels: DataFrame, recent: DataFrame) -> DataFrame:
    """levels (symbol, level, sign, ...) with bodies: how many of the newest bars have their whole body above (sign 1) or below (-1)."""
    held = F.when(F.col("sign") > 0, F.least("open", "close") > F.col("level")).otherwise(F.greatest("open", "close") < F.col("level"))
    keys = [F.col(c) for c in levels.columns]
    met = levels.join(recent.select("symbol", "i", "end", "open", "close"), "symbol")
    return met.groupBy(*keys).agg((F.max("end") - F.coalesce(F.max(F.when(~held, F.col("i"))), F.lit(-1))).alias("bodies"))


def flips(bars: DataFrame, n: int = 150) -> DataFrame:
    """symbol, side (short, long), kind (true, early), level, zone_lo, zone_hi, bodies: levels whose break turns the trend.

    true: the last low before the highest high of the leg (the last LEG pivots). early: the low of the last
    neighbouring high and low, if no later high is above that high. Either counts once the last close is below it.
    long is the mirror; both are worked on as one, with prices negated.
    """
    recent = newest(bars, n)
    last = recent.where(F.col("i") == F.col("end")).select("symbol", F.col("close").alias("__close"))
    sides = F.explode(F.array(F.struct(F.lit("short").alias("side"), F.lit(1).alias("s")), F.struct(F.lit("long").alias("side"), F.lit(-1).alias("s"))))
    p = pivots(recent).withColumn("total", F.max("seq").over(W.partitionBy("symbol"))).withColumn("x", sides).select("*", "x.*").drop("x")
    p = p.withColumns({"up": (F.col("kind") == "high") == (F.col("s") == 1), "value": F.col("price") * F.col("s")})
    whole, line = W.partitionBy("symbol", "side"), W.partitionBy("symbol", "side").orderBy("seq")
    of = F.struct("i", "price", "zone_lo", "zone_hi", "value")
    leg = F.col("up") & (F.col("seq") > F.col("total") - LEG)
    p = p.withColumns({"top": F.max_by("i", F.when(leg, F.struct(F.col("value"), -F.col("seq")))).over(whole), "before_up": F.lag("up").over(line), "before": F.lag("value").over(line)})
    pair = ~F.col("up") & F.col("before_up")
    p = p.withColumn("pair", F.max_by(F.struct("i", "price", "zone_lo", "zone_hi", "value", "before"), F.when(pair, F.col("seq"))).over(whole))
    found = p.groupBy("symbol", "side", "s").agg(
        F.max_by(of, F.when(~F.col("up") & (F.col("i") < F.col("top")), F.col("seq"))).alias("true"),
        F.first("pair").alias("early"),
        F.coalesce(F.bool_or(F.col("up") & (F.col("i") > F.col("pair.i")) & (F.col("value") > F.col("pair.before"))), F.lit(False)).alias("bettered"),
    )
    rows = found.select("symbol", "side", "s", F.explode(F.array(F.struct(F.lit("true").alias("kind"), F.col("true").alias("a")), F.struct(F.lit("early").alias("kind"), F.when(~F.col("bettered"), F.col("early").dropFields("before")).alias("a")))).alias("r"))
    rows = rows.select("symbol", "side", "s", "r.kind", "r.a.*").where("price IS NOT NULL").join(last, "symbol").where(F.col("__close") * F.col("s") < F.col("value"))
    levels = rows.select("symbol", "side", "kind", F.col("price").alias("level"), "zone_lo", "zone_hi", (-F.col("s")).alias("sign"))
    return bodies_beyond(levels, recent).drop("sign")


def head_and_shoulders(bars: DataFrame, n: int = 150, scan: int = SCAN, lean: float = NECKLINE) -> DataFrame:
    """symbol, side, left, head, right: a head beyond both near shoulders, with a level neckline of two pivots or more between.

    short: pivot highs, long: pivot lows. Among the last `scan` pivots of the kind, every triple of neighbours counts.
    """
    p = pivots(newest(bars, n)).select("symbol", "i", "kind", "price")
    line = W.partitionBy("symbol", "kind").orderBy("i")
    ahead = lambda c, k: F.lead(c, k).over(line)
    place, size = F.row_number().over(line), F.count("*").over(W.partitionBy("symbol", "kind"))
    t = p.withColumns({"head": ahead("price", 1), "right": ahead("price", 2), "right_i": ahead("i", 2), "near": place > size - scan}).where("near AND right IS NOT NULL")
    left, head, right = F.col("price"), F.col("head"), F.col("right")
    top = F.greatest(left, right)
    bottom = F.least(left, right)
    # A price of 0 divides nothing: below a positive shoulder it stands out by any share; shoulders of 0 are no shoulders.
    deep = (head == 0) | (F.try_divide(bottom - head, head) >= PROMINENCE)
    stands = F.when(F.col("kind") == "high", (head > top) & (F.try_divide(head - top, top) >= PROMINENCE)).otherwise((head < bottom) & deep)
    t = t.where((left > 0) & (right > 0) & stands & (F.try_divide(F.abs(right - left), left) <= SHOULDERS))
    t = t.select("symbol", "kind", F.col("i").alias("left_i"), F.col("price").alias("left"), "head", "right", "right_i")
    neck = p.where("price > 0").select(F.col("symbol").alias("__s"), F.col("i").alias("__i"), F.col("kind").alias("__k"), F.col("price").alias("__p"))
    met = t.join(neck, (F.col("symbol") == F.col("__s")) & (F.col("kind") != F.col("__k")) & (F.col("__i") > F.col("left_i")) & (F.col("__i") < F.col("right_i")))
    shaped = met.groupBy("symbol", "kind", "left_i", "left", "head", "right").agg(F.count("*").alias("n"), F.max("__p").alias("hi"), F.min("__p").alias("lo"))
    return shaped.where((F.col("n") >= 2) & ((F.col("hi") - F.col("lo")) / F.col("lo") <= lean)).select("symbol", F.when(F.col("kind") == "high", "short").otherwise("long").alias("side"), "left", "head", "right")


def touches(levels: DataFrame, bars: DataFrame, n: int = 60, least_bodies: int = 2, within: int = 2) -> DataFrame:
    """levels (symbol, level, side) with bodies and touch: proboy (bodies beyond), prokol (a wick beyond and back), testing, or NULL.

    side short: resistance, beyond is above; long: support, beyond is below.
    """
    recent = newest(bars, n)
    held = bodies_beyond(levels.withColumn("sign", F.when(F.col("side") == "short", 1).otherwise(-1)), recent)
    near = recent.where(F.col("i") > F.col("end") - within).select("symbol", "high", "low", F.col("close").alias("__close"))
    up = F.col("side") == "short"
    wick = F.when(up, (F.col("high") > F.col("level")) & (F.col("__close") <= F.col("level"))).otherwise((F.col("low") < F.col("level")) & (F.col("__close") >= F.col("level")))
    out = held.join(near, "symbol").groupBy(*held.columns).agg(F.bool_or(wick).alias("wick"))
    kind = F.when(F.col("bodies") >= least_bodies, "proboy").when(F.col("wick"), "prokol").when(F.col("bodies") > 0, "testing")
    return out.withColumn("touch", kind).drop("sign", "wick")


def saws(levels: DataFrame, bars: DataFrame, window: int = 12, least: int = 3) -> DataFrame:
    """levels (symbol, level, ...) with saw: bodies of the last bars cross the level at least so often in each direction."""
    recent = newest(bars, window).select("symbol", "open", F.col("close").alias("__close"))
    up = (F.col("open") < F.col("level")) & (F.col("__close") > F.col("level"))
    down = (F.col("open") > F.col("level")) & (F.col("__close") < F.col("level"))
    met = levels.join(recent, "symbol").groupBy(*levels.columns).agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"))
    return met.withColumn("saw", (F.col("level") > 0) & (F.col("up") >= least) & (F.col("down") >= least)).drop("up", "down")
