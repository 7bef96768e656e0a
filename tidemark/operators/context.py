"""Context of a symbol: funding, open interest, cadence, microstructure scores, figures, ladders, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio, weighted_available
from tidemark.operators.windows import by_symbol, lag, last_rows, rolling


def funding_stats(records: DataFrame, value: str, least: int = 10, steps: int = 4, share: float = 0.75) -> DataFrame:
    """symbol, z (last value; 0 on a constant series), trend over the last steps, extreme (largest magnitude)."""
    order = W.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = records.withColumns({"__n": F.row_number().over(order), "__d": F.signum(F.col(value) - F.lag(value).over(by_symbol()))})
    near = F.col("__n") <= steps
    out = rows.groupBy("symbol").agg(
        F.count(value).alias("n"), F.max_by(value, "ts").alias("last"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"),
        F.sum((near & (F.col("__d") > 0)).cast("int")).alias("up"), F.sum((near & (F.col("__d") < 0)).cast("int")).alias("down"),
        F.max_by(value, F.abs(value)).alias("extreme"),
    )
    z = F.when(F.col("sigma") <= 1e-12, 0.0).otherwise(ratio(F.col("last") - F.col("mean"), "sigma"))
    trend = F.when(F.col("up") >= share * steps, "rising").when(F.col("down") >= share * steps, "falling").otherwise("mixed")
    return out.select("symbol", F.when(F.col("n") >= least, z).alias("z"), F.when(F.col("n") >= least, trend).alias("trend"), F.abs("extreme").alias("extreme"))


def change_over(value: str, n: int) -> Column:
    """x / x n rows before - 1."""
    return ratio(F.col(value), lag(value, n)) - 1


def cadence(arrivals: DataFrame, key: str, ms: str) -> DataFrame:
    """Between arrivals of a key: median, p90 (the value at index int(0.9 n)), largest, in ms."""
    apart = arrivals.withColumn("d", F.col(ms) - F.lag(ms).over(W.partitionBy(key).orderBy(ms))).where("d IS NOT NULL")
    place = F.row_number().over(W.partitionBy(key).orderBy("d")) - 1
    n = F.count("*").over(W.partitionBy(key))
    ranked = apart.withColumns({"i": place, "p": F.floor(n * 0.9)})
    return ranked.groupBy(key).agg(F.percentile("d", F.lit(0.5)).alias("median_ms"), F.max(F.when(F.col("i") == F.least("p", F.lit(10**9)), F.col("d"))).alias("p90_ms"), F.max("d").alias("max_ms"), F.count("*").alias("n"))


def classic_pivots(bars: DataFrame, n: int = 48) -> DataFrame:
    """Per symbol, pivot, two resistances and two supports from its last n bars."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    s = bars.withColumn("__n", place).where(F.col("__n") <= n).groupBy("symbol").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"))
    p = (F.col("h") + F.col("l") + F.col("c")) / 3
    return s.select("symbol", p.alias("pivot"), (2 * p - F.col("l")).alias("r1"), (2 * p - F.col("h")).alias("s1"), (p + F.col("h") - F.col("l")).alias("r2"), (p - F.col("h") + F.col("l")).alias("s2"))


# Weights of the microstructure scores.
SCORES = {"funding": 0.18, "long_short": 0.15, "taker": 0.18, "open_interest": 0.16, "book": 0.12, "spread": 0.06, "basis": 0.07, "liquidations": 0.08}


def microstructure_scores() -> dict[str, Column]:
    """Each plane's score for the direction of a snapshot; NULL where it isn't measured.

    Input columns: direction (long, short or none), funding, long_short, taker, oi_change, price_change, bid_qty,
    ask_qty, depth_imbalance, bid, ask, basis_pct, liquidation_score, liq_long, liq_short.
    """
    # Bands and scores.
    d = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1).otherwise(0)
    up = d > 0
    side = lambda a, b: F.when(up, a).otherwise(b)
    f, ls, tk, oi, dp = (F.col(c) for c in ("funding", "long_short", "taker", "oi_change", "price_change"))
    crowd = F.when(F.abs(f) < 0.0002, F.lit(0.05)).when(f > 0, side(-0.25, 0.25)).otherwise(side(0.25, -0.25))
    fresh, along = oi > 0, ((dp > 0) & up) | (~(dp > 0) & (d < 0))
    quadrant = F.when(fresh & along, 0.35).when(fresh, -0.25).when(along, 0.15).otherwise(-0.10)
    both = F.col("bid_qty") + F.col("ask_qty")
    lean = F.when(both > 0, (F.col("bid_qty") - F.col("ask_qty")) / both).otherwise(clip("depth_imbalance", -1, 1))
    spread = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10_000)
    basis = F.col("basis_pct")
    longs, shorts = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in ("liq_long", "liq_short"))
    swept = F.coalesce(F.col("liquidation_score"), F.when(longs + shorts > 0, (shorts - longs) / (longs + shorts)))
    return {
        "funding": F.when(f.isNotNull(), F.when(F.abs(f) >= 0.001, crowd * 2).otherwise(crowd)),
        "long_short": F.when(ls > 0, F.when(ls >= 2, side(-0.40, 0.25)).when(ls >= 1.6, side(-0.25, 0.18)).when(ls <= 0.5, side(0.25, -0.40)).when(ls <= 0.65, side(0.18, -0.25)).otherwise(0.0)),
        "taker": F.when(tk > 0, F.when(tk >= 1.25, side(0.45, -0.35)).when(tk <= 0.8, side(-0.35, 0.45)).otherwise(0.0)),
        "open_interest": F.when(oi.isNotNull(), F.when(F.abs(oi) < 0.15, 0.0).when(dp.isNull() | (d == 0), F.when(fresh, 0.10).otherwise(-0.05)).otherwise(quadrant)),
        "book": lean * d,
        "spread": F.when(spread.isNotNull(), F.when(spread <= 2, 0.15).when(spread <= 8, 0.0).otherwise(-0.35)),
        "basis": F.when(basis.isNotNull(), F.when(basis > 0.08, side(0.18, -0.12)).when(basis < -0.04, side(-0.12, 0.18)).otherwise(0.0)),
        "liquidations": clip(swept * d, -1, 1),
    }


def microstructure(snapshots: DataFrame) -> DataFrame:
    """Adds score (the weighted mean of the measured scores), confidence (their share of all weights), label and warnings."""
    parts = microstructure_scores()
    score, confidence = weighted_available([(parts[k], w) for k, w in SCORES.items()])
    score, confidence = F.coalesce(clip(score, -1, 1), F.lit(0.0)), F.coalesce(confidence, F.lit(0.0))
    label = F.when(score >= 0.35, "supportive").when(score <= -0.35, "against").otherwise("mixed")
    said = [F.when(F.abs("funding") >= 0.001, "extreme_funding"), F.when((F.col("long_short") >= 2) | (F.col("long_short") <= 0.5), "crowded_long_short_ratio"), F.when(parts["spread"] == -0.35, "wide_spread")]
    return snapshots.withColumns({"score": score, "confidence": confidence, "label": label, "warnings": F.array_compact(F.array(*said))})


def summarised(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("confidence").alias("confidence"), F.sum(F.size("warnings")).alias("warnings"))


def universe_health(rows: DataFrame, reason: Column, warn: float = 0.5, critical: float = 0.9) -> DataFrame:
    """Share of failing rows, the commonest reason (the first by name of equals), state."""
    counts = rows.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"))
    bad = F.col("reason").isNotNull()
    out = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("failing"), F.max_by(F.when(bad, F.col("reason")), F.when(bad, F.struct("n", "reason"))).alias("dominant"))
    share = ratio("failing", "total")
    return out.withColumn("share", share).withColumn("state", F.when(share >= critical, "critical").when(share >= warn, "degraded").otherwise("healthy"))


def readiness(bars_by_tf: DataFrame, minimums: dict[str, int]) -> DataFrame:
    """symbol, tf, n, ready: whether each timeframe has its least number of bars."""
    need = F.lit(0)
    for tf, n in minimums.items():
        need = F.when(F.col("tf") == tf, n).otherwise(need)
    return bars_by_tf.groupBy("symbol", "tf").agg(F.count("*").alias("n")).withColumn("ready", F.col("n") >= need)


def narrowing(bars: DataFrame, n: int = 40, most: float = 0.7) -> DataFrame:
    """symbol, range_ratio, drift, narrow, wedge: the later half of the last n bars against the earlier."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    half = F.col("__n") <= n // 2
    side = lambda agg, c, late: agg(F.when(half if late else ~half, F.col(c)))
    s = bars.withColumn("__n", place).where(F.col("__n") <= n).groupBy("symbol").agg(
        F.count("*").alias("n"), side(F.max, "high", True).alias("h2"), side(F.min, "low", True).alias("l2"), side(F.max, "high", False).alias("h1"), side(F.min, "low", False).alias("l1")
    )
    shrink = ratio(F.col("h2") - F.col("l2"), F.col("h1") - F.col("l1"))
    drift = ratio((F.col("h2") + F.col("l2")) - (F.col("h1") + F.col("l1")), F.col("h1") + F.col("l1"))
    return s.where(F.col("n") == n).select("symbol", shrink.alias("range_ratio"), drift.alias("drift"), (shrink <= most).alias("narrow"), ((shrink <= most) & (F.abs(drift) >= 0.05)).alias("wedge"))


def pivot_divergence(swings: DataFrame, indicator: str) -> DataFrame:
    """Neighbouring pivots whose prices and indicator move apart: regular and hidden, both kinds."""
    w = W.partitionBy("symbol").orderBy("ts")
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    high = swings.where(F.col("ph") & F.col(indicator).isNotNull()).select("symbol", "ts", step("high").alias("p"), step(indicator).alias("i"), F.lit("bear").alias("side"))
    low = swings.where(F.col("pl") & F.col(indicator).isNotNull()).select("symbol", "ts", step("low").alias("p"), step(indicator).alias("i"), F.lit("bull").alias("side"))
    apart = high.unionAll(low).where("p * i < 0")
    regular = ((F.col("side") == "bear") & (F.col("p") > 0)) | ((F.col("side") == "bull") & (F.col("p") < 0))
    return apart.select("symbol", "ts", "side", F.when(regular, "regular").otherwise("hidden").alias("kind"))


def ladders(levels: DataFrame, start: DataFrame, gap: float, most: int) -> DataFrame:
    """symbol, step, price: from each symbol's start, up to `most` prices that are each at least `gap` (a share) over the last taken.

    Each step takes the least price beyond the last one; levels: symbol, price; start: symbol, entry.
    """
    now, out = start.select("symbol", F.col("entry").alias("last")), None
    distinct = levels.select("symbol", "price").distinct()
    for step in range(1, most + 1):
        now = distinct.join(now, "symbol").where(F.col("price") >= F.col("last") * (1 + gap)).groupBy("symbol").agg(F.min("price").alias("last"))
        taken = now.select("symbol", F.lit(step).alias("step"), F.col("last").alias("price"))
        out = taken if out is None else out.unionAll(taken)
    return out


def rungs(levels: DataFrame, n: int = 2) -> DataFrame:
    """Per (symbol, side): the n nearest and the n strongest levels. levels: symbol, side, price, distance, strength."""
    near = F.row_number().over(W.partitionBy("symbol", "side").orderBy("distance", "price"))
    strong = F.row_number().over(W.partitionBy("symbol", "side").orderBy(F.desc("strength"), "price"))
    return levels.withColumns({"near": near, "strong": strong}).where((F.col("near") <= n) | (F.col("strong") <= n))


def setup_id(kind: Column, level: Column, direction: Column) -> Column:
    """A stable id: kind, direction and the level's one-percent log bucket."""
    bucket = F.floor(F.log(level) / F.log(F.lit(1.01))).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", kind, direction, bucket), 256), 1, 16)


def votes(trends: DataFrame, frames: Sequence[str], senior: Sequence[str]) -> DataFrame:
    """symbol, one column per timeframe, bias: the seniors must agree, and at least 0.3 of all frames with them."""
    wide = trends.groupBy("symbol").pivot("tf", list(frames)).agg(F.first("trend"))
    first, second = (F.coalesce(F.col(c), F.lit("neutral")) for c in senior)
    agree = sum(F.coalesce((F.col(c) == first).cast("int"), F.lit(0)) for c in frames) / len(frames)
    bias = F.when((first != second) | (first == "neutral") | (agree < 0.3), "neutral").otherwise(first)
    return wide.withColumn("bias", bias)


def calibration(summaries: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Per symbol: count of each action, average strength, and the strength at index int(0.25 n) of those acted on."""
    n = F.row_number().over(W.partitionBy("symbol").orderBy("strength")) - 1
    total = F.count("*").over(W.partitionBy("symbol"))
    ranked = summaries.withColumns({"i": n, "t": total})
    return ranked.groupBy("symbol").agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions], F.avg("strength").alias("strength"), F.max(F.when(F.col("i") == F.floor(F.col("t") * 0.25), F.col("strength"))).alias("gate"))


def flow_divergence(trades: DataFrame, least: float = 0.1) -> DataFrame:
    """symbol, divergence: price and taker delta of a window pointing different ways by at least a share of volume."""
    order = F.struct("ts", "trade_id")
    money = F.col("price") * F.col("qty")
    s = trades.groupBy("symbol").agg(F.min_by("price", order).alias("p0"), F.max_by("price", order).alias("p1"), F.sum(F.when(F.col("is_buy"), money).otherwise(-money)).alias("delta"), F.sum(money).alias("volume"))
    share = ratio("delta", "volume")
    return s.withColumn("share", share).withColumn("divergence", F.when((F.col("p1") > F.col("p0")) & (share <= -least), "bearish").when((F.col("p1") < F.col("p0")) & (share >= least), "bullish")).select("symbol", "share", "divergence")


def overlapping(zones: DataFrame, width: float = 0.02) -> DataFrame:
    """Zones of one symbol on different horizons that overlap: kept is the one of more volume (the smaller id of equals).

    Zones meet in the log-price buckets that they reach into, so a symbol's zones are compared only near one another.
    """
    bucket = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1e-300))) / F.lit(width))
    spread = zones.withColumn("__bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    a, b = spread.alias("a"), spread.select("symbol", "horizon", "lo", "hi", "volume", "zone_id", "__bucket").alias("b")
    clash = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.__bucket") == F.col("b.__bucket")) & (F.col("a.horizon") != F.col("b.horizon")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    weaker = (F.col("a.volume") < F.col("b.volume")) | ((F.col("a.volume") == F.col("b.volume")) & (F.col("a.zone_id") > F.col("b.zone_id")))
    beaten = a.join(b, clash & weaker, "left_semi").select("a.symbol", "a.horizon", "a.zone_id").distinct()
    return zones.join(beaten, ["symbol", "horizon", "zone_id"], "left_anti")


def extended_columns() -> dict[str, Column]:
    """Momentum, detrended price, bias, share of rises, ease of movement."""
    c, mean20 = F.col("close"), rolling(F.avg, "close", 20)
    mid = (F.col("high") + F.col("low")) / 2
    before = (lag("high") + lag("low")) / 2
    ease = ratio((mid - before) * (F.col("high") - F.col("low")), F.col("volume"))
    rise = (c > lag("close")).cast("int")
    return {"mom10": c - lag("close", 10), "rocp10": ratio(c - lag("close", 10), lag("close", 10)), "dpo20": lag("close", 11) - mean20, "bias6": 100 * ratio(c - rolling(F.avg, "close", 6), rolling(F.avg, "close", 6)), "emv": ease, "rise": rise}


def with_extended(bars: DataFrame) -> DataFrame:
    out = bars.withColumns(extended_columns())
    w = last_rows(12)
    return out.withColumns({"psy12": F.when(F.count("rise").over(w) == 12, 100 * F.avg("rise").over(w)), "emv14": rolling(F.avg, "emv", 14)}).drop("rise", "emv")
