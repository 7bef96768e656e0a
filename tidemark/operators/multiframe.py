"""Several timeframes seen from one: as-of over closed bars, votes of the seniors, and the two scenarios.

A bar is known when it has closed. Bars of all frames are laid on one line of
closing times per symbol, and each fine bar takes the last snapshot of every
frame at or before its own close: one window for any number of frames, as rolling
columns have it, and nothing from the future.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import weighted_available
from tidemark.operators.recursive import ema_series, smoothed, wilder_series
from tidemark.operators.windows import lag, true_range

#: Weights of the senior frames, the net weight from which they agree, lead of the dominant scenario (in thousandths).
WEIGHTS = {"1w": 0.45, "1d": 0.35, "4h": 0.20}
AGREE, LEAD = 0.30, 150


def snapshots(bars: DataFrame) -> DataFrame:
    """symbol, ts, close, ema20, ema50, rsi14, adx14, atr14, trend (bull, bear, neutral), warm (both averages are there) of each bar."""
    step, up, down = F.col("close") - lag("close"), F.col("high") - lag("high"), lag("low") - F.col("low")
    given = bars.select("symbol", "ts", "high", "low", "close").withColumns({
        "__tr": true_range(), "__up": F.greatest(step, step * 0), "__down": F.greatest(-step, step * 0),
        "__r": F.when(up.isNotNull(), true_range()),
        "__p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "__m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })
    out = smoothed(given, {"ema20": ema_series("close", 20), "ema50": ema_series("close", 50), "atr14": wilder_series("__tr", 14)})
    out = smoothed(out, {"__u": wilder_series("__up", 14), "__d": wilder_series("__down", 14), "__t": wilder_series("__r", 14), "__pu": wilder_series("__p", 14), "__md": wilder_series("__m", 14)})
    both, p, m = F.col("__u") + F.col("__d"), 100 * F.try_divide("__pu", "__t"), 100 * F.try_divide("__md", "__t")
    dx = F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).when(F.col("__t").isNotNull(), 0.0)
    out = smoothed(out.withColumn("__dx", dx), {"adx14": wilder_series("__dx", 14)})
    close, fast, slow = F.col("close"), F.col("ema20"), F.col("ema50")
    trend = F.when((close > fast) & (fast > slow), "bull").when((close < fast) & (fast < slow), "bear").otherwise("neutral")
    return out.select("symbol", "ts", "close", "ema20", "ema50", F.when(both > 0, 100 * F.col("__u") / both).alias("rsi14"), "adx14", "atr14", trend.alias("trend"), (fast.isNotNull() & slow.isNotNull()).alias("warm"))


def seen_closed(fine: DataFrame, fine_s: int, frames: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """fine (symbol, ts, ...) with a struct column per frame: its last row that has closed when the fine bar closes, NULL if none.

    frames: by name, rows (symbol, ts, ...) and their width in seconds. Of rows with the same symbol and ts one is taken.
    """
    at = lambda width: F.unix_micros("ts") + width * 1_000_000
    kinds = {f: df.select(F.struct(*[c for c in df.columns if c != "symbol"]).alias("x")).schema["x"].dataType for f, (df, _) in frames.items()}
    empty = {f: F.lit(None).cast(kind) for f, kind in kinds.items()}
    parts = [fine.select("symbol", at(fine_s).alias("__at"), F.lit(1).alias("__fine"), F.struct(*fine.columns).alias("__row"), *[x.alias(f) for f, x in empty.items()])]
    for f, (df, width) in frames.items():
        own = F.struct(*[c for c in df.columns if c != "symbol"])
        parts.append(df.select("symbol", at(width).alias("__at"), F.lit(0).alias("__fine"), F.lit(None).cast(parts[0].schema["__row"].dataType).alias("__row"), *[(own if g == f else x).alias(g) for g, x in empty.items()]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    so_far = W.partitionBy("symbol").orderBy("__at", "__fine").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.where("symbol IS NOT NULL AND __at IS NOT NULL").select("__fine", "__row", *[F.last(f, ignorenulls=True).over(so_far).alias(f) for f in frames])
    return seen.where("__fine = 1").select("__row.*", *frames)


def senior_bias(seen: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """seen with htf_net (votes by weight over the weight there is), htf_weight, and htf_bias: long, short, neutral, unknown."""
    vote = {f: F.when(F.col(f"{f}.warm"), F.when(F.col(f"{f}.trend") == "bull", 1.0).when(F.col(f"{f}.trend") == "bear", -1.0).otherwise(0.0)) for f in weights}
    net, share = weighted_available([(vote[f], w) for f, w in weights.items()])
    out = seen.withColumns({"htf_net": net, "htf_weight": share * sum(weights.values())})
    bias = F.when(F.col("htf_net").isNull(), "unknown").when(F.col("htf_net") >= AGREE, "long").when(F.col("htf_net") <= -AGREE, "short").otherwise("neutral")
    return out.withColumn("htf_bias", bias)


def confluence(seen: DataFrame, price: str, quick: str, ranges: list[str], weights: dict[str, float] = WEIGHTS, least_stop_pct: float = 0.5) -> DataFrame:
    """The long and the short scenario of each row, and which of them dominates.

    score: 0.6 x share of the senior frames with a trend that go its way, 0.4 x the edge of the quick frame's RSI (50
    where there is none), in thousandths. The range is the first of `ranges` that has one; else a hundredth of the
    price, and atr_assumed says so. The stop lies beyond support or resistance (columns; NULL: two ranges away) and
    never nearer than a range or least_stop_pct of the price.
    """
    p = F.col(price)
    there = [F.col(f"{f}.trend") != "neutral" for f in weights]
    count = lambda conditions: sum((F.coalesce(c.cast("int"), F.lit(0)) for c in conditions), F.lit(0))
    held = F.coalesce(*[F.when(F.col(f"{f}.atr14") > 0, F.col(f"{f}.atr14")) for f in ranges])
    out = seen.withColumns({"htf_total": count(there), "long_count": count([F.col(f"{f}.trend") == "bull" for f in weights]), "short_count": count([F.col(f"{f}.trend") == "bear" for f in weights]), "atr_assumed": held.isNull(), "atr": F.coalesce(held, p * 0.01), "quick_rsi": F.coalesce(F.col(f"{quick}.rsi14"), F.lit(50.0))})
    edge = {"long": (F.col("quick_rsi") - 40) / 30, "short": (60 - F.col("quick_rsi")) / 30}
    for side, way in edge.items():
        part = F.coalesce(F.try_divide(F.col(f"{side}_count").cast("double"), "htf_total"), F.lit(0.0))
        out = out.withColumn(f"{side}_score", F.round(1000 * (part * 0.6 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), way)) * 0.4)).cast("int"))
    room = F.greatest(F.col("atr"), p * least_stop_pct / 100)
    below = F.when((F.col("support") > 0) & (F.col("support") < p), F.col("support")).otherwise(p - 2 * F.col("atr"))
    above = F.when(F.col("resistance") > p, F.col("resistance")).otherwise(p + 2 * F.col("atr"))
    lead = F.col("long_score") - F.col("short_score")
    geometry = {"entry_lo": p - 0.3 * F.col("atr"), "entry_hi": p + 0.3 * F.col("atr"), "long_stop": F.least(below, p - room), "short_stop": F.greatest(above, p + room), "dominant": F.when(lead >= LEAD, "long").when(lead <= -LEAD, "short").otherwise("neutral")}
    return out.withColumns(geometry)


def counter_trend(direction: Column, bias: Column) -> Column:
    """Whether a direction goes against what the senior frames agree on."""
    return bias.isin("long", "short") & (direction != bias)
