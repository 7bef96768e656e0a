"""Lines of a zone: the prices inside it that its own bars touch most.

Touches and volume are counted by differences: a bar says where it begins and
where it ends to count, and a running sum over the zone's buckets does the rest,
so no bar is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZONE = ["symbol", "lo", "hi"]
#: Per cent between lines, lines at most, per cent of a line's band, of a bucket, buckets at most, bars of a structure at least.
APART_PCT, MOST, BAND_PCT, BUCKET_PCT, BUCKETS, LEAST_BARS = 0.25, 4, 0.08, 0.02, 120, 5


def structure_bars(zones: DataFrame, bars: DataFrame, gap: int = 2) -> DataFrame:
    """ZONE, high, low, volume: of the runs of bars that reach into a zone (`gap` others between), the bars of the one that traded most.

    Runs of fewer than LEAST_BARS from end to end don't count. Zones are few per symbol, and its bars meet each of them.
    """
    line = W.partitionBy("symbol").orderBy("ts")
    numbered = bars.withColumn("rn", F.row_number().over(line)).withColumn("so_far", F.sum("volume").over(line.rowsBetween(W.unboundedPreceding, 0)))
    numbered = numbered.select("symbol", "rn", "so_far", "high", "low", "volume")
    each = zones.where("lo > 0 AND lo < hi").select(*ZONE).distinct()
    near = W.partitionBy(*ZONE).orderBy("rn")
    inside = numbered.join(each, "symbol").where("low <= hi AND high >= lo").select(*ZONE, "rn", "so_far", "volume")
    far = F.coalesce(F.col("rn") - F.lag("rn").over(near) > gap + 1, F.lit(False)).cast("int")
    marked = inside.withColumn("far", far).withColumn("run", F.sum("far").over(near.rowsBetween(W.unboundedPreceding, 0)))
    # Volume from the first to the last bar of the run, those between that stay outside too.
    runs = marked.groupBy(*ZONE, "run").agg(F.min("rn").alias("first"), F.max("rn").alias("last"), (F.max("so_far") - F.min_by(F.col("so_far") - F.col("volume"), "rn")).alias("traded"))
    best = runs.where(F.col("last") - F.col("first") + 1 >= LEAST_BARS).groupBy(*ZONE).agg(F.max_by(F.struct("first", "last"), F.struct(F.round("traded", 6), F.col("last") - F.col("first"), -F.col("first"))).alias("r")).select(*ZONE, "r.*")
    return numbered.join(best, "symbol").where("rn BETWEEN first AND last").select(*ZONE, "high", "low", "volume")


def density(inside: DataFrame) -> DataFrame:
    """ZONE, step, n (buckets), bucket, touches, volume of every bucket. inside: ZONE, high, low, volume; a bar's volume lies evenly on its range."""
    n = F.greatest(F.lit(4), F.least(F.lit(BUCKETS), ((F.col("hi") / F.col("lo") - 1) * 100 / BUCKET_PCT).cast("int")))
    met = inside.where("high >= lo AND low <= hi").withColumn("n", n).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("n"))
    place = lambda price: F.least(F.col("n") - 1, F.floor((price - F.col("lo")) / F.col("step")).cast("int"))
    met = met.withColumns({"a": place(F.greatest("low", "lo")), "b": place(F.least("high", "hi"))})
    edge = lambda i: F.col("lo") + i * F.col("step")
    per = F.try_divide("volume", F.col("high") - F.col("low"))
    part = lambda i: F.greatest(F.least("high", edge(i + 1)) - F.greatest("low", edge(i)), F.lit(0.0)) * per
    flat = F.col("high") <= F.col("low")
    row = lambda bucket, touch, even, own: F.struct(bucket.alias("bucket"), touch.alias("dt"), even.alias("dv"), own.alias("own"))
    zero, one, none = F.lit(0), F.lit(1), F.lit(0.0)
    a, b, whole = F.col("a"), F.col("b"), per * F.col("step")
    ends = [row(a, one, none, F.when(flat, F.col("volume")).otherwise(part(a))), row(b + 1, -one, none, none)]
    between = [row(b, zero, none, part(b)), row(a + 1, zero, whole, none), row(b, zero, -whole, none)]
    changes = met.select(*ZONE, "n", "step", F.inline(F.when((b > a) & ~flat, F.array(*ends, *between)).when(b > a, F.array(*ends, row(b, zero, none, none))).otherwise(F.array(*ends))))
    sums = changes.groupBy(*ZONE, "n", "step", "bucket").agg(F.sum("dt").alias("dt"), F.sum("dv").alias("dv"), F.sum("own").alias("own"))
    every = sums.select(*ZONE, "n", "step").distinct().select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"))
    line = W.partitionBy(*ZONE).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    filled = every.join(sums, [*ZONE, "n", "step", "bucket"], "left").fillna(0, ["dt", "dv", "own"])
    return filled.select(*ZONE, "n", "step", "bucket", F.sum("dt").over(line).alias("touches"), F.round(F.sum("dv").over(line) + F.col("own"), 6).alias("volume"))


def _apart(taken: Column, price: Column) -> Column:
    return F.forall(taken, lambda q: F.abs(price / q - 1) * 100 > APART_PCT)


def peaks(dense: DataFrame) -> DataFrame:
    """ZONE, price: up to MOST peaks of touches, the strongest first, each apart from those taken; then the zone's edges while there is room."""
    line = W.partitionBy(*ZONE).orderBy("bucket")
    beside = lambda f: F.coalesce(f("touches").over(line), F.lit(-1))
    high = (F.col("touches") > 0) & (F.col("touches") >= beside(F.lag)) & (F.col("touches") >= beside(F.lead))
    found = dense.withColumn("peak", high).where("peak").withColumn("price", F.col("lo") + (F.col("bucket") + 0.5) * F.col("step"))
    # At most BUCKETS of a zone.
    ranked = found.groupBy(*ZONE).agg(F.sort_array(F.collect_list(F.struct((-F.col("touches")).alias("t"), (-F.col("volume")).alias("v"), "price"))).alias("r"))
    offered = F.concat(F.transform("r", lambda x: x["price"]), F.array("lo", "hi"))
    take = lambda taken, p: F.when((F.size(taken) < MOST) & _apart(taken, p), F.array_append(taken, p)).otherwise(taken)
    return ranked.select(*ZONE, F.explode(F.aggregate(offered, F.array().cast("array<double>"), take)).alias("price"))


def zone_lines(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """ZONE, price, touches, volume, key: the lines of each zone, counted again on its bars; none where there are fewer than two.

    zones: ZONE; bars: symbol, ts, high, low, volume. Of lines with the same touches x volume the lower is the key.
    """
    inside = structure_bars(zones, bars)
    lines = peaks(density(inside))
    band = (F.col("low") <= F.col("price") * (1 + BAND_PCT / 100)) & (F.col("high") >= F.col("price") * (1 - BAND_PCT / 100))
    counted = lines.join(inside, ZONE).groupBy(*ZONE, "price").agg(F.count_if(band).alias("touches"), F.sum(F.when(band, F.col("volume")).otherwise(0.0)).alias("volume"))
    whole = W.partitionBy(*ZONE)
    weight = F.round(F.col("touches") * F.col("volume"), 6)
    best = F.max(F.struct(weight.alias("w"), (-F.col("price")).alias("p"))).over(whole)
    several = counted.withColumns({"lines": F.count("*").over(whole), "best": best}).where("lines >= 2")
    return several.select(*ZONE, "price", "touches", "volume", ((F.col("touches") > 0) & (F.col("best.p") == -F.col("price"))).alias("key"))


def trendline_breaks(bars: DataFrame, indicator: str, left: int = 5, lookback: int = 50) -> DataFrame:
    """bars with bear_break and bull_break: the indicator crosses the line through its values at the last two pivots of the price.

    A pivot (beyond `left` bars before and the one after) is used from the second bar after it on, and while both are
    at most `lookback` bars old. Down through the line of highs is bearish, up through that of lows bullish.
    """
    line = W.partitionBy("symbol").orderBy("ts")
    before, after = line.rowsBetween(-left, -1), line.rowsBetween(1, 1)
    there = (F.count("high").over(before) == left) & (F.count("high").over(after) == 1)
    beyond = {"bear": (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)), "bull": (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))}
    out = bars.withColumn("__rn", F.row_number().over(line))
    out = out.withColumns({f"__{k}": F.when(there & x, F.struct("__rn", F.col(indicator).alias("v"))) for k, x in beyond.items()})
    out = out.withColumns({f"__{k}_new": F.lag(f"__{k}", 2).over(line) for k in beyond})
    past = line.rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumns({f"__{k}_pair": F.when(F.col(f"__{k}_new").isNotNull(), F.struct(F.last(f"__{k}_new", ignorenulls=True).over(past).alias("a"), F.col(f"__{k}_new").alias("b"))) for k in beyond})
    out = out.withColumns({f"__{k}_pair": F.last(f"__{k}_pair", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0)) for k in beyond})
    now, prev = F.col(indicator), F.lag(indicator).over(line)
    flags = {}
    for k in beyond:
        a, b = F.col(f"__{k}_pair.a"), F.col(f"__{k}_pair.b")
        at = lambda i, a=a, b=b: a["v"] + (b["v"] - a["v"]) * (i - a["__rn"]) / (b["__rn"] - a["__rn"])
        held, here = at(F.col("__rn") - 1), at(F.col("__rn"))
        crossed = (prev >= held) & (now < here) if k == "bear" else (prev <= held) & (now > here)
        flags[f"{k}_break"] = F.coalesce(crossed & (F.col("__rn") - a["__rn"] <= lookback), F.lit(False))
    return out.withColumns(flags).select(*bars.columns, *flags)
