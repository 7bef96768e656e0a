"""Time bars: from trades, from finer bars, by row groups; gaps, closed bars, corrections.

Aggregates combine before the shuffle, so a hot symbol costs its bars, not its
trades. Ties of time are broken by trade id. Batch and streaming share `bars`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import instant


def trades_from_events(events: DataFrame) -> DataFrame:
    """events as a tape: one unit at `value`; even ids are taker buys."""
    return events.where("value IS NOT NULL").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), instant(events, "ts").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), (F.col("event_id") % 2 == 0).alias("is_buy")
    )


def trades_from_lineitem(lines: DataFrame) -> DataFrame:
    """lineitem as a tape: unit price and quantity; ids order the lines of a day."""
    return lines.select(
        F.col("l_returnflag").alias("symbol"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        instant(lines, "l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("qty"),
        (F.col("l_linestatus") == "O").alias("is_buy"),
    )


def bars(trades: DataFrame, width: str = "1 hour", key: str = "symbol") -> DataFrame:
    """Open, high, low, close, volume, quote volume, taker buys and count per key and window."""
    order = F.struct("ts", "trade_id")
    return (
        trades.groupBy(key, F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("qty").alias("volume"),
            F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
            F.sum(F.when(F.col("is_buy"), F.col("qty")).otherwise(0.0)).alias("taker_buy"),
            F.count("*").alias("trades"),
        )
        .select(key, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "taker_buy", "trades")
    )


def coarser(fine: DataFrame, width: str) -> DataFrame:
    """Bars of a wider window from finer bars."""
    return (
        fine.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "taker_buy", "trades")],
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "taker_buy", "trades")
    )


def row_groups(fine: DataFrame, size: int = 4) -> DataFrame:
    """Groups of `size` consecutive bars by count, not by clock; an incomplete last group is left out."""
    n = F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1
    return (
        fine.withColumn("g", F.floor(n / size))
        .groupBy("symbol", "g")
        .agg(
            F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"), F.count("*").alias("n"),
        )
        .where(F.col("n") == size)
        .drop("n", "g")
    )


def closed(all_bars: DataFrame, now: Column, width_s: int) -> DataFrame:
    """Bars whose window has ended at `now`, which is always given, never the clock."""
    return all_bars.where(F.unix_seconds("ts") + width_s <= F.unix_seconds(now))


def gaps(all_bars: DataFrame, width_s: int, slack: float = 1.5) -> DataFrame:
    """Where the next bar opens more than slack widths later: bounds and how many bars are missing."""
    before = F.lag("ts").over(W.partitionBy("symbol").orderBy("ts"))
    apart = F.unix_seconds("ts") - F.unix_seconds("after")
    return all_bars.withColumn("after", before).where(apart > slack * width_s).select("symbol", "after", F.col("ts").alias("until"), (F.floor(apart / width_s) - 1).cast("long").alias("missing"))


def missing_bars(found: DataFrame, width_s: int) -> DataFrame:
    """One row for each missing bar of gaps()."""
    steps = F.sequence(F.unix_seconds("after") + width_s, F.unix_seconds("until") - width_s, F.lit(width_s).cast("long"))
    return found.select("symbol", F.explode(steps).alias("s")).select("symbol", F.timestamp_seconds("s").alias("ts"))


def corrected(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Union in which rows of `new` replace those of `old` with the same keys."""
    both = old.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__rank")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__rank").alias("v")).select(*keys, "v.*")


def staleness(all_bars: DataFrame, now: Column, width_s: int, most: float = 2.0) -> DataFrame:
    """Per symbol, seconds since its last bar ended, and whether that is more than `most` widths."""
    age = F.unix_seconds(now) - (F.unix_seconds(F.max("ts")) + width_s)
    return all_bars.groupBy("symbol").agg(age.alias("age_s")).withColumn("stale", F.col("age_s") > most * width_s)


def bar_faults(bars: DataFrame, width_s: int) -> DataFrame:
    """Per symbol the bars of a table and what is wrong with them: repeats, off the grid, gaps, high below low, prices outside high and low, prices not above 0, negative volume, nulls."""
    t = F.unix_seconds("ts")
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))  # noqa: E741
    wrong = {
        "off_grid": t % width_s != 0, "high_below_low": h < l, "outside": (F.greatest(o, c) > h) | (F.least(o, c) < l), "not_positive": F.least(o, h, l, c) <= 0, "negative_volume": v < 0,
        "nulls": o.isNull() | h.isNull() | l.isNull() | c.isNull() | v.isNull(),
    }
    # One row per time first, so that the gaps are between times and repeats are counted once.
    timed = bars.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).groupBy("symbol", t.alias("t")).agg(F.count("*").alias("n"), *[F.count_if(x).alias(k) for k, x in wrong.items()])
    step = F.col("t") - F.lag("t").over(W.partitionBy("symbol").orderBy("t"))
    stepped = timed.withColumn("wide", F.coalesce(step > width_s * 1.5, F.lit(False)))
    return stepped.groupBy("symbol").agg(F.sum("n").alias("bars"), F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if("wide").alias("gaps"), *[F.sum(k).alias(k) for k in wrong])


def frame_skew(frames: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """symbol, small, large, late_s: frames (by name: bars, width in seconds) whose history begins more than two bars of a larger frame after that frame's own."""
    starts = None
    for name, (df, width) in frames.items():
        one = df.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min(F.unix_seconds("ts")).alias("first_s")).select("symbol", F.struct(F.lit(width).alias("width"), F.lit(name).alias("name"), "first_s").alias("f"))
        starts = one if starts is None else starts.unionAll(one)
    # A handful of frames a symbol.
    each = starts.groupBy("symbol").agg(F.collect_list("f").alias("all")).select("symbol", "all", F.explode("all").alias("large"))
    pairs = each.select("symbol", "large", F.explode("all").alias("small")).where(F.col("small.width") < F.col("large.width"))
    late = F.col("small.first_s") - F.col("large.first_s")
    return pairs.where(late > 2 * F.col("large.width")).select("symbol", F.col("small.name").alias("small"), F.col("large.name").alias("large"), late.alias("late_s"))
