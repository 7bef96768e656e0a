"""Closed trades: results, risk units, cohorts, concentration, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.beta import beta_quantile

from tidemark.functions.scalar import ratio
from tidemark.operators.stats import quantiles, trailing_sums, wilson
from tidemark.sources.tables import instant


def trades_from_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Shipped lines as closed trades: opened on the order's date; discount less tax is the move, tax the cost."""
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"), instant(orders, "o_orderdate").alias("opened_at"), F.col("o_orderpriority").alias("phase"))
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    long = F.col("l_linestatus") == "O"
    move = F.col("l_discount") - F.col("l_tax")
    stop_share = 0.01 + F.pmod(F.col("l_quantity").cast("int"), F.lit(5)) / 100
    joined = lines.withColumn("closed_at", instant(lines, "l_shipdate")).join(o, "l_orderkey").where("closed_at >= opened_at")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        F.col("l_returnflag").alias("symbol"),
        F.when(long, "long").otherwise("short").alias("direction"),
        "customer", "phase", "opened_at", "closed_at",
        entry.alias("entry"),
        (entry * (1 + move)).alias("exit"),
        F.when(long, entry * (1 - stop_share)).otherwise(entry * (1 + stop_share)).alias("stop"),
        (100 * F.col("l_tax") / 10).alias("cost_pct"),
    )


def with_r(trades: DataFrame, least_stop_pct: float = 0.05) -> DataFrame:
    """Adds gross_pct, stop_pct, net_pct and r (net in units of the stop; NULL where the stop is nearer than the least)."""
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    gross = 100 * sign * (ratio("exit", "entry") - 1)
    stop = 100 * F.abs(ratio("stop", "entry") - 1)
    return trades.withColumns({"gross_pct": gross, "stop_pct": stop, "net_pct": gross - F.col("cost_pct"), "r": F.when(stop >= least_stop_pct, (gross - F.col("cost_pct")) / stop)})


def outcome(net_pct: Column, flat: float = 0.15) -> Column:
    return F.when(net_pct.isNull(), "unknown").when(net_pct > flat, "win").when(net_pct < -flat, "loss").otherwise("flat")


def pollution() -> Column:
    """The first reason a record can't count, or NULL."""
    return (
        F.when(F.col("entry").isNull() | (F.col("entry") <= 0), "no_entry")
        .when(F.col("exit").isNull() | (F.col("exit") <= 0), "no_exit")
        .when(F.col("closed_at") < F.col("opened_at"), "time_order")
        .when((F.col("direction") == "long") & (F.col("stop") >= F.col("entry")), "stop_side")
        .when((F.col("direction") == "short") & (F.col("stop") <= F.col("entry")), "stop_side")
    )


def cohorts(trades: DataFrame, *keys: str) -> DataFrame:
    """n, wins, share with its score interval, mean and sum of r, profit factor."""
    decided = trades.withColumn("o", outcome(F.col("net_pct")))
    up, down = F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))
    out = decided.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("o") == "win").alias("wins"), F.count_if(F.col("o").isin("win", "loss")).alias("decided"),
        F.avg("r").alias("mean_r"), F.sum("r").alias("sum_r"), ratio(up, down).alias("profit_factor"),
    )
    low, high = wilson(F.col("wins"), F.col("decided"))
    return out.withColumns({"win_rate": ratio("wins", "decided"), "lo": F.when(F.col("decided") > 0, low), "hi": F.when(F.col("decided") > 0, high)})


def stop_bands(trades: DataFrame, cuts: tuple[float, ...] = (1.5, 2.5, 3.5, 4.5)) -> DataFrame:
    band = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        band = F.when(F.col("stop_pct") < c, i).otherwise(band)
    banded = trades.where("r IS NOT NULL").select(band.alias("band"), "r")
    return banded.groupBy("band").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r")).join(quantiles(banded, "band", "r", {"median_r": 0.5}), "band")


def concentration(trades: DataFrame, k: int = 10) -> DataFrame:
    """Per symbol, the share of gains that the k best trades make."""
    won = trades.where("r > 0").select("symbol", "trade_id", "r")
    # A rank with a limit: each task passes on no more than k rows a symbol.
    best = won.withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("r"), "trade_id"))).where(F.col("n") <= k)
    sums = won.groupBy("symbol").agg(F.sum("r").alias("all_gains"))
    return best.groupBy("symbol").agg(F.sum("r").alias("top")).join(sums, "symbol").withColumn("share", ratio("top", "all_gains"))


def trimmed_mean(trades: DataFrame, key: str, value: str, cut: float = 0.1, slack: float = 0.0) -> DataFrame:
    """Mean of the values between two quantiles, widened by the slack."""
    bounds = quantiles(trades, key, value, {"lo": cut, "hi": 1 - cut})
    return trades.join(bounds, key).where(F.col(value).between(F.col("lo") - slack, F.col("hi") + slack)).groupBy(key).agg(F.avg(value).alias("trimmed"), F.count("*").alias("n"))


def repeat_losers(trades: DataFrame, lookback: int, floor: float) -> DataFrame:
    """Trades opened while the symbol's last `lookback` closed results in that direction sum below the floor.

    Results are summed in whole millionths, so that the sum doesn't depend on its order. Trades of one id closed at
    one time stand in the order of their opening and results, so that the rows before a trade are always the same.
    """
    w = W.partitionBy("symbol", "direction").orderBy("closed_at", "trade_id", "opened_at", "r").rowsBetween(-lookback, -1)
    millionths = F.round(F.col("r") * 1_000_000).cast("long")
    summed = trades.withColumns({"__sum": F.sum(millionths).over(w), "seen": F.count("r").over(w)}).where((F.col("seen") == lookback) & (F.col("__sum") < round(floor * 1_000_000)))
    return summed.withColumn("before", F.col("__sum") / 1_000_000).drop("__sum")


def loss_streak(trades: DataFrame, hours: int, least: int) -> DataFrame:
    """Trades closed with at least `least` losses of the symbol in the hours up to them, their own included."""
    timed = trades.withColumn("__at", F.unix_seconds("closed_at"))
    lost = trailing_sums(timed, ["symbol"], "__at", hours * 3600, (F.col("net_pct") < 0).cast("int")).where(F.col("total") >= least)
    lost = lost.select(F.col("symbol").alias("__symbol"), F.col("__at").alias("__then"), F.col("total").alias("losses"))
    return timed.join(lost, F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("__at") == F.col("__then"))).drop("__at", "__symbol", "__then")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Of equal (symbol, action, entry), the strongest; confidence, then ratio, then order of arrival break ties."""
    w = W.partitionBy("symbol", "action", "entry_lo", "entry_hi").orderBy(F.desc("strength"), F.desc("confidence"), F.desc("rr"), "candidate_id")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def path_extremes(trades: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """trade_id, mfe_pct, mae_pct over the `horizon` bars after each entry bar.

    Bars carry their own running extremes of the next bars, so a trade meets one row.
    """
    ahead = W.partitionBy("symbol").orderBy("ts").rowsBetween(1, horizon)
    wide = bars.select("symbol", "ts", F.max("high").over(ahead).alias("top"), F.min("low").over(ahead).alias("bottom"))
    met = trades.join(wide, ["symbol", "ts"])
    long = F.col("direction") == "long"
    best = F.when(long, F.col("top") / F.col("entry") - 1).otherwise(1 - F.col("bottom") / F.col("entry"))
    worst = F.when(long, F.col("bottom") / F.col("entry") - 1).otherwise(1 - F.col("top") / F.col("entry"))
    return met.select("trade_id", (100 * best).alias("mfe_pct"), (100 * worst).alias("mae_pct"))


def first_passage(trades: DataFrame, bars: DataFrame, horizon: int, grid: list[float]) -> DataFrame:
    """trade_id, target, bars: after how many bars a price `target` percent in favour is first met (NULL: not within)."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(1, horizon)
    wide = bars.select("symbol", "ts", F.collect_list("high").over(w).alias("highs"), F.collect_list("low").over(w).alias("lows"))
    met = trades.join(wide, ["symbol", "ts"]).withColumn("target", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    up = F.transform("highs", lambda x: x >= F.col("entry") * (1 + F.col("target") / 100))
    down = F.transform("lows", lambda x: x <= F.col("entry") * (1 - F.col("target") / 100))
    place = F.array_position(F.when(F.col("direction") == "long", up).otherwise(down), True)
    return met.select("trade_id", "target", F.when(place > 0, place).cast("long").alias("bars"))


def level_backtest(setups: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """setup_id, result (stop, tp, open) and bars to it, over the bars after the setup's; in one bar the stop counts first."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(1, horizon)
    wide = bars.select("symbol", "ts", F.collect_list(F.struct("high", "low")).over(w).alias("path"))
    met = setups.join(wide, ["symbol", "ts"])
    long = F.col("direction") == "long"
    stop = F.transform("path", lambda b: F.when(long, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop")))
    goal = F.transform("path", lambda b: F.when(long, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target")))
    s, g = F.nullif(F.array_position(stop, True), F.lit(0)), F.nullif(F.array_position(goal, True), F.lit(0))
    result = F.when(s.isNotNull() & (g.isNull() | (s <= g)), "stop").when(g.isNotNull(), "tp").otherwise("open")
    return met.select("setup_id", result.alias("result"), F.least(s, g).cast("long").alias("bars"))


#: The prior's successes and failures, and from how many results on a figure is of a tier.
PRIOR = 2.0
TIERS = ((200, "production"), (100, "calibrated"), (50, "conservative"), (30, "early"), (0, "exploratory"))


def win_rates(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """counts (wins, n) with the mean of Beta(2 + wins, 2 + losses), its exact and its normal interval, and the sample's tier.

    No results: NULL figures, lowest tier. Counts are few rows, made by an aggregate.
    """
    a, b = PRIOR + F.col("wins").cast("double"), PRIOR + (F.col("n") - F.col("wins")).cast("double")
    some = F.col("n") > 0
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    tier = F.lit(None)
    for least, name in reversed(TIERS):
        tier = F.when(F.coalesce("n", F.lit(0)) >= least, name).otherwise(tier)
    figures = {
        "mean": mean, "exact_lo": beta_quantile((1 - level) / 2, a, b), "exact_hi": beta_quantile((1 + level) / 2, a, b),
        "normal_lo": F.greatest(F.lit(0.0), mean - 1.96 * spread), "normal_hi": F.least(F.lit(1.0), mean + 1.96 * spread),
    }
    return counts.withColumns({c: F.when(some, x) for c, x in figures.items()} | {"tier": tier})
