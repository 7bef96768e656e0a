"""Rolling columns over bars that need no recursion.

All windows are partitioned by symbol and ordered by time, so Spark plans one
exchange and one sort for any number of them, and prunes what isn't selected.
A rolling value is NULL until its window is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, col, finite_or, ratio


def by_symbol() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("ts")


def by_day() -> WindowSpec:
    """From the first bar of the UTC day to this one."""
    return W.partitionBy("symbol", F.floor(F.unix_seconds("ts") / 86_400)).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)


def last_rows(n: int, end: int = 0):
    return by_symbol().rowsBetween(end - n + 1, end)


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(col(c), n).over(by_symbol())


def lead(c: Column | str, n: int = 1) -> Column:
    return F.lead(col(c), n).over(by_symbol())


def rolling(aggregate, c: Column | str, n: int, least: int | None = None) -> Column:
    """aggregate(c) over the last n rows, NULL unless `least` (n) of them have a value."""
    w = last_rows(n)
    return F.when(F.count(col(c)).over(w) >= (n if least is None else least), aggregate(col(c)).over(w))


def donchian(n: int = 20) -> tuple[Column, Column]:
    return rolling(F.max, "high", n), rolling(F.min, "low", n)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def rolling_vwap(n: int = 20) -> Column:
    return ratio(rolling(F.sum, typical() * F.col("volume"), n), rolling(F.sum, "volume", n))


def adaptive_vwap(least: int = 20, most: int = 96) -> Column:
    """VWAP over max(least, min(most, bars so far)) rows: at each bar what a frame that ends there has for its last one."""
    return ratio(rolling(F.sum, typical() * F.col("volume"), most, least), rolling(F.sum, "volume", most, least))


def filled(c: Column | str) -> Column:
    """The value, or the last one before it."""
    return F.last(col(c), ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))


def session_deviation(level: Column | str) -> Column:
    """Root of the running mean of (close - level)^2 within a UTC day."""
    return F.sqrt(F.avg(F.pow(F.col("close") - col(level), 2)).over(by_day()))


def bar_delta() -> Column:
    """Taker buys less taker sells; NULL counts 0."""
    return F.coalesce(2 * F.col("taker_buy") - F.col("volume"), F.lit(0.0))


def session_cvd() -> Column:
    return F.sum(bar_delta()).over(by_day())


def cvd_24h() -> Column:
    """Sum of deltas over (t - 24 h, t]."""
    w = W.partitionBy("symbol").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000 + 1, 0)
    return F.sum(bar_delta()).over(w)


def money_flow(n: int = 20) -> Column:
    span = F.col("high") - F.col("low")
    part = F.when(span == 0, 0.0).otherwise((2 * F.col("close") - F.col("low") - F.col("high")) / span)
    return finite_or(ratio(rolling(F.sum, part * F.col("volume"), n), rolling(F.sum, "volume", n)), 0.0)


def true_range() -> Column:
    """Greatest of the range and the distances to the close before; the first bar has its range."""
    c = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def ultimate(a: int = 7, b: int = 14, c: int = 28) -> Column:
    before = lag("close")
    low, high = F.least("low", before), F.greatest("high", before)
    pressure, reach = F.when(before.isNotNull(), F.col("close") - low), F.when(before.isNotNull(), high - low)
    part = lambda n: ratio(rolling(F.sum, pressure, n), rolling(F.sum, reach, n))
    return finite_or((4 * part(a) + 2 * part(b) + part(c)) / 7 * 100, 50.0)


def log_return(n: int = 1) -> Column:
    return F.when((F.col("close") > 0) & (lag("close", n) > 0), F.log(F.col("close")) - F.log(lag("close", n)))


def simple_return() -> Column:
    return ratio("close", lag("close")) - 1


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds log_ret and ret; windows over them need them as columns."""
    return bars.withColumns({"log_ret": log_return(), "ret": simple_return()})


def realised_volatility(n: int = 20) -> Column:
    """Needs log_ret."""
    return finite_or(rolling(F.stddev_samp, "log_ret", n) * float(n) ** 0.5 * 100, 0.0)


def zscore(c: Column | str, n: int, fill: float | None = 0.0) -> Column:
    z = ratio(col(c) - rolling(F.avg, c, n), rolling(F.stddev_samp, c, n))
    return z if fill is None else finite_or(z, fill)


def mid_range(n: int) -> Column:
    return (rolling(F.max, "high", n) + rolling(F.min, "low", n)) / 2


def with_ichimoku(bars: DataFrame) -> DataFrame:
    base = bars.withColumns({"tenkan": mid_range(9), "kijun": mid_range(26), "__b": mid_range(52)})
    return base.withColumns({"senkou_a": lag((F.col("tenkan") + F.col("kijun")) / 2, 26), "senkou_b": lag("__b", 26)}).drop("__b")


def weighted_mean(c: Column | str, n: int, rn: str = "rn") -> Column:
    """Linear weights n, n-1, ... from the newest, from two running sums: of x and of x times its row number (a column)."""
    w = last_rows(n)
    weighed = F.sum(F.col(rn) * col(c)).over(w) - (F.col(rn) - n) * F.sum(col(c)).over(w)
    return F.when(F.count(col(c)).over(w) == n, weighed / (n * (n + 1) / 2))


def with_hull(bars: DataFrame, n: int, name: str, rn: str = "rn") -> DataFrame:
    root = int(n**0.5)
    return bars.withColumn("__raw", 2 * weighted_mean("close", n // 2, rn) - weighted_mean("close", n, rn)).withColumn(name, weighted_mean("__raw", root, rn)).drop("__raw")


def with_ols(bars: DataFrame, n: int = 20) -> DataFrame:
    """Slope of close on bar number over n rows, and the residual of the last row."""
    w = last_rows(n)
    t = F.row_number().over(by_symbol()).cast("double")
    full = F.count("close").over(w) == n
    out = bars.withColumn("__t", t)
    slope = F.regr_slope("close", "__t").over(w)
    fit = F.regr_intercept("close", "__t").over(w) + slope * F.col("__t")
    return out.withColumns({"slope": F.when(full, slope), "residual": F.when(full, F.col("close") - fit)}).drop("__t")


def with_sharpe_drawdown(bars: DataFrame, n: int = 20) -> DataFrame:
    out = with_returns(bars)
    peak = F.max("close").over(by_symbol().rowsBetween(W.unboundedPreceding, 0))
    return out.withColumns({"sharpe": ratio(rolling(F.avg, "ret", n), rolling(F.stddev_samp, "ret", n)), "drawdown": ratio("close", peak) - 1})


def stochastic(n: int = 14) -> Column:
    """Position in the n-bar range in percent; NULL on a flat window."""
    top, bottom = rolling(F.max, "high", n), rolling(F.min, "low", n)
    return 100 * ratio(F.col("close") - bottom, top - bottom)


def williams(n: int = 14) -> Column:
    top, bottom = rolling(F.max, "high", n), rolling(F.min, "low", n)
    return -100 * ratio(top - F.col("close"), top - bottom)


def bollinger(n: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    middle, sigma = rolling(F.avg, "close", n), rolling(F.stddev_pop, "close", n)
    return middle - width * sigma, middle, middle + width * sigma


def aroon(n: int = 14) -> tuple[Column, Column]:
    """Up and down: how recent the highest and lowest of n + 1 bars are, 0..100; later bars win ties."""
    w = last_rows(n + 1)
    full = F.count("high").over(w) == n + 1
    at = lambda c: F.max_by("rn", F.struct(c, F.col("rn"))).over(w)
    up, down = at(F.col("high")), at(-F.col("low"))
    return F.when(full, 100.0 * (n - (F.col("rn") - up)) / n), F.when(full, 100.0 * (n - (F.col("rn") - down)) / n)


def channel_index(n: int = 20) -> Column:
    """Distance from the mean in mean absolute deviations over 0.015."""
    t = typical()
    values = F.collect_list(t).over(last_rows(n))
    mean = rolling(F.avg, t, n)
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / n
    return ratio(t - mean, 0.015 * spread)


def with_money_index(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds mfi: share of money that flowed on rising typical prices."""
    out = bars.withColumn("__t", typical())
    step = F.col("__t") - lag("__t")
    money = F.col("__t") * F.col("volume")
    out = out.withColumns({"__up": F.when(step > 0, money).when(step.isNotNull(), 0.0), "__down": F.when(step < 0, money).when(step.isNotNull(), 0.0)})
    up, down = rolling(F.sum, "__up", n), rolling(F.sum, "__down", n)
    return out.withColumn("mfi", 100 * ratio(up, up + down)).drop("__t", "__up", "__down")


def with_balance_volume(bars: DataFrame) -> DataFrame:
    """Adds obv: volume signed by the direction of close, summed from the first bar."""
    step = F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0))
    out = bars.withColumn("__s", step * F.col("volume"))
    return out.withColumn("obv", F.sum("__s").over(by_symbol().rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def rate_of_change(n: int = 10) -> Column:
    return 100 * (ratio("close", lag("close", n)) - 1)


def rank_in_window(c: Column | str, n: int) -> Column:
    """Average rank of the last value among the last n, over n."""
    values = F.collect_list(col(c)).over(last_rows(n))
    below = F.size(F.filter(values, lambda x: x < col(c)))
    same = F.size(F.filter(values, lambda x: x == col(c)))
    return F.when(F.count(col(c)).over(last_rows(n)) == n, (below + (same + 1) / 2) / n)


SESSIONS = {"asia": (0, 8), "london": (7, 16), "new_york": (13, 22), "overlap": (13, 16)}


def session_volatility(session: str, n: int = 20) -> Column:
    """Deviation of log returns over n bars that all lie in the session (UTC hours), else 0. Needs log_ret."""
    a, b = SESSIONS[session]
    hour = F.pmod(F.floor(F.unix_seconds("ts") / 3600), F.lit(24))
    inside = (hour >= a) & (hour < b)
    return F.coalesce(rolling(F.stddev_samp, F.when(inside, F.col("log_ret")), n) * float(n) ** 0.5 * 100, F.lit(0.0))


def candle_patterns() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    o1, c1, o2, c2 = lag("open"), lag("close"), lag("open", 2), lag("close", 2)
    body, body1, body2, span = F.abs(c - o), F.abs(c1 - o1), F.abs(c2 - o2), h - l
    up_wick, down_wick = h - F.greatest(o, c), F.least(o, c) - l
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    small1 = body1 < 0.45 * body2
    return {
        "doji": flag((span > 0) & (body <= 0.1 * span)),
        "hammer": flag((body > 0) & (down_wick >= 2 * body) & (up_wick <= 0.5 * body)),
        "shooting_star": flag((body > 0) & (up_wick >= 2 * body) & (down_wick <= 0.5 * body)),
        "bullish_engulfing": flag((c1 < o1) & (c > o) & (o <= c1) & (c >= o1)),
        "bearish_engulfing": flag((c1 > o1) & (c < o) & (o >= c1) & (c <= o1)),
        "morning_star": flag((c2 < o2) & small1 & (c > o) & (c > (o2 + c2) / 2)),
        "evening_star": flag((c2 > o2) & small1 & (c < o) & (c < (o2 + c2) / 2)),
    }


def swing(left: int, right: int) -> tuple[Column, Column]:
    """Pivot highs and lows: strictly beyond `left` bars before and `right` after, all of them present."""
    w_left, w_right = by_symbol().rowsBetween(-left, -1), by_symbol().rowsBetween(1, right)
    there = (F.count("high").over(w_left) == left) & (F.count("high").over(w_right) == right)
    high = there & (F.col("high") > F.max("high").over(w_left)) & (F.col("high") > F.max("high").over(w_right))
    low = there & (F.col("low") < F.min("low").over(w_left)) & (F.col("low") < F.min("low").over(w_right))
    return high, low


def factor_row(rsi: Column, adx: Column, taker: Column, funding: Column) -> dict[str, Column]:
    """Bounded factors in [-1, 1]."""
    return {
        "f_rsi": clip((50 - rsi) / 50, -1, 1),
        "f_adx": clip(adx / 50, 0, 1),
        "f_taker": clip((taker - 1) * 2, -1, 1),
        "f_funding": clip(funding * 5000, -1, 1),
    }


def with_stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    """bars with stoch_k (the fast line, unsmoothed) and stoch_d, its mean over d bars."""
    return bars.withColumn("stoch_k", stochastic(n)).withColumn("stoch_d", rolling(F.avg, "stoch_k", d))


def delta(c: Column | str, n: int = 1) -> Column:
    """The value less that of n bars before."""
    return col(c) - F.lag(col(c), n).over(by_symbol())
