"""The prepared frame: rolling and recursive columns of a set of groups over bars of all symbols in one plan.

Groups name column builders; a group's needs are resolved before building, and
what the caller doesn't select is pruned by the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio
from tidemark.operators import recursive as K
from tidemark.operators import windows as R

Builder = Callable[[DataFrame], DataFrame]
GROUPS: dict[str, tuple[tuple[str, ...], Builder]] = {}


def group(name: str, *needs: str) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        GROUPS[name] = (needs, f)
        return f

    return add


def resolved(names: Iterable[str]) -> list[str]:
    """The groups and all they need, needs first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for n in GROUPS[name][0]:
            visit(n)
        out.append(name)

    for n in names:
        visit(n)
    return out


def prepare(bars: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """bars with the columns of the groups (all) and of what they need; one exchange by symbol."""
    # Recursive groups sort by runs, so they come while rows are narrow.
    for name in resolved([*RECURSIVE, *GROUPS] if names is None else names):
        bars = GROUPS[name][1](bars)
    return bars.drop(*[c for c in bars.columns if c.startswith("__")])


RECURSIVE = ("rsi", "atr", "adx", "macd", "keltner")


@group("returns")
def _returns(df: DataFrame) -> DataFrame:
    return R.with_returns(df)


@group("donchian")
def _donchian(df: DataFrame) -> DataFrame:
    high, low = R.donchian(20)
    df = df.withColumns({"donchian_high20": high, "donchian_low20": low})
    span = F.col("donchian_high20") - F.col("donchian_low20")
    place = clip(F.coalesce(ratio(F.col("close") - F.col("donchian_low20"), span), F.lit(0.5)), 0, 1)
    return df.withColumns({"prev_donchian_high20": R.lag("donchian_high20"), "prev_donchian_low20": R.lag("donchian_low20"), "close_position": place})


@group("volume")
def _volume(df: DataFrame) -> DataFrame:
    mean = R.rolling(F.avg, "volume", 20)
    return df.withColumns({"volume_mean20": mean, "volume_ratio20": ratio("volume", mean)})


@group("vwap")
def _vwap(df: DataFrame) -> DataFrame:
    df = df.withColumn("vwap", R.adaptive_vwap()).withColumn("vwap", R.filled("vwap")).withColumn("vwap_std", R.session_deviation("vwap"))
    return df.withColumns({f"vwap_{side}{k}": F.col("vwap") + sign * k * F.col("vwap_std") for side, sign in (("upper", 1), ("lower", -1)) for k in (1, 2)})


@group("flow")
def _flow(df: DataFrame) -> DataFrame:
    return df.withColumns({"session_cvd": R.session_cvd(), "rolling_cvd_24h": R.cvd_24h(), "delta_ratio": clip(R.rolling(F.avg, ratio("taker_buy", "volume"), 5), 0, 1), "cmf20": R.money_flow(20)})


@group("bb")
def _bb(df: DataFrame) -> DataFrame:
    low, middle, high = R.bollinger(20)
    df = df.withColumns({"bb_lower": low, "bb_middle": middle, "bb_upper": high})
    width = ratio(F.col("bb_upper") - F.col("bb_lower"), F.greatest(F.abs("bb_middle"), F.lit(1e-10))) * 100
    df = df.withColumns({"bb_width": width, "bb_pct_b": F.coalesce(ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), F.lit(0.5))})
    return df.withColumn("bb_width_pctile50", R.rank_in_window("bb_width", 50))


@group("oscillators")
def _oscillators(df: DataFrame) -> DataFrame:
    up, down = R.aroon(14)
    df = df.withColumn("rn", F.row_number().over(R.by_symbol())).withColumns({"aroon_up": up, "aroon_down": down}).drop("rn")
    df = R.with_money_index(R.with_balance_volume(df))
    return df.withColumns({"uo": R.ultimate(), "stoch_k14": R.stochastic(14), "willr14": R.williams(14), "cci20": R.channel_index(20), "roc10": R.rate_of_change(10)})


@group("ichimoku")
def _ichimoku(df: DataFrame) -> DataFrame:
    return R.with_ichimoku(df)


@group("averages")
def _averages(df: DataFrame) -> DataFrame:
    df = df.withColumn("rn", F.row_number().over(R.by_symbol()))
    return R.with_hull(R.with_hull(df, 9, "hma9"), 21, "hma21").withColumn("wma9", R.weighted_mean("close", 9)).drop("rn")


@group("trend", "returns")
def _trend(df: DataFrame) -> DataFrame:
    return R.with_ols(df, 20).withColumns({"slope_pct20": ratio("slope", "close") * 100, "zscore30": R.zscore("close", 30)})


@group("risk", "returns")
def _risk(df: DataFrame) -> DataFrame:
    return R.with_sharpe_drawdown(df).withColumns({"realized_vol_20": R.realised_volatility(20), **{f"{s}_vol_20": R.session_volatility(s) for s in R.SESSIONS}})


@group("candles")
def _candles(df: DataFrame) -> DataFrame:
    return df.withColumns({f"candle_{k}": v for k, v in R.candle_patterns().items()})


@group("volatility", "risk")
def _volatility(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_of_vol_20", F.coalesce(R.rolling(F.stddev_samp, "realized_vol_20", 20, 1), F.lit(0.0)))


@group("order_flow", "flow")
def _order_flow(df: DataFrame) -> DataFrame:
    return df.withColumn("signed_order_flow", (clip("delta_ratio", 0, 1) - 0.5) * 2)


@group("smoothed")
def _smoothed(df: DataFrame) -> DataFrame:
    """The inputs of the recursive groups: averages of the close, of the typical price, of ranges and of moves; what no group shows is pruned."""
    step, up, down = F.col("close") - R.lag("close"), F.col("high") - R.lag("high"), R.lag("low") - F.col("low")
    given = df.withColumns({
        "__tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "__tr": R.true_range(), "__up": F.greatest(step, step * 0), "__down": F.greatest(-step, step * 0), "__r": F.when(up.isNotNull(), R.true_range()),
        "__p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "__m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })
    averages = {f"ema{n}": K.ema_series("close", n) for n in (20, 50, 200)} | {"__fast": K.ema_series("close", 12, 14), "__slow": K.ema_series("close", 26)}
    ranges = {"atr14": K.wilder_series("__tr", 14), "__reach": K.wilder_series("__tr", 10), "kc_middle": K.Smooth("__tp", 2 / 21)}
    out = K.smoothed(given, averages | ranges)
    return K.smoothed(out, {"__u": K.wilder_series("__up", 14), "__d": K.wilder_series("__down", 14), "__t": K.wilder_series("__r", 14), "__pu": K.wilder_series("__p", 14), "__md": K.wilder_series("__m", 14)})


@group("rsi", "smoothed")
def _rsi(df: DataFrame) -> DataFrame:
    both = F.col("__u") + F.col("__d")
    df = df.withColumn("rsi14", F.when(both > 0, 100 * F.col("__u") / both))
    top, bottom = R.rolling(F.max, "rsi14", 14), R.rolling(F.min, "rsi14", 14)
    return df.withColumn("stoch_rsi14", F.coalesce(ratio(F.col("rsi14") - bottom, top - bottom), F.lit(0.5)))


@group("atr", "smoothed")
def _atr(df: DataFrame) -> DataFrame:
    return df.withColumn("natr14", 100 * F.try_divide("atr14", "close"))


@group("adx", "smoothed")
def _adx(df: DataFrame) -> DataFrame:
    df = df.withColumns({"plus_di14": F.try_divide(100 * F.col("__pu"), "__t"), "minus_di14": F.try_divide(100 * F.col("__md"), "__t")})
    p, m = F.col("plus_di14"), F.col("minus_di14")
    df = df.withColumn("__dx", F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).when(F.col("__t").isNotNull(), 0.0))
    return K.smoothed(df, {"adx14": K.wilder_series("__dx", 14)})


@group("macd", "smoothed")
def _macd(df: DataFrame) -> DataFrame:
    df = K.smoothed(df.withColumn("macd", F.col("__fast") - F.col("__slow")), {"macd_signal": K.ema_series("macd", 9)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


@group("keltner", "smoothed")
def _keltner(df: DataFrame) -> DataFrame:
    return df.withColumns({"kc_upper": F.col("kc_middle") + 2 * F.col("__reach"), "kc_lower": F.col("kc_middle") - 2 * F.col("__reach")})


@group("sessions")
def _sessions(df: DataFrame) -> DataFrame:
    hour = F.pmod(F.floor(F.unix_seconds("ts") / 3600), F.lit(24))
    return df.withColumns({f"session_{s}": ((hour >= a) & (hour < b)).cast("int") for s, (a, b) in R.SESSIONS.items()})
