"""Queries over bars: builders, rolling columns, recursive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio, rounded
from tidemark.operators import bars as B
from tidemark.operators import recursive as K
from tidemark.operators import windows as R
from tidemark.plans.registry import query
from tidemark.plans.sql import LINE, bars, full, over, r, recursion
from tidemark.sources.tables import table

HOUR = 3600


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return B.bars(B.trades_from_events(table(spark, folder, "events").select("event_type", "event_id", "ts", "value")), "1 hour")


def shown(df: DataFrame, **columns: Column | str) -> DataFrame:
    """symbol, ts_s and the columns given, doubles rounded to six digits."""
    out = df.select("symbol", F.unix_seconds("ts").alias("ts_s"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    return out.select([rounded(n).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])


def _sql(body: str, seconds: int = HOUR, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{bars(seconds)}{', ' + more if more else ''} {body}"


@query(_sql(f"SELECT symbol, ts_s, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume, {r('quote_volume')} AS quote_volume, taker_buy, trades FROM b"))
def bars_1h(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), **{c: c for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy", "trades")})


@query(_sql(f"SELECT symbol, ts_s, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume FROM b", 14400))
def bars_4h_resampled(spark: SparkSession, folder: str) -> DataFrame:
    return shown(B.coarser(hourly(spark, folder), "4 hours"), **{c: c for c in ("open", "high", "low", "close", "volume")})


@query(
    _sql(f"""SELECT symbol, min(ts_s) AS ts_s, {r('arg_min(open, ts_s)')} AS open, {r('max(high)')} AS high, {r('min(low)')} AS low, {r('arg_max(close, ts_s)')} AS close, sum(volume) AS volume
FROM b GROUP BY symbol, (rn - 1) // 4 HAVING count(*) = 4""")
)
def bars_4h_from_1h_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shown(B.row_groups(hourly(spark, folder), 4), **{c: c for c in ("open", "high", "low", "close", "volume")})


NOW = 1704844800 + 1800


@query(_sql(f"SELECT symbol, ts_s, {r('close')} AS close FROM b WHERE ts_s + 3600 <= {NOW}"))
def closed_bars_only(spark: SparkSession, folder: str) -> DataFrame:
    return shown(B.closed(hourly(spark, folder), F.timestamp_seconds(F.lit(NOW)), HOUR), close="close")


@query(_sql("SELECT symbol, after_s, until_s, (until_s - after_s) // 3600 - 1 AS missing FROM (SELECT symbol, lag(ts_s) " + LINE + " AS after_s, ts_s AS until_s FROM b) WHERE until_s - after_s > 5400"))
def gap_report(spark: SparkSession, folder: str) -> DataFrame:
    return B.gaps(hourly(spark, folder), HOUR).select("symbol", F.unix_seconds("after").alias("after_s"), F.unix_seconds("until").alias("until_s"), "missing")


@query(
    _sql("SELECT symbol, unnest(generate_series(after_s + 3600, until_s - 3600, 3600)) AS ts_s FROM (SELECT symbol, lag(ts_s) " + LINE + " AS after_s, ts_s AS until_s FROM b) WHERE until_s - after_s > 5400")
)
def missing_bars(spark: SparkSession, folder: str) -> DataFrame:
    return B.missing_bars(B.gaps(hourly(spark, folder), HOUR), HOUR).select("symbol", F.unix_seconds("ts").alias("ts_s"))


@query(_sql(f"SELECT symbol, {NOW} - (max(ts_s) + 3600) AS age_s, {NOW} - (max(ts_s) + 3600) > 7200 AS stale FROM b GROUP BY symbol"))
def bar_staleness(spark: SparkSession, folder: str) -> DataFrame:
    return B.staleness(hourly(spark, folder), F.timestamp_seconds(F.lit(NOW)), HOUR)


@query(
    _sql(f"""SELECT symbol, ts_s, {r('hi')} AS high20, {r('lo')} AS low20, {r('lag(hi) ' + LINE)} AS prev_high20, {r('lag(lo) ' + LINE)} AS prev_low20
FROM (SELECT *, {full(20, 'max(high) ' + over(20))} AS hi, {full(20, 'min(low) ' + over(20))} AS lo FROM b)""")
)
def donchian20(spark: SparkSession, folder: str) -> DataFrame:
    high, low = R.donchian(20)
    df = hourly(spark, folder).withColumns({"hi": high, "lo": low})
    return shown(df, high20="hi", low20="lo", prev_high20=R.lag("hi"), prev_low20=R.lag("lo"))


@query(_sql(f"SELECT symbol, ts_s, {r(full(20, 'avg(volume) ' + over(20)))} AS volume_mean20, {r(full(20, 'volume / avg(volume) ' + over(20)))} AS volume_ratio20 FROM b"))
def volume_ratio20(spark: SparkSession, folder: str) -> DataFrame:
    mean = R.rolling(F.avg, "volume", 20)
    return shown(hourly(spark, folder), volume_mean20=mean, volume_ratio20=ratio("volume", mean))


_VWAP = full(20, f"(sum((high + low + close) / 3 * volume) {over(96)}) / nullif(sum(volume) {over(96)}, 0)")
_FILLED = f"SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS vwap FROM (SELECT *, {_VWAP} AS raw FROM b)"


# A billionth more on both sides: means of prices with two decimals often lie on the very border of rounding.
@query(_sql(f"SELECT symbol, ts_s, {r('vwap + 1e-9')} AS vwap FROM ({_FILLED})"))
def rolling_vwap(spark: SparkSession, folder: str) -> DataFrame:
    df = hourly(spark, folder).withColumn("vwap", R.adaptive_vwap())
    return shown(df, vwap=R.filled("vwap") + 1e-9)


@query(
    _sql(f"""SELECT symbol, ts_s, {r('vwap + 1e-9')} AS vwap, {r('vwap + sd')} AS upper1, {r('vwap - sd')} AS lower1, {r('(close - vwap) / vwap * 100')} AS deviation_pct FROM (
  SELECT *, sqrt(avg(power(close - vwap, 2)) OVER (PARTITION BY symbol, ts_s // 86400 ORDER BY ts_s)) AS sd FROM ({_FILLED}))""")
)
def vwap_session_bands(spark: SparkSession, folder: str) -> DataFrame:
    df = hourly(spark, folder).withColumn("vwap", R.adaptive_vwap()).withColumn("vwap", R.filled("vwap")).withColumn("sd", R.session_deviation("vwap"))
    return shown(df, vwap=F.col("vwap") + 1e-9, upper1=F.col("vwap") + F.col("sd"), lower1=F.col("vwap") - F.col("sd"), deviation_pct=(F.col("close") - F.col("vwap")) / F.col("vwap") * 100)


@query(_sql("SELECT symbol, ts_s, sum(2 * taker_buy - volume) OVER (PARTITION BY symbol, ts_s // 86400 ORDER BY ts_s) AS cvd FROM b"))
def session_cvd(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), cvd=R.session_cvd())


@query(_sql("SELECT symbol, ts_s, sum(2 * taker_buy - volume) OVER (PARTITION BY symbol ORDER BY ts_s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS cvd FROM b"))
def cvd_24h_range(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), cvd=R.cvd_24h())


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f"coalesce({full(20, f'(sum(m) {over(20)}) / (sum(volume) {over(20)})')}, 0)")} AS cmf20
FROM (SELECT *, CASE WHEN high = low THEN 0 ELSE (2 * close - low - high) / (high - low) * volume END AS m FROM b)""")
)
def cmf20(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), cmf20=R.money_flow(20))


def _uo(n: int) -> str:
    return f"(sum(bp) {over(n)}) / nullif(sum(tr) {over(n)}, 0)"


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f"coalesce(CASE WHEN rn >= 29 THEN (4 * {_uo(7)} + 2 * {_uo(14)} + {_uo(28)}) / 7 * 100 END, 50)")} AS uo FROM (
  SELECT *, CASE WHEN c1 IS NOT NULL THEN close - least(low, c1) END AS bp, CASE WHEN c1 IS NOT NULL THEN greatest(high, c1) - least(low, c1) END AS tr
  FROM (SELECT *, lag(close) {LINE} AS c1 FROM b))""")
)
def ultimate_osc(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), uo=R.ultimate())


_RET = f"ret AS (SELECT *, CASE WHEN close > 0 AND c1 > 0 THEN ln(close) - ln(c1) END AS log_ret, close / nullif(c1, 0) - 1 AS ret FROM (SELECT *, lag(close) {LINE} AS c1 FROM b))"


@query(_sql(f"SELECT symbol, ts_s, {r(f'coalesce(CASE WHEN count(log_ret) {over(20)} = 20 THEN stddev_samp(log_ret) {over(20)} END * sqrt(20) * 100, 0)')} AS realized_vol20 FROM ret", more=_RET))
def realized_vol20(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_returns(hourly(spark, folder)), realized_vol20=R.realised_volatility(20))


@query(_sql(f"SELECT symbol, ts_s, {r(f'coalesce({full(30, f'(close - avg(close) {over(30)}) / nullif(stddev_samp(close) {over(30)}, 0)')}, 0)')} AS zscore30 FROM b"))
def zscore30(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), zscore30=R.zscore("close", 30))


def _mid(n: int) -> str:
    return full(n, f"((max(high) {over(n)}) + (min(low) {over(n)})) / 2")


@query(
    _sql(f"""SELECT symbol, ts_s, {r('tenkan')} AS tenkan, {r('kijun')} AS kijun, {r(f'lag((tenkan + kijun) / 2, 26) {LINE}')} AS senkou_a, {r(f'lag(b52, 26) {LINE}')} AS senkou_b
FROM (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS b52 FROM b)""")
)
def ichimoku(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_ichimoku(hourly(spark, folder)), tenkan="tenkan", kijun="kijun", senkou_a="senkou_a", senkou_b="senkou_b")


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - k} * (lag({x}, {k}) {LINE})" if k else f"{n} * {x}" for k in range(n)) + f") / {n * (n + 1) / 2}"


@query(_sql(f"SELECT symbol, ts_s, {r('wma')} AS wma9, {r(_wma('raw', 3))} AS hma9 FROM (SELECT *, {_wma('close', 9)} AS wma, 2 * ({_wma('close', 4)}) - {_wma('close', 9)} AS raw FROM b)"))
def wma_hma(spark: SparkSession, folder: str) -> DataFrame:
    df = R.with_hull(hourly(spark, folder).withColumn("rn", F.row_number().over(R.by_symbol())), 9, "hma9")
    return shown(df, wma9=R.weighted_mean("close", 9), hma9="hma9")


@query(
    _sql(f"""SELECT symbol, ts_s, {r(full(20, f'regr_slope(close, rn) {over(20)}'))} AS slope, {r(full(20, f'close - (regr_intercept(close, rn) {over(20)} + (regr_slope(close, rn) {over(20)}) * rn)'))} AS residual FROM b""")
)
def ols_slope20(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_ols(hourly(spark, folder), 20), slope="slope", residual="residual")


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f'CASE WHEN count(ret) {over(20)} = 20 THEN (avg(ret) {over(20)}) / nullif(stddev_samp(ret) {over(20)}, 0) END')} AS sharpe,
{r(f'close / (max(close) OVER (PARTITION BY symbol ORDER BY ts_s ROWS UNBOUNDED PRECEDING)) - 1')} AS drawdown FROM ret""", more=_RET)
)
def sharpe_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_sharpe_drawdown(hourly(spark, folder)), sharpe="sharpe", drawdown="drawdown")


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f'100 * (close - lo) / nullif(hi - lo, 0)')} AS stoch_k, {r(f'-100 * (hi - close) / nullif(hi - lo, 0)')} AS willr
FROM (SELECT *, {full(14, 'max(high) ' + over(14))} AS hi, {full(14, 'min(low) ' + over(14))} AS lo FROM b)""")
)
def stochastic_williams(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), stoch_k=R.stochastic(14), willr=R.williams(14))


@query(
    _sql(f"""SELECT symbol, ts_s, {r('m - 2 * s')} AS lower, {r('m')} AS middle, {r('m + 2 * s')} AS upper, {r('(close - (m - 2 * s)) / nullif(4 * s, 0)')} AS percent_b
FROM (SELECT *, {full(20, 'avg(close) ' + over(20))} AS m, {full(20, 'stddev_pop(close) ' + over(20))} AS s FROM b)""")
)
def bollinger20(spark: SparkSession, folder: str) -> DataFrame:
    low, middle, high = R.bollinger(20)
    df = hourly(spark, folder).withColumns({"lower": low, "middle": middle, "upper": high})
    return shown(df, lower="lower", middle="middle", upper="upper", percent_b=ratio(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower")))


@query(
    _sql(f"""SELECT symbol, ts_s, {r(full(15, f'100.0 * (14 - (rn - arg_max(rn, struct_pack(a := high, b := rn)) {over(15)})) / 14'))} AS aroon_up,
{r(full(15, f'100.0 * (14 - (rn - arg_max(rn, struct_pack(a := -low, b := rn)) {over(15)})) / 14'))} AS aroon_down FROM b""")
)
def aroon14(spark: SparkSession, folder: str) -> DataFrame:
    up, down = R.aroon(14)
    df = hourly(spark, folder).withColumn("rn", F.row_number().over(R.by_symbol()))
    return shown(df, aroon_up=up, aroon_down=down)


@query(
    _sql(f"""SELECT symbol, ts_s, {r('CASE WHEN rn >= 20 THEN (t - m) / nullif(0.015 * list_sum(list_transform(v, lambda x: abs(x - m))) / 20, 0) END')} AS cci20
FROM (SELECT *, avg(t) {over(20)} AS m, list(t) {over(20)} AS v FROM (SELECT *, (high + low + close) / 3 AS t FROM b))""")
)
def cci20(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), cci20=R.channel_index(20))


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f'CASE WHEN rn >= 15 THEN 100 * (sum(up) {over(14)}) / nullif(sum(up + dn) {over(14)}, 0) END')} AS mfi14 FROM (
  SELECT *, CASE WHEN t > t1 THEN t * volume WHEN t1 IS NOT NULL THEN 0 END AS up, CASE WHEN t < t1 THEN t * volume WHEN t1 IS NOT NULL THEN 0 END AS dn
  FROM (SELECT *, lag(t) {LINE} AS t1 FROM (SELECT *, (high + low + close) / 3 AS t FROM b)))""")
)
def mfi14(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_money_index(hourly(spark, folder)), mfi14="mfi")


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f'100 * (close / nullif(lag(close, 10) {LINE}, 0) - 1)')} AS roc10, sum(coalesce(sign(close - c1), 0) * volume) OVER (PARTITION BY symbol ORDER BY ts_s ROWS UNBOUNDED PRECEDING) AS obv
FROM (SELECT *, lag(close) {LINE} AS c1 FROM b)""")
)
def roc_obv(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_balance_volume(hourly(spark, folder)), roc10=R.rate_of_change(10), obv="obv")


@query(
    _sql(f"""SELECT symbol, ts_s, {r('CASE WHEN rn >= 20 THEN (len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / 20 END')} AS ts_rank20,
{r(full(20, f'corr(close, quote_volume) {over(20)}'))} AS ts_corr20 FROM (SELECT *, list(close) {over(20)} AS v FROM b)""")
)
def rank_corr20(spark: SparkSession, folder: str) -> DataFrame:
    w = R.last_rows(20)
    return shown(hourly(spark, folder), ts_rank20=R.rank_in_window("close", 20), ts_corr20=F.when(F.count("close").over(w) == 20, F.corr("close", "quote_volume").over(w)))


def _session(a: int, b: int) -> str:
    x = f"CASE WHEN (ts_s // 3600) % 24 >= {a} AND (ts_s // 3600) % 24 < {b} THEN log_ret END"
    return r(f"coalesce(CASE WHEN count({x}) {over(4)} = 4 THEN stddev_samp({x}) {over(4)} END * sqrt(4) * 100, 0)")


@query(_sql(f"SELECT symbol, ts_s, {_session(0, 8)} AS asia, {_session(7, 16)} AS london, {_session(13, 22)} AS new_york FROM ret", more=_RET))
def session_volatility4(spark: SparkSession, folder: str) -> DataFrame:
    return shown(R.with_returns(hourly(spark, folder)), **{s: R.session_volatility(s, 4) for s in ("asia", "london", "new_york")})


_FLAG = "coalesce({}, false)::INTEGER".format


@query(
    _sql(f"""SELECT symbol, ts_s, {_FLAG('high > low AND body <= 0.1 * (high - low)')} AS doji, {_FLAG('body > 0 AND dn >= 2 * body AND up <= 0.5 * body')} AS hammer,
{_FLAG('body > 0 AND up >= 2 * body AND dn <= 0.5 * body')} AS shooting_star, {_FLAG('c1 < o1 AND close > open AND open <= c1 AND close >= o1')} AS bullish_engulfing,
{_FLAG('c1 > o1 AND close < open AND open >= c1 AND close <= o1')} AS bearish_engulfing,
{_FLAG('c2 < o2 AND abs(c1 - o1) < 0.45 * abs(c2 - o2) AND close > open AND close > (o2 + c2) / 2')} AS morning_star,
{_FLAG('c2 > o2 AND abs(c1 - o1) < 0.45 * abs(c2 - o2) AND close < open AND close < (o2 + c2) / 2')} AS evening_star
FROM (SELECT *, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn, lag(open) {LINE} AS o1, lag(close) {LINE} AS c1, lag(open, 2) {LINE} AS o2, lag(close, 2) {LINE} AS c2 FROM b)""")
)
def candle_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), **R.candle_patterns())


def _pivots(left: int, right: int) -> str:
    a, b = f"OVER (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING)", f"OVER (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING)"
    return f"""piv AS (SELECT *, coalesce(n1 = {left} AND n2 = {right} AND high > h1 AND high > h2, false) AS ph, coalesce(n1 = {left} AND n2 = {right} AND low < l1 AND low < l2, false) AS pl FROM (
  SELECT *, count(*) {a} AS n1, count(*) {b} AS n2, max(high) {a} AS h1, max(high) {b} AS h2, min(low) {a} AS l1, min(low) {b} AS l2 FROM b))"""


def _swings(spark: SparkSession, folder: str, left: int, right: int) -> DataFrame:
    high, low = R.swing(left, right)
    return hourly(spark, folder).withColumns({"ph": F.coalesce(high, F.lit(False)), "pl": F.coalesce(low, F.lit(False))})


@query(_sql("SELECT symbol, ts_s, ph, pl FROM piv WHERE ph OR pl", more=_pivots(3, 1)))
def swing_pivots_asym(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_swings(spark, folder, 3, 1).where("ph OR pl"), ph="ph", pl="pl")


@query(_sql("SELECT symbol, ts_s, ph, pl FROM piv WHERE ph OR pl", more=_pivots(5, 5)))
def swing_pivots_sym(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_swings(spark, folder, 5, 5).where("ph OR pl"), ph="ph", pl="pl")


_STRUCTURE = """, hs AS (SELECT symbol, list(high ORDER BY ts_s DESC) AS v FROM piv WHERE ph GROUP BY symbol), ls AS (SELECT symbol, list(low ORDER BY ts_s DESC) AS v FROM piv WHERE pl GROUP BY symbol)"""


@query(
    _sql(
        """SELECT hs.symbol, CASE WHEN hs.v[1] > hs.v[2] AND ls.v[1] > ls.v[2] THEN 'up' WHEN hs.v[1] < hs.v[2] AND ls.v[1] < ls.v[2] THEN 'down' ELSE 'range' END AS structure
FROM hs JOIN ls ON hs.symbol = ls.symbol WHERE len(hs.v) >= 2 AND len(ls.v) >= 2""",
        more=_pivots(3, 1) + _STRUCTURE,
    )
)
def market_structure(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators.structure import last_two_structure

    return last_two_structure(_swings(spark, folder, 3, 1))


# Recursive columns.


@query(_sql(f"SELECT b.symbol, b.ts_s, {r('e.y')} AS ema20 FROM b LEFT JOIN e ON e.symbol = b.symbol AND e.rn = b.rn", more=recursion("e", "b", "close", 2 / 21, 20), recursive=True))
def ema20(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.ema(hourly(spark, folder), 20), ema20="ema20")


_TR = f"t AS (SELECT *, coalesce(greatest(high - low, abs(high - c1), abs(low - c1)), high - low) AS tr, CASE WHEN close > c1 THEN close - c1 WHEN c1 IS NOT NULL THEN 0 END AS up, CASE WHEN close < c1 THEN c1 - close WHEN c1 IS NOT NULL THEN 0 END AS dn FROM (SELECT *, lag(close) {LINE} AS c1 FROM b))"


@query(_sql(f"SELECT t.symbol, t.ts_s, {r('e.y')} AS atr14 FROM t LEFT JOIN e ON e.symbol = t.symbol AND e.rn = t.rn", more=_TR + ", " + recursion("e", "t", "tr", 1 / 14, 14), recursive=True))
def rma_atr14(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.atr(hourly(spark, folder), 14), atr14="atr14")


@query(
    _sql(
        f"SELECT t.symbol, t.ts_s, {r('100 * u.y / nullif(u.y + d.y, 0)')} AS rsi14 FROM t LEFT JOIN u ON u.symbol = t.symbol AND u.rn = t.rn LEFT JOIN d ON d.symbol = t.symbol AND d.rn = t.rn",
        more=_TR + ", " + recursion("u", "t", "up", 1 / 14, 14, 1) + ", " + recursion("d", "t", "dn", 1 / 14, 14, 1),
        recursive=True,
    )
)
def rsi14(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.rsi(hourly(spark, folder), 14), rsi14="rsi14")


_DM = f"""t AS (SELECT *, coalesce(greatest(high - low, abs(high - c1), abs(low - c1)), high - low) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m
FROM (SELECT *, lag(close) {LINE} AS c1, high - lag(high) {LINE} AS up, lag(low) {LINE} - low AS dn FROM b))"""


@query(
    _sql(
        f"SELECT t.symbol, t.ts_s, {r('di.pdi')} AS plus_di, {r('di.mdi')} AS minus_di, {r('x.y')} AS adx FROM t LEFT JOIN di ON di.symbol = t.symbol AND di.rn = t.rn LEFT JOIN x ON x.symbol = t.symbol AND x.rn = t.rn",
        more=", ".join(
            [
                _DM, recursion("a", "t", "tr", 1 / 14, 14, 1), recursion("p", "t", "p", 1 / 14, 14, 1), recursion("m", "t", "m", 1 / 14, 14, 1),
                "di AS (SELECT symbol, rn, pdi, mdi, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM (SELECT a.symbol, a.rn, 100 * p.y / a.y AS pdi, 100 * m.y / a.y AS mdi FROM a JOIN p ON p.symbol = a.symbol AND p.rn = a.rn JOIN m ON m.symbol = a.symbol AND m.rn = a.rn))",
                recursion("x", "di", "dx", 1 / 14, 14, 14),
            ]
        ),
        recursive=True,
    )
)
def adx14(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.adx(hourly(spark, folder), 14), plus_di="plus_di", minus_di="minus_di", adx="adx")


@query(
    _sql(
        f"SELECT b.symbol, b.ts_s, {r('l.line')} AS macd, {r('s.y')} AS macd_signal, {r('l.line - s.y')} AS macd_hist FROM b LEFT JOIN l ON l.symbol = b.symbol AND l.rn = b.rn LEFT JOIN s ON s.symbol = b.symbol AND s.rn = b.rn",
        more=", ".join(
            [recursion("f", "b", "close", 2 / 13, 12, 14), recursion("w", "b", "close", 2 / 27, 26), "l AS (SELECT f.symbol, f.rn, f.y - w.y AS line FROM f JOIN w ON w.symbol = f.symbol AND w.rn = f.rn)", recursion("s", "l", "line", 2 / 10, 9, 25)]
        ),
        recursive=True,
    )
)
def macd(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.macd(hourly(spark, folder)), macd="macd", macd_signal="macd_signal", macd_hist="macd_hist")


@query(
    _sql(
        f"SELECT t.symbol, t.ts_s, {r('e.y')} AS kc_middle, {r('e.y + 2 * a.y')} AS kc_upper, {r('e.y - 2 * a.y')} AS kc_lower FROM t JOIN e ON e.symbol = t.symbol AND e.rn = t.rn LEFT JOIN a ON a.symbol = t.symbol AND a.rn = t.rn",
        more=", ".join([_TR.replace("coalesce(greatest", "(high + low + close) / 3 AS tp, coalesce(greatest"), recursion("e", "t", "tp", 2 / 21, 1), recursion("a", "t", "tr", 1 / 10, 10)]),
        recursive=True,
    )
)
def keltner(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.keltner(hourly(spark, folder)), kc_middle="kc_middle", kc_upper="kc_upper", kc_lower="kc_lower")


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('y')} AS kama10 FROM k JOIN s USING (symbol, rn)",
        more=f"""s AS (SELECT *, power(coalesce(CASE WHEN rn > 10 THEN abs(close - lag(close, 10) {LINE}) / nullif(sum(mv) {over(10)}, 0) END, 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc
  FROM (SELECT symbol, ts_s, rn, close, abs(close - lag(close) {LINE}) AS mv FROM b)),
k AS (SELECT symbol, rn, close AS y FROM s WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, k.y + s.sc * (s.close - k.y) FROM k JOIN s ON s.symbol = k.symbol AND s.rn = k.rn + 1)""",
        recursive=True,
    )
)
def kama10(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.kama(hourly(spark, folder), 10), kama10="kama")


@query(
    _sql(
        f"SELECT b.symbol, b.ts_s, {r('CASE WHEN z.trend = 1 THEN z.bot ELSE z.top END')} AS supertrend, z.trend::DOUBLE AS trend FROM b LEFT JOIN z ON z.symbol = b.symbol AND z.rn = b.rn",
        more=", ".join(
            [
                _TR, recursion("a", "t", "tr", 1 / 10, 10),
                "q AS (SELECT t.symbol, t.rn, t.close, t.c1, (t.high + t.low) / 2 + 3 * coalesce(a.y, 0) AS up, (t.high + t.low) / 2 - 3 * coalesce(a.y, 0) AS dn FROM t LEFT JOIN a ON a.symbol = t.symbol AND a.rn = t.rn)",
                """z AS (SELECT symbol, rn, up AS top, dn AS bot, 1 AS trend FROM q WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, top, bot, CASE WHEN trend = 1 AND close < bot THEN -1 WHEN trend = -1 AND close > top THEN 1 ELSE trend END FROM (
    SELECT q.symbol, q.rn, q.close, z.trend, CASE WHEN q.c1 < z.top THEN least(q.up, z.top) ELSE q.up END AS top, CASE WHEN q.c1 > z.bot THEN greatest(q.dn, z.bot) ELSE q.dn END AS bot
    FROM z JOIN q ON q.symbol = z.symbol AND q.rn = z.rn + 1))""",
            ]
        ),
        recursive=True,
    )
)
def supertrend(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.supertrend(hourly(spark, folder), 10), supertrend="supertrend", trend="trend")


@query(
    _sql(
        f"SELECT b.symbol, b.ts_s, {r('CASE WHEN s.up THEN s.sar ELSE 0 END')} AS psar_long, {r('CASE WHEN s.up THEN 0 ELSE s.sar END')} AS psar_short, CASE WHEN NOT turn THEN 0.0 WHEN s.up THEN 1.0 ELSE -1.0 END::DOUBLE AS psar_reversal FROM b JOIN s USING (symbol, rn)",
        more=f"""w AS (SELECT *, lag(high) {LINE} AS h1, lag(low) {LINE} AS l1, coalesce(lag(high, 2) {LINE}, lag(high) {LINE}) AS h2, coalesce(lag(low, 2) {LINE}, lag(low) {LINE}) AS l2, coalesce(lead(close) {LINE} >= close, true) AS rises FROM b),
s AS (SELECT symbol, rn, CASE WHEN rises THEN low ELSE high END AS sar, CASE WHEN rises THEN high ELSE low END AS peak, 0.02::DOUBLE AS a, rises AS up, false AS turn FROM w WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN flip THEN peak ELSE c END, CASE WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(peak, high) ELSE least(peak, low) END,
    CASE WHEN flip THEN 0.02 WHEN (up AND high > peak) OR (NOT up AND low < peak) THEN least(a + 0.02, 0.2) ELSE a END::DOUBLE, up <> flip, flip
  FROM (SELECT *, CASE WHEN up THEN low < c ELSE high > c END AS flip FROM (
    SELECT w.symbol, w.rn, w.high, w.low, s.peak, s.a, s.up, CASE WHEN s.up THEN least(s.sar + s.a * (s.peak - s.sar), w.l1, w.l2) ELSE greatest(s.sar + s.a * (s.peak - s.sar), w.h1, w.h2) END AS c
    FROM s JOIN w ON w.symbol = s.symbol AND w.rn = s.rn + 1)))""",
        recursive=True,
    )
)
def psar(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.parabolic(hourly(spark, folder)), **{c: c for c in ("psar_long", "psar_short", "psar_reversal")})


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('y')} AS ha_open, {r('hc')} AS ha_close FROM k JOIN s USING (symbol, rn)",
        more=f"""s AS (SELECT *, coalesce(lag(hc) {LINE}, hc) AS x FROM (SELECT *, (open + high + low + close) / 4 AS hc FROM b)), k AS (SELECT symbol, rn, x AS y FROM s WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, k.y + 0.5 * (s.x - k.y) FROM k JOIN s ON s.symbol = k.symbol AND s.rn = k.rn + 1)""",
        recursive=True,
    )
)
def heikin_ashi(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.heikin_ashi(hourly(spark, folder)), ha_open="ha_open", ha_close="ha_close")


@query(
    _sql(
        f"SELECT s.symbol, s.ts_s, {r('k.y')} AS fisher, {r('k.g')} AS fisher_signal FROM s JOIN k USING (symbol, rn)",
        more=f"""s AS (SELECT symbol, ts_s, rn, coalesce(CASE WHEN rn >= 9 THEN (mid - min(mid) {over(9)}) / nullif(max(mid) {over(9)} - min(mid) {over(9)}, 0) END, 0.5) AS p FROM (SELECT *, (high + low) / 2 AS mid FROM b)),
k AS (SELECT symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, NULL::DOUBLE AS g FROM (SELECT DISTINCT symbol FROM s)
  UNION ALL SELECT symbol, rn, x, y, coalesce(g + 1.0 / 3 * (y - g), y) FROM (SELECT symbol, rn, x, 0.5 * ln((1 + x) / (1 - x)) + 0.5 * y AS y, g FROM (
    SELECT s.symbol, s.rn, least(greatest(0.33 * 2 * (s.p - 0.5) + 0.67 * k.x, -0.999), 0.999) AS x, k.y, k.g FROM k JOIN s ON s.symbol = k.symbol AND s.rn = k.rn + 1)))""",
        recursive=True,
    )
)
def fisher_transform(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.fisher(hourly(spark, folder)), fisher="fisher", fisher_signal="fisher_signal")
