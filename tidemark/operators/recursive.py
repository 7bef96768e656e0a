"""Indicators that depend on their own last value.

Spark has no recursive window. Smoothed values y = w y + b are linear in the last
one, so they need none: rows are numbered, cut into runs of consecutive numbers,
and summed inside a run with weights w^-place; a run is so long that of all runs
before it only the last one counts, which a frame over run numbers sums. All of
it is windows within a symbol, as rolling columns are: whatever the number and
the depth of the series there is one scan and one exchange (`smoothed`). Only what is not
linear (the stop-and-reverse rules, the adaptive average, clipped filters) runs
in order over one symbol's columns, in an Arrow-fed pandas group with the columns
it needs; bars of one width are bounded, as trades are already aggregated.

Values are NULL until the seed is full. Rows in which an input is NULL have none,
and the recursion goes on after them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import by_symbol as symbol_line
from tidemark.operators.windows import bollinger, lag, rolling, true_range

#: The weight below which what lies before a run adds nothing.
NEGLIGIBLE = 2.0**-60


@dataclass(frozen=True)
class Smooth:
    """y = y + alpha (x - y), seeded with the mean of rows offset + 1 .. offset + n, or from `start` before the first row; alpha is below 1."""

    x: str
    alpha: float
    n: int = 1
    offset: int = 0
    start: float | None = None


def smoothed(rows: DataFrame, series: dict[str, Smooth], least_run: int = 64) -> DataFrame:
    """`rows` (symbol, ts, ...) with the series as columns. Rows in which an input of any of them is NULL don't count."""
    # A run is so long that the value before the last one weighs nothing.
    slowest = max(1 - q.alpha for q in series.values())
    run = max(least_run, math.ceil(math.log(NEGLIGIBLE) / math.log(slowest)))
    quick = {c: q for c, q in series.items() if -math.log(1 - q.alpha) * run > 600}
    if quick:  # their weights would leave the doubles in so long a run
        slow = {c: q for c, q in series.items() if c not in quick}
        return smoothed(smoothed(rows, slow, least_run), quick, least_run).select(*rows.columns, *series)
    there = F.lit(True)
    for q in series.values():
        there = there & F.col(q.x).isNotNull()
    so_far = symbol_line().rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("__in", there.cast("int")).withColumn("__rn", F.sum("__in").over(so_far))
    numbered = numbered.withColumns({"__run": F.floor(F.col("__rn") / run), "__at": F.col("__rn") % run})
    inside = lambda q: (F.col("__in") == 1) & F.col("__rn").between(q.offset + 1, q.offset + q.n)
    seeds = {f"__seed_{c}": F.avg(F.when(inside(q), F.col(q.x))).over(so_far) for c, q in series.items() if q.start is None}
    active, given = F.col("__in") == 1, {}
    for c, q in series.items():
        # Counted from `start`, if there is one, so that what lies before the first row is 0.
        x, first, w = F.col(q.x).cast("double") - (q.start or 0.0), q.offset + q.n, 1 - q.alpha
        seed = F.col(f"__seed_{c}") if q.start is None else q.alpha * x
        b = F.when(active & (F.col("__rn") == first), seed).when(active & (F.col("__rn") > first), q.alpha * x)
        given[f"__b_{c}"] = b * F.pow(F.lit(w), -F.col("__at"))
    weighed = numbered.withColumns(seeds).withColumns(given)
    within = W.partitionBy("symbol", "__run").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    run_before = W.partitionBy("symbol").orderBy("__run").rangeBetween(-1, -1)
    sums = {f"__sum_{c}": F.coalesce(F.sum(f"__b_{c}").over(within), F.lit(0.0)) for c in series}
    ends = {f"__end_{c}": F.coalesce(F.sum(f"__b_{c}").over(run_before) * (1 - q.alpha) ** (run - 1), F.lit(0.0)) for c, q in series.items()}
    out = {}
    for c, q in series.items():
        w = F.lit(1 - q.alpha)
        y = F.pow(w, F.col("__at")) * F.col(f"__sum_{c}") + F.pow(w, F.col("__at") + 1) * F.col(f"__end_{c}")
        out[c] = F.when(active & (F.col("__rn") >= q.offset + q.n), y + (q.start or 0.0))
    return weighed.withColumns(sums).withColumns(ends).withColumns(out).select(*rows.columns, *series)


def ema_series(x: str, n: int, offset: int = 0) -> Smooth:
    return Smooth(x, 2 / (n + 1), n, offset)


def wilder_series(x: str, n: int, offset: int = 0) -> Smooth:
    return Smooth(x, 1 / n, n, offset)


Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def by_symbol(bars: DataFrame, inputs: list[str], outputs: list[str], kernel: Kernel) -> DataFrame:
    """symbol, ts, the inputs and the kernel's outputs, computed in order of time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        made = kernel({c: pdf[c].to_numpy(np.float64) for c in inputs})
        out = pdf[["symbol", "ts", *inputs]].copy()
        for c in outputs:
            out[c] = made[c]
        return out

    given = bars.select("symbol", "ts", *inputs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields) + "".join(f", {c} double" for c in outputs)
    made = given.groupBy("symbol").applyInPandas(run, schema)
    return made.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in outputs})


def smooth(x: np.ndarray, alpha: float, n: int, offset: int = 0) -> np.ndarray:
    """y = y + alpha (x - y), seeded with the mean of x[offset : offset + n]; NaN before."""
    out = np.full(len(x), np.nan)
    first = offset + n - 1
    if len(x) <= first:
        return out
    y = x[offset : first + 1].mean()
    out[first] = y
    for i in range(first + 1, len(x)):
        y += alpha * (x[i] - y)
        out[i] = y
    return out


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """The same recursion seeded with the first value."""
    out = np.empty(len(x))
    y = np.nan
    for i, v in enumerate(x):
        y = v if np.isnan(y) else y + alpha * (v - y)
        out[i] = y
    return out


def wilder_of(x: np.ndarray, n: int, offset: int = 0) -> np.ndarray:
    return smooth(x, 1 / n, n, offset)


def ranges(v: dict[str, np.ndarray]) -> np.ndarray:
    h, l, c = v["high"], v["low"], v["close"]  # noqa: E741
    out = h - l
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    return out


def _bars(bars: DataFrame, *inputs: str) -> DataFrame:
    return bars.select("symbol", "ts", *inputs)


def ema(bars: DataFrame, n: int, name: str | None = None) -> DataFrame:
    return smoothed(_bars(bars, "close"), {name or f"ema{n}": ema_series("close", n)})


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    ranged = _bars(bars, "high", "low", "close").withColumn("__tr", true_range())
    return smoothed(ranged, {f"atr{n}": wilder_series("__tr", n)}).drop("__tr")


def natr(bars: DataFrame, n: int = 14) -> DataFrame:
    """The average range in per cent of the close."""
    return atr(bars, n).withColumn(f"natr{n}", 100 * F.try_divide(f"atr{n}", "close"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index; NULL where nothing moved."""
    step = F.col("close") - lag("close")
    moved = _bars(bars, "close").withColumns({"__up": F.greatest(step, step * 0), "__down": F.greatest(-step, step * 0)})
    out = smoothed(moved, {"__u": wilder_series("__up", n), "__d": wilder_series("__down", n)})
    both = F.col("__u") + F.col("__d")
    return out.select("symbol", "ts", "close", F.when(both > 0, 100 * F.col("__u") / both).alias(f"rsi{n}"))


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """plus_di, minus_di, adx by Wilder smoothing; seeds begin at the second bar."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    moved = _bars(bars, "high", "low", "close").withColumns({
        "__tr": F.when(up.isNotNull(), true_range()),
        "__p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "__m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })
    out = smoothed(moved, {"__t": wilder_series("__tr", n), "__u": wilder_series("__p", n), "__d": wilder_series("__m", n)})
    out = out.withColumns({"plus_di": F.try_divide(100 * F.col("__u"), "__t"), "minus_di": F.try_divide(100 * F.col("__d"), "__t")})
    p, m = F.col("plus_di"), F.col("minus_di")
    out = out.withColumn("__dx", F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).when(F.col("__t").isNotNull(), 0.0))
    return smoothed(out, {"adx": wilder_series("__dx", n)}).select("symbol", "ts", "high", "low", "close", "plus_di", "minus_di", "adx")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    # The fast average is seeded so that both begin with the same bar.
    both = smoothed(_bars(bars, "close"), {"__f": ema_series("close", fast, slow - fast), "__s": ema_series("close", slow)})
    line = both.select("symbol", "ts", "close", (F.col("__f") - F.col("__s")).alias("macd"))
    out = smoothed(line, {"macd_signal": ema_series("macd", signal)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def keltner(bars: DataFrame, n: int = 20, width: float = 2.0, atr_n: int = 10) -> DataFrame:
    given = _bars(bars, "high", "low", "close").withColumns({"__tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "__tr": true_range()})
    out = smoothed(given, {"kc_middle": Smooth("__tp", 2 / (n + 1)), "__reach": wilder_series("__tr", atr_n)})
    middle, reach = F.col("kc_middle"), width * F.col("__reach")
    return out.withColumns({"kc_upper": middle + reach, "kc_lower": middle - reach}).drop("__tp", "__tr", "__reach")


def squeeze(bars: DataFrame, n: int = 20, width: float = 1.5, span: int = 5) -> DataFrame:
    """squeeze_on (Bollinger bands inside the Keltner channel), _off (outside), _no (neither), _hist (smoothed distance from the middle; 0 before)."""
    low, middle, high = bollinger(n)
    top, bottom = rolling(F.max, "high", n), rolling(F.min, "low", n)
    away = F.col("close") - ((top + bottom) / 2 + middle) / 2
    given = _bars(bars, "high", "low", "close").withColumns({"__lo": low, "__hi": high, "__away": away, "__tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "__tr": true_range()})
    out = smoothed(given, {"__middle": Smooth("__tp", 2 / (n + 1)), "__reach": wilder_series("__tr", 10)})
    out = smoothed(out, {"__hist": Smooth("__away", 2 / (span + 1))})
    up, down = F.col("__middle") + width * F.col("__reach"), F.col("__middle") - width * F.col("__reach")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    on, off = flag((F.col("__lo") > down) & (F.col("__hi") < up)), flag((F.col("__lo") < down) & (F.col("__hi") > up))
    return out.select("symbol", "ts", "high", "low", "close", on.alias("squeeze_on"), off.alias("squeeze_off"), F.greatest(1 - on - off, F.lit(0)).alias("squeeze_no"), F.coalesce("__hist", F.lit(0.0)).alias("squeeze_hist"))


def kama(bars: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Adaptive average seeded with the first close; efficiency counts 0 until n changes are there."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def kernel(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        c = v["close"]
        moves = np.abs(np.diff(c, prepend=c[:1]))
        out, y = np.empty(len(c)), c[0] if len(c) else np.nan
        for i in range(len(c)):
            path = moves[i - n + 1 : i + 1].sum() if i >= n else 0.0
            e = abs(c[i] - c[i - n]) / path if path > 0 else 0.0
            y += (e * (a - b) + b) ** 2 * (c[i] - y)
            out[i] = y
        return {"kama": out}

    return by_symbol(bars, ["close"], ["kama"], kernel)


def supertrend(bars: DataFrame, n: int = 10, width: float = 3.0) -> DataFrame:
    """Bands that only tighten while the close before lies inside them; the line is the band on the trend's side.

    The first bar's trend is up, and the range counts 0 until its average is seeded.
    """

    def kernel(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        c, reach = v["close"], np.nan_to_num(wilder_of(ranges(v), n))
        mid = (v["high"] + v["low"]) / 2
        tops, bottoms = mid + width * reach, mid - width * reach
        line, way = np.empty(len(c)), np.empty(len(c))
        top, bottom, trend, before = np.inf, -np.inf, 1.0, np.nan
        for i, (up, down) in enumerate(zip(tops, bottoms, strict=True)):
            top = min(up, top) if before < top else up
            bottom = max(down, bottom) if before > bottom else down
            before = c[i]
            if i and (before < bottom if trend > 0 else before > top):
                trend = -trend
            line[i], way[i] = (bottom if trend > 0 else top), trend
        return {"supertrend": line, "trend": way}

    return by_symbol(bars, ["high", "low", "close"], ["supertrend", "trend"], kernel)


def parabolic(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """Stop and reverse: psar_long, psar_short (0 on the side that is not held), psar_reversal (1 to long, -1 to short).

    The first side is long unless the second close is below the first. The stop never passes the two bars before.
    """

    def kernel(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        h, l, c = v["high"], v["low"], v["close"]  # noqa: E741
        sides, turned = np.zeros((2, len(h))), np.zeros(len(h))
        up = len(c) < 2 or bool(c[1] >= c[0])
        with_, against = (h, l) if up else (l, h)
        stop, peak, pace = (against[0], with_[0], step) if len(h) else (0.0, 0.0, step)
        for i in range(len(h)):
            if i:
                stop += pace * (peak - stop)
                recent = against[max(i - 2, 0) : i]
                stop = min(stop, recent.min()) if up else max(stop, recent.max())
                if against[i] < stop if up else against[i] > stop:
                    up, stop, peak, pace = not up, peak, against[i], step
                    with_, against = against, with_
                    turned[i] = 1 if up else -1
                elif with_[i] > peak if up else with_[i] < peak:
                    peak, pace = with_[i], min(pace + step, most)
            sides[0 if up else 1, i] = stop
        return {"psar_long": sides[0], "psar_short": sides[1], "psar_reversal": turned}

    return by_symbol(bars, ["high", "low", "close"], ["psar_long", "psar_short", "psar_reversal"], kernel)


def heikin_ashi(bars: DataFrame) -> DataFrame:
    mean = _bars(bars, "open", "high", "low", "close").withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    out = smoothed(mean.withColumn("__x", F.coalesce(lag("ha_close"), F.col("ha_close"))), {"ha_open": Smooth("__x", 0.5)})
    return out.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")}).drop("__x")


def fisher(bars: DataFrame, n: int = 9) -> DataFrame:
    """Two zero-seeded filters over the place in the n-bar range (one half where flat or short)."""

    def kernel(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        mid = (v["high"] + v["low"]) / 2
        s = pd.Series(mid)
        top, bottom = s.rolling(n).max().to_numpy(), s.rolling(n).min().to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            place = (mid - bottom) / (top - bottom)
        place = np.where(np.isfinite(place), place, 0.5)
        out, x, y = np.empty(len(mid)), 0.0, 0.0
        for i, p in enumerate(place):
            x = min(max(0.33 * 2 * (p - 0.5) + 0.67 * x, -0.999), 0.999)
            y = 0.5 * np.log((1 + x) / (1 - x)) + 0.5 * y
            out[i] = y
        return {"fisher": out, "fisher_signal": ewm(out, 2 / 6)}

    return by_symbol(bars, ["high", "low"], ["fisher", "fisher_signal"], kernel)


def equity_curve(trades: DataFrame, risk: float = 0.01, most_at_risk: float = 0.06, start: float = 10_000.0) -> DataFrame:
    """trade_id, taken, equity, drawdown: trades in order of opening, each risking a share of the equity then held.

    A trade is skipped while open trades risk `most_at_risk` together. The state is
    one account's, so it needs one sequence: an account's closed trades, not market
    data. Accounts (column `account`) are dealt to tasks, each sorted by account and
    opening; a task walks through its rows once and holds one account's open trades,
    so many small accounts cost no more than a few large ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, known = None, False
        for batch in batches:
            taken, worth, down = [], [], []
            names = batch.column("account").to_pylist()
            for a, opened, trade_id, closed, r in zip(names, *[batch.column(c).to_pylist() for c in ("opened", "trade_id", "closed", "r")], strict=True):
                if not known or a != account:
                    account, known, equity, peak, held = a, True, start, start, []
                if held and min(held)[0] <= opened:
                    for x in sorted(h for h in held if h[0] <= opened):
                        equity += x[3]
                        peak = max(peak, equity)
                    held = [h for h in held if h[0] > opened]
                takes = len(held) * risk + risk <= most_at_risk + 1e-12
                if takes:
                    held.append((closed, trade_id, risk, r * risk * equity))
                taken.append(int(takes))
                worth.append(equity)
                down.append(equity / peak - 1)
            yield pa.RecordBatch.from_arrays([batch.column("account"), batch.column("trade_id"), pa.array(taken, pa.int32()), pa.array(worth, pa.float64()), pa.array(down, pa.float64())], names=["account", "trade_id", "taken", "equity", "drawdown"])

    sequences = trades.select("account", "trade_id", "opened", "closed", "r").repartition("account").sortWithinPartitions("account", "opened", "trade_id", "closed", "r")
    return sequences.mapInArrow(run, "account string, trade_id long, taken int, equity double, drawdown double")


def kdj(bars: DataFrame, n: int = 9) -> DataFrame:
    """k and d smooth the place in the n-bar range by thirds from 50; j = 3 k - 2 d. A flat range counts 50."""
    w = symbol_line().rowsBetween(1 - n, 0)
    top, bottom = F.max("high").over(w), F.min("low").over(w)
    place = F.when(F.count("close").over(w) == n, F.when(top > bottom, 100 * (F.col("close") - bottom) / (top - bottom)).otherwise(50.0))
    first = smoothed(_bars(bars, "high", "low", "close").withColumn("__place", place), {"k": Smooth("__place", 1 / 3, start=50.0)})
    return smoothed(first, {"d": Smooth("k", 1 / 3, start=50.0)}).withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("__place")


def cusum(bars: DataFrame, value: str, span: int = 96, bound: float = 50.0) -> DataFrame:
    """Running sum of the value less its exponential mean with full weights (adjusted), within bounds; NULL counts 0."""

    def kernel(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s = pd.Series(v[value])
        return {"cusum": (s - s.ewm(span=span, adjust=True).mean()).fillna(0.0).cumsum().clip(-bound, bound).to_numpy()}

    return by_symbol(bars, [value], ["cusum"], kernel)


def trix_ppo(bars: DataFrame, n: int = 14, fast: int = 12, slow: int = 26) -> DataFrame:
    """trix: change of the triple average in percent; ppo: fast less slow average over slow, in percent."""
    out = smoothed(_bars(bars, "close"), {"__f": ema_series("close", fast, slow - fast), "__s": ema_series("close", slow), "__1": ema_series("close", n)})
    out = smoothed(smoothed(out, {"__2": ema_series("__1", n)}), {"__3": ema_series("__2", n)})
    trix = 100 * (F.try_divide("__3", lag("__3")) - 1)
    return out.select("symbol", "ts", "close", trix.alias("trix"), (100 * F.try_divide(F.col("__f") - F.col("__s"), "__s")).alias("ppo"))
