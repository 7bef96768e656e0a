"""Volume profiles that move: at each bar the profile of the last n bars, its control price and value area.

Prices have a fixed grid of even log steps, so the histogram of a bar is that of
the bar before with the newest bar added and the oldest taken off. Volumes are
added in whole millionths: what is taken off is exactly what was added. A symbol's
bars are cut into stretches that begin with the bars a window needs from before,
so groups are bounded and one symbol's stretches run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import by_symbol

#: Share of the value area, per cent of a shift of the control price, per cent from the price of a naked one.
SHARE, SHIFT_PCT, NAKED_PCT = 0.7, 0.15, 0.2
STRETCH = 4096
_FIELDS = "symbol string, ts timestamp, poc double, vah double, val double, prior_poc double, touched boolean"


def area(hist: np.ndarray, poc: int, least: int, most: int, total: int, share: float = SHARE) -> tuple[int, int]:
    """First and last bucket: grown within least..most from the control bucket by the fuller neighbour (the upper of equals) up to the share."""
    lo = hi = poc
    held = int(hist[poc])
    while held < share * total and (lo > least or hi < most):
        left, right = int(hist[lo - 1]) if lo > least else -1, int(hist[hi + 1]) if hi < most else -1
        if right >= left:
            hi, held = hi + 1, held + right
        else:
            lo, held = lo - 1, held + left
    return lo, hi


def slide(first: np.ndarray, last: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """Rows (control, first and last bucket of the value area) for each bar with n bars up to it; -1 before. Buckets begin at 0."""
    out = np.full((len(first), 3), -1, dtype=np.int64)
    hist = np.zeros(int(last.max(initial=0)) + 1, dtype=np.int64)
    held = (last - first + 1) * part
    total = np.cumsum(held)
    for i in range(len(first)):
        hist[first[i] : last[i] + 1] += part[i]
        if i >= n:
            hist[first[i - n] : last[i - n] + 1] -= part[i - n]
        if i >= n - 1:
            within = slice(i - n + 1, i + 1)
            least, most = int(first[within].min()), int(last[within].max())
            poc = least + int(hist[least : most + 1].argmax())
            out[i] = (poc, *area(hist, poc, least, most, int(total[i] - (total[i - n] if i >= n else 0))))
    return out


def moving_profile(bars: DataFrame, n: int = 96, step: float = 0.005) -> DataFrame:
    """symbol, ts, close, poc, vah, val of the last n bars, prior_poc (of the n before), touched (a bar since then met it).

    step: the grid's log step; a bar's volume lies evenly on the buckets from its low to its high. Of equally full buckets
    the lowest is the control. NULL before n bars (prior_poc: 2 n). Bars without prices above 0 or volume don't count.
    """
    length, warm = max(STRETCH, 4 * n), 2 * n - 1
    bucket = lambda c: F.floor(F.log(c) / step)
    rows = bars.where("low > 0 AND high >= low AND volume >= 0").select("symbol", "ts", "high", "low", "close", "volume")
    rows = rows.withColumn("__i", F.row_number().over(by_symbol()) - 1).withColumns({"__a": bucket("low"), "__b": bucket("high"), "__part": F.floor(F.col("__i") / length)})
    rows = rows.withColumn("__v", F.round(F.col("volume") / (F.col("__b") - F.col("__a") + 1) * 1_000_000).cast("long"))
    ahead = F.col("__i") % length >= length - warm
    spread = rows.withColumn("__own", F.explode(F.when(ahead, F.array("__part", F.col("__part") + 1)).otherwise(F.array("__part"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        a, b, v = (pdf[c].to_numpy(np.int64) for c in ("__a", "__b", "__v"))
        base = int(a.min())
        made = slide(a - base, b - base, v, n)
        there = made[:, 0] >= 0
        price = lambda k, more: np.where(there, np.exp((made[:, k] + base + more) * step), np.nan)
        poc = price(0, 0.5)
        prior = np.full(len(pdf), np.nan)
        prior[n:] = poc[:-n] if len(pdf) > n else []
        low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
        touched = [bool(((low[i - n + 1 : i + 1] <= p) & (high[i - n + 1 : i + 1] >= p)).any()) if p == p else None for i, p in enumerate(prior.tolist())]
        out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "ts": pdf["ts"].to_numpy(), "poc": poc, "vah": price(2, 1), "val": price(1, 0), "prior_poc": prior, "touched": pd.array(touched, dtype="boolean")})
        return out[(pdf["__part"] == pdf["__own"]).to_numpy()]

    schema = _FIELDS.replace("timestamp", bars.schema["ts"].dataType.simpleString())
    found = spread.select("symbol", "ts", "high", "low", "__a", "__b", "__v", "__part", "__own").groupBy("symbol", "__own").applyInPandas(run, schema)
    null = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("poc", "vah", "val", "prior_poc")}
    return rows.select("symbol", "ts", "close").join(found.withColumns(null), ["symbol", "ts"])


def migration(poc: Column, prior: Column) -> Column:
    change = (poc - prior) / prior * 100
    return F.when(prior > 0, F.when(change > SHIFT_PCT, "up").when(change < -SHIFT_PCT, "down").otherwise("flat"))


def profile_reading(profile: DataFrame) -> DataFrame:
    """profile with migrated (up, down, flat), naked_poc (the prior control price, untouched and off the price) and direction (beyond the value area)."""
    off = F.abs(F.col("prior_poc") - F.col("close")) / F.col("close") > NAKED_PCT / 100
    direction = F.when(F.col("close") > F.col("vah"), "long").when(F.col("close") < F.col("val"), "short")
    return profile.withColumns({"migrated": migration(F.col("poc"), F.col("prior_poc")), "naked_poc": F.when(~F.col("touched") & off, F.col("prior_poc")), "direction": direction})


def accumulation(quick: DataFrame, slow: DataFrame) -> DataFrame:
    """symbol, ts, width_pct, contraction, accumulation (0..1): a value area that narrows against the slower profile's, a control price that stays, a price low in the area and near the control.

    Both are moving profiles of the same bars.
    """
    width = lambda p: F.when((F.col(f"{p}vah") > F.col(f"{p}val")) & (F.col(f"{p}poc") > 0), (F.col(f"{p}vah") - F.col(f"{p}val")) / F.col(f"{p}poc") * 100)
    both = profile_reading(quick).join(slow.select("symbol", "ts", *[F.col(c).alias(f"slow_{c}") for c in ("poc", "vah", "val")]), ["symbol", "ts"], "left")
    both = both.withColumn("width_pct", width("")).withColumn("contraction", F.try_divide("width_pct", width("slow_")))
    c, place = F.col("contraction"), (F.col("close") - F.col("val")) / (F.col("vah") - F.col("val"))
    # Fixed values.
    score = F.when(c < 0.70, 0.35).when(c < 0.85, 0.22).when(c < 0.95, 0.10).otherwise(0.0)
    score = score + F.when(F.col("migrated") == "flat", 0.25).when(F.col("migrated").isNull() & F.col("poc").isNotNull(), 0.08).otherwise(0.0)
    score = score + F.when(place.between(0, 0.35), 0.20).otherwise(0.0) + F.when((F.col("vah") > F.col("val")) & (F.abs(F.col("close") - F.col("poc")) / F.col("poc") * 100 <= 1.5), 0.12).otherwise(0.0)
    return both.select("symbol", "ts", "width_pct", "contraction", F.when(score > 0, F.least(F.lit(1.0), score)).alias("accumulation"))
