"""Bars of several frames seen from one, without what has not closed."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import multiframe as M

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
ROWS = "symbol string, ts timestamp, x double"


def test_a_bar_is_seen_when_it_has_closed(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    fine = spark.createDataFrame([("A", at(15 * i), float(i)) for i in range(9)] + [("B", at(0), 0.0), (None, at(0), 1.0), ("A", None, 1.0)], ROWS)
    hour = spark.createDataFrame([("A", at(0), 100.0), ("A", at(60), 101.0), ("A", None, 9.0)], ROWS)
    half = spark.createDataFrame([("A", at(0), 50.0), ("A", at(30), None)], ROWS)
    got = M.seen_closed(fine, 900, {"hour": (hour, 3600), "half": (half, 1800)}).where("symbol = 'A'").orderBy("ts")
    rows = [(r.x, r.hour and r.hour.x, r.half and (r.half.ts is not None, r.half.x)) for r in got.collect()]
    # The fine bar from 45 to 60 closes with the hour, and sees it. A row of the half hour counts though its value is NULL.
    assert rows == [(0.0, None, None), (1.0, None, (True, 50.0)), (2.0, None, (True, 50.0)), (3.0, 100.0, (True, None)), (4.0, 100.0, (True, None)), (5.0, 100.0, (True, None)), (6.0, 100.0, (True, None)), (7.0, 101.0, (True, None)), (8.0, 101.0, (True, None))]
    assert M.seen_closed(fine, 900, {"hour": (hour.limit(0), 3600)}).where("symbol = 'B'").collect()[0].hour is None


def walk(spark, n=3000):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(0, 0.01, n).cumsum()) * 100
    rows = [("A", i, T0 + dt.timedelta(minutes=15 * i), float(v), 1.0, i % 2 == 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, trade_id long, ts timestamp, price double, qty double, is_buy boolean")


def scenarios(trades):
    frames = {f: (M.snapshots(B.bars(trades, w)), s) for f, w, s in (("m15", "15 minutes", 900), ("h1", "1 hour", 3600), ("h4", "4 hours", 14400))}
    fine = B.bars(trades, "30 minutes").select("symbol", "ts", "close", F.col("low").alias("support"), F.lit(None).cast("double").alias("resistance"))
    seen = M.senior_bias(M.seen_closed(fine, 1800, frames), {"h4": 0.6, "h1": 0.4})
    return M.confluence(seen, "close", "m15", ["h4", "h1", "m15"], {"h4": 0.6, "h1": 0.4})


def test_nothing_comes_from_the_future(spark):
    trades = walk(spark)
    cut = T0 + dt.timedelta(minutes=15 * 2501)  # amid a bar of every coarser frame
    columns = ["ts", "htf_bias", "htf_net", "long_score", "short_score", "atr", "dominant", "long_stop", "short_stop"]
    whole = {r.ts: r for r in scenarios(trades).select(columns).collect()}
    past = scenarios(trades.where(F.col("ts") < F.lit(cut))).select(columns).where(F.col("ts") + F.expr("INTERVAL 30 MINUTES") <= F.lit(cut)).collect()
    assert len(past) == 1250
    for r in past:
        assert all(a == b or b == pytest.approx(a, rel=1e-12) for a, b in zip(r, whole[r.ts], strict=True))
    assert {r.htf_bias for r in past} == {"unknown", "long", "short", "neutral"} and {r.dominant for r in past} == {"long", "short", "neutral"}


def test_scenarios_by_hand(spark):
    frame = lambda trend, rsi, atr, warm=True: (trend, rsi, atr, warm)
    kind = "struct<trend: string, rsi14: double, atr14: double, warm: boolean>"
    rows = [
        (100.0, 98.0, None, frame("bull", 70.0, 1.0), frame("bull", None, 2.0), frame("neutral", None, None), frame("bear", 55.0, None)),
        (100.0, 99.9, 100.2, None, None, None, None),
        (100.0, None, None, frame("bear", 30.0, 0.1, False), None, None, frame("bull", 30.0, 9.0)),
    ]
    df = spark.createDataFrame(rows, f"p double, support double, resistance double, `1w` {kind}, `1d` {kind}, `4h` {kind}, quick {kind}")
    a, b, c = M.confluence(M.senior_bias(df), "p", "quick", ["4h", "1d", "1w"]).collect()
    assert (a.htf_bias, round(a.htf_net, 3), a.long_score, a.short_score, a.dominant) == ("long", 0.8, 800, 67, "long")
    assert (a.atr, a.long_stop, a.short_stop, a.atr_assumed) == (2.0, 98.0, 104.0, False)
    assert (b.htf_bias, b.htf_total, b.long_score, b.short_score, b.dominant, b.atr_assumed, b.atr) == ("unknown", 0, 133, 133, "neutral", True, 1.0)
    assert (b.long_stop, b.short_stop) == (99.0, 101.0)
    # A cold frame has no vote in the bias; its trend still counts for the scenario.
    assert (c.htf_bias, c.short_score, c.dominant, c.long_stop) == ("unknown", 1000, "short", 99.5)
