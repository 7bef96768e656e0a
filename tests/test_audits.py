"""Ends of scenarios, faults of bars, skew between frames, pennants and small measures, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import candidates as C
from tidemark.operators import invalidation as I
from tidemark.operators import recursive as K
from tidemark.operators import stats as S
from tidemark.operators import windows as R

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def hour(h):
    return T0 + dt.timedelta(hours=h)


def test_what_ends_a_scenario(spark):
    path = [(10.0, 10.0, 1.0)] * 20 + [(10.0, 9.9, 2.0), (9.9, 9.4, 1.0), (9.4, 9.0, 1.0), (9.0, 8.7, 1.0)]
    bars = spark.createDataFrame([("A", hour(i), o, max(o, c), min(o, c), c, v) for i, (o, c, v) in enumerate(path)], BARS)
    schema = "scenario_id string, symbol string, decided timestamp, direction string, entry_lo double, entry_hi double, stop double, zone_lo double, zone_hi double"
    rows = [("stop", "A", hour(20), "long", 9.8, 10.2, 9.1, 9.4, 9.6), ("no stop", "A", hour(21), "long", 9.8, 10.2, 9.9, None, None), ("short", "A", hour(20), "short", 9.8, 10.2, 10.5, 10.0, 10.0), ("short", "A", hour(20), "short", 9.8, 10.2, 10.5, 10.0, 10.0), ("lost", None, hour(1), "long", 1.0, 1.0, None, None, None), ("after", "A", hour(90), "long", 9.8, 10.2, None, None, None)]
    got = {r.scenario_id: r for r in I.first_invalidations(spark.createDataFrame(rows, schema), bars, 3600, 36_000).collect()}
    at = lambda h: int(hour(h + 1).timestamp())
    a = got["stop"]
    assert (a.level, a.zone_level, a.volume_s, a.zone_s, a.structure_s, a.ended_s, a.reason) == (9.1, 9.5, at(20), at(21), at(22), at(20), "volume")
    # A stop inside the band is none: the level lies half a per cent below. Volume was loud before the decision only.
    assert (got["no stop"].level, got["no stop"].zone_level, got["no stop"].structure_s, got["no stop"].volume_s, got["no stop"].reason) == (pytest.approx(9.751), None, at(21), None, "structure")
    assert (got["short"].level, got["short"].zone_level, got["short"].reason) == (10.5, None, None) and len(got) == 5
    assert got["lost"].reason is None and got["after"].ended_s is None


def test_faults_of_bars(spark):
    rows = [("A", hour(0), 1.0, 2.0, 0.5, 1.5, 1.0), ("A", hour(0), 1.0, 2.0, 0.5, 1.5, 1.0), ("A", hour(1) + dt.timedelta(seconds=1), 1.0, 0.5, 0.6, 0.55, 1.0), ("A", hour(5), 3.0, 2.0, 0.0, 1.0, -1.0), ("A", hour(6), None, 2.0, 1.0, 1.0, 1.0), (None, hour(1), 1.0, 1.0, 1.0, 1.0, 1.0), ("A", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    (r,) = B.bar_faults(spark.createDataFrame(rows, BARS), 3600).collect()
    assert (r.bars, r.repeats, r.gaps, r.off_grid, r.high_below_low, r.outside, r.not_positive, r.negative_volume, r.nulls) == (5, 1, 1, 1, 1, 2, 1, 1, 1)


def test_frames_that_begin_late(spark):
    make = lambda s, h: spark.createDataFrame([(s, hour(h), 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    frames = {"4h": (make("A", 0).unionAll(make("B", 0)), 14_400), "1h": (make("A", 9).unionAll(make("B", 8)), 3600), "15m": (make("A", 10), 900)}
    assert sorted(tuple(r) for r in B.frame_skew(frames).collect()) == [("A", "15m", "4h", 36_000), ("A", "1h", "4h", 32_400)]


def test_a_pennant_needs_a_narrowing_its_touches_and_the_price_at_the_edge(spark):
    n, rows = C.PENNANT_BARS, []
    for i in range(n):
        swing = (1, 0.5, -0.5, -1, -0.5, 0.5)[i % 6] * (1.2 - i / n)
        rows.append(("A", hour(i), 100 + swing, 100.1 + swing, 99.9 + swing, 100 + swing, 1.0))
    bars = spark.createDataFrame(rows, BARS)
    last_low = min((r[4], -k) for k, r in enumerate(rows[-9:-3]))[0]
    now = lambda price: spark.createDataFrame([("A", price, 0.001)], "symbol string, price double, delta double")
    bias = spark.createDataFrame([("A", "long")], "symbol string, bias string")
    narrow = lambda a, b: spark.createDataFrame([("A", a, b)], "symbol string, narrow boolean, wedge boolean")
    lows = [r.price for r in C.G.pivots(C.G.newest(bars, n)).where("kind = 'low'").orderBy("i").collect()]
    (hit,) = C.pennant(narrow(True, False), bars, now(lows[-1]), bias).collect()
    assert (hit.candidate, hit.direction, hit.entry) == ("pennant", "long", lows[-1]) and len(lows) > 3 and last_low <= lows[-1]
    assert C.pennant(narrow(True, False), bars, now(lows[-1] * 1.01), bias).count() == 0
    assert C.pennant(narrow(True, True), bars, now(lows[-1]), bias).count() == C.pennant(narrow(False, False), bars, now(lows[-1]), bias).count() == 0


def test_small_measures(spark):
    rows = [("A", hour(i), 10.0, 10.0 + i, 9.0, 9.5 + i / 2, 1.0) for i in range(20)]
    bars = spark.createDataFrame(rows, BARS)
    out = R.with_stochastic(bars, 5, 3).withColumn("d", R.delta("close", 4)).orderBy("ts").collect()
    assert out[5].stoch_d is None and out[6].stoch_d == pytest.approx(sum(r.stoch_k for r in out[4:7]) / 3) and out[3].d is None and out[4].d == 2.0
    last = K.natr(bars, 3).orderBy(F.desc("ts")).first()
    assert last.natr3 == pytest.approx(100 * last.atr3 / last.close)
    pairs = spark.createDataFrame([("k", 1.0, 2.0, 5.0), ("k", 2.0, 4.0, 5.0), ("k", 3.0, None, 5.0), ("k", 4.0, 8.0, 5.0)], "k string, a double, b double, c double")
    got = {(r.a, r.b): (r.n, r.r) for r in S.pearson(pairs, "k", ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (3, pytest.approx(1.0)), ("a", "c"): (4, None), ("b", "c"): (3, None)}
