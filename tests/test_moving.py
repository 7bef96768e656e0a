"""Moving profiles against profiles that are made anew at each bar."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import moving as M

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
BARS = "symbol string, ts timestamp, high double, low double, close double, volume double"


def anew(a, b, v, n):
    out = []
    for i in range(len(a)):
        if i < n - 1:
            out.append((-1, -1, -1))
            continue
        w = range(i - n + 1, i + 1)
        least, most = min(a[j] for j in w), max(b[j] for j in w)
        hist = [sum(v[j] for j in w if a[j] <= k <= b[j]) for k in range(most + 1)]
        poc = max(range(least, most + 1), key=lambda k: (hist[k], -k))
        lo = hi = poc
        while sum(hist[lo : hi + 1]) < 0.7 * sum(hist):
            left, right = (hist[lo - 1] if lo > least else -1), (hist[hi + 1] if hi < most else -1)
            lo, hi = (lo, hi + 1) if right >= left else (lo - 1, hi)
        out.append((poc, lo, hi))
    return out


@pytest.mark.parametrize("n", [1, 7, 30])
def test_sliding_is_making_anew(n):
    rng = np.random.default_rng(n)
    a = np.abs(rng.integers(0, 20, 120))
    b = a + rng.integers(0, 9, 120)
    v = rng.integers(0, 5, 120)
    assert [tuple(x) for x in M.slide(a, b, v, n).tolist()] == anew(a.tolist(), b.tolist(), v.tolist(), n)


def frame(spark, n=260):
    rng = np.random.default_rng(1)
    x = 100 * np.exp(rng.normal(0, 0.01, n).cumsum())
    up = rng.uniform(0, 0.02, n)
    rows = [(s, T0 + dt.timedelta(hours=i), float(p * (1 + u)), float(p * (1 - u)), float(p), float(i % 7)) for s in "AB" for i, (p, u) in enumerate(zip(x, up, strict=True))]
    return spark.createDataFrame([*rows, ("A", T0 + dt.timedelta(hours=9999), None, 1.0, 1.0, 1.0), ("C", T0, 2.0, 1.0, 1.5, 1.0)], BARS)


def test_stretches_side_by_side_are_one_line(spark, monkeypatch):
    bars = frame(spark)
    key = ["symbol", "ts"]
    whole = sorted(map(repr, M.moving_profile(bars, 12).collect()))
    monkeypatch.setattr(M, "STRETCH", 48)
    cut = M.moving_profile(bars, 12)
    assert sorted(map(repr, cut.collect())) == whole and cut.select(*key).distinct().count() == len(whole) == 521
    assert cut.where("poc IS NOT NULL").count() == 2 * (260 - 11) and cut.where("prior_poc IS NOT NULL").count() == 2 * (260 - 23)


def test_reading_by_hand(spark):
    rows = [(100.0, 101.0, 103.0, 99.0, 100.9, False), (104.0, 101.0, 103.0, 99.0, 101.0, True), (98.0, 100.0, 103.0, 99.0, 101.0, False), (100.0, 100.0, 103.0, 99.0, None, None)]
    df = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), *r) for i, r in enumerate(rows)], "symbol string, ts timestamp, close double, poc double, vah double, val double, prior_poc double, touched boolean")
    got = [(r.migrated, r.naked_poc, r.direction) for r in M.profile_reading(df).orderBy("ts").collect()]
    assert got == [("flat", 100.9, None), ("flat", None, "long"), ("down", 101.0, "short"), (None, None, None)]
    slow = df.select("symbol", "ts", F.lit(100.0).alias("poc"), F.lit(105.0).alias("vah"), F.lit(95.0).alias("val"))
    a = M.accumulation(df, slow).orderBy("ts").collect()
    # Narrowed to 0.40 (0.35), stayed (0.25), a quarter up the area (0.20), within 1.5 % of the control (0.12).
    assert (a[0].contraction, a[0].accumulation) == (pytest.approx(4 / 101 * 10), pytest.approx(0.92))
