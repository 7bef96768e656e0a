"""Paths of decisions: by hand, and as a stream against the batch join."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as D
from tidemark.streaming import decisions as DS
from tidemark.streaming import live

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
MADE = "candidate_id string, symbol string, decided timestamp, direction string, entry double, atr double, gate string"
BARS = "symbol string, ts timestamp, high double, low double, close double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_path_by_hand(spark):
    made = spark.createDataFrame([("a", "X", at(0), "long", 100.0, 2.0, "g"), ("b", "X", at(0), "short", 100.0, 2.0, "g"), ("c", "X", at(0), "long", 100.0, None, "g"), ("d", "Y", at(0), "long", 1.0, 1.0, "g"), ("e", None, None, "long", 1.0, 1.0, "g"), ("a", "X", at(0), "long", 100.0, 2.0, "g")], MADE)
    bars = spark.createDataFrame([("X", at(-5), 500.0, 1.0, 9.0), ("X", at(0), 101.0, 99.0, 100.5), ("X", at(15), 103.0, 96.0, 102.0), ("X", at(60), 104.0, 101.0, 103.0), ("X", at(1440), 104.0, 90.0, 91.0), ("X", at(1441), 900.0, 90.0, 91.0)], BARS)
    got = {r.candidate_id: r for r in D.forward_paths(made, bars).collect()}
    a, b = got["a"], got["b"]
    assert len(got) == 5 and (a.bars, a.mfe_atr, a.mfe_min, a.mae_atr, a.mae_min) == (4, 2.0, 60.0, -5.0, 1440.0)
    # Both sides of one range in one bar: what goes against counts first.
    assert (a.touch_0_5, a.side_0_5, a.touch_1_5, a.side_1_5, a.touch_2_0, a.side_2_0, a.touch_5_0, a.side_5_0) == (0.0, -1, 15.0, -1, 15.0, -1, 1440.0, -1)
    assert (b.side_2_0, b.touch_2_0, b.mae_atr, b.mae_min) == (1, 15.0, -2.0, 60.0) and (a.ret_15_atr, a.ret_240_atr, a.ret_1440_pct) == (1.0, -4.5, pytest.approx(-9.0))
    for k in "cde":
        assert got[k].bars == 0 and got[k].mfe_atr is None and got[k].side_0_5 is None


def test_pending_decisions(spark):
    made = spark.createDataFrame([("a", "X", at(0), "long", 1.0, 1.0, "g"), ("b", "X", at(0), "long", 1.0, 1.0, "g"), ("c", "X", at(60), "long", 1.0, 1.0, "g"), ("a", "X", at(5), "long", 1.0, 1.0, "g")], MADE)
    paths = spark.createDataFrame([("b",)], "candidate_id string")
    assert [r.candidate_id for r in D.pending(made, paths, F.lit(at(24 * 60 + 10))).collect()] == ["a"]
    assert D.pending(made, paths, F.lit(at(24 * 60 + 4))).count() == 0


def test_stream_is_the_batch_join_and_late_decisions_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    bars = [(s, at(5 * i), 100 + x + 1, 100 + x - 1, 100 + x) for s in "XY" for i, x in enumerate(rng.normal(0, 3, 600).cumsum().tolist())]
    made = [(f"{s}{i}", s, at(50 * i), "long" if i % 2 else "short", 100.0, 2.0, "g") for s in "XYZ" for i in range(40)]
    b, d = spark.createDataFrame(bars, BARS), spark.createDataFrame(made, MADE)
    far = at(100_000)
    late = ("late", "X", at(0), "long", 100.0, 2.0, "g")
    steps = [(F.col("ts") < F.lit(at(1000)), F.col("decided") < F.lit(at(900)), []), (F.col("ts") >= F.lit(at(1000)), F.col("decided") >= F.lit(at(900)), []), (None, None, [("end", "Q", far, "long", 1.0, 1.0, "g")]), (None, None, [late, ("end2", "Q", far, "long", 1.0, 1.0, "g")])]
    for folder in "bd":
        (tmp_path / folder).mkdir()
    df_b = live.stream(spark, str(tmp_path / "b"), b.schema)
    df_d = live.stream(spark, str(tmp_path / "d"), d.schema)
    for when_b, when_d, more in steps:
        (b.where(when_b) if when_b is not None else spark.createDataFrame([("Q", far, 1.0, 1.0, 1.0)], BARS)).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
        (d.where(when_d) if when_d is not None else spark.createDataFrame(more, MADE)).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        out = live.replayed(DS.decision_paths(df_d, df_b, 6 * 3600), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted((tuple(r) for r in D.forward_paths(d, b, 6 * 3600).collect()), key=repr)
    assert got == want and len(got) == 120 and sum(r[6] == 0 for r in got) >= 40
