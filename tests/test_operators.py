"""Small cases with known results, and properties of the operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.operators import flow as L
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.operators import recursive as K
from tidemark.operators import stats
from tidemark.operators import windows as R
from tidemark.operators import zones as Y
from tidemark.plans.prepare import prepare, resolved
from tidemark.sources import tables

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, taker_buy double, trades long"
T0 = dt.datetime(2024, 1, 1)


def bars(spark, closes, symbol="A", volume=1.0):
    rows = [(symbol, T0 + dt.timedelta(hours=i), c, c + 1, c - 1, c, volume, c * volume, volume / 2, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").select(name).collect()]


def test_null_and_nan_stay_unmeasured(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (None, 2.0), (float("inf"), 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.finite("a")).collect()] == [1.0, None, None, None]
    assert [r[0] for r in df.select(S.ratio("a", "b")).collect()][0] is None
    assert [r[0] for r in df.select(S.finite_or("a", 7)).collect()] == [1.0, 7.0, 7.0, 7.0]


def test_epoch_units(spark):
    df = spark.createDataFrame([(1704067200,), (1704067200000,), (1704067200000000,), (1704067200000000000,)], "v long")
    assert {r[0] for r in df.select(F.unix_seconds(S.epoch_time(F.col("v")))).collect()} == {1704067200}


def test_ticks(spark):
    df = spark.createDataFrame([(1.2345,)], "p double")
    got = df.select(*[S.to_tick(F.col("p"), 0.01, m) for m in ("nearest", "down", "up")]).first()
    assert list(got) == pytest.approx([1.23, 1.23, 1.24])


def test_available_weights(spark):
    value, share = S.weighted_available([(F.lit(1.0), 3.0), (F.lit(None).cast("double"), 1.0)])
    assert list(spark.range(1).select(value, share).first()) == [1.0, 0.75]


def test_ties_of_time_follow_trade_ids(spark):
    trades = spark.createDataFrame([("A", 2, T0, 5.0, 1.0, True), ("A", 1, T0, 3.0, 1.0, False)], "symbol string, trade_id long, ts timestamp, price double, qty double, is_buy boolean")
    r = B.bars(trades).first()
    assert (r["open"], r["close"], r["taker_buy"]) == (3.0, 5.0, 1.0)


def test_gap_and_correction(spark):
    b = bars(spark, [1.0, 2.0, 3.0, 4.0]).where("close <> 3")
    assert [r["missing"] for r in B.gaps(b, 3600).collect()] == [1]
    assert B.missing_bars(B.gaps(b, 3600), 3600).count() == 1
    new = bars(spark, [9.0])
    assert column(B.corrected(b, new), "close") == [9.0, 2.0, 4.0]


def test_incomplete_group_is_left_out(spark):
    assert B.row_groups(bars(spark, [1.0] * 9), 4).count() == 2


def test_flat_window_has_no_oscillator(spark):
    rows = [("A", T0 + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0, 1) for i in range(20)]
    flat = spark.createDataFrame(rows, BAR)
    assert column(flat.withColumn("k", R.stochastic(14)), "k") == [None] * 20
    assert column(K.rsi(flat, 14), "rsi14") == [None] * 20
    assert column(R.with_money_index(flat), "mfi") == [None] * 20


def test_fewer_rows_than_the_window(spark):
    assert column(bars(spark, [1.0, 2.0]).withColumn("m", R.rolling(F.avg, "close", 3)), "m") == [None, None]
    assert column(K.ema(bars(spark, [1.0, 2.0]), 20), "ema20") == [None, None]


def test_equal_highs_are_no_pivot(spark):
    high, _ = R.swing(2, 1)
    got = column(bars(spark, [1.0, 2.0, 5.0, 5.0, 1.0, 2.0, 7.0, 3.0]).withColumn("p", F.coalesce(high, F.lit(False))), "p")
    assert got == [False] * 6 + [True, False]


def test_no_look_ahead(spark):
    """Columns of a prefix are the prefix of the columns."""
    rng = np.random.default_rng(3)
    closes = (100 + rng.normal(size=80).cumsum()).tolist()
    names = [c for c in prepare(bars(spark, closes)).columns if c not in ("symbol", "ts")]
    long = prepare(bars(spark, closes)).orderBy("ts").limit(60).select(*names).toPandas()
    short = prepare(bars(spark, closes[:60])).orderBy("ts").select(*names).toPandas()
    np.testing.assert_allclose(long.astype(float), short.astype(float), rtol=1e-9, atol=1e-9)


def test_rsi_does_not_depend_on_scale(spark):
    rng = np.random.default_rng(4)
    closes = 10 + np.abs(rng.normal(size=40).cumsum())
    a, b = (column(K.rsi(bars(spark, (closes * k).tolist())), "rsi14") for k in (1.0, 1e-5))
    assert a[14:] == pytest.approx(b[14:])


def test_wilder_seed():
    x = np.array([np.nan, 1.0, 2.0, 3.0, 6.0])
    got = K.wilder_of(x, 3, 1)
    assert np.isnan(got[:3]).all() and got[3] == 2.0 and got[4] == pytest.approx(2 + 4 / 3)


def test_stop_and_reverse_flips_once(spark):
    df = K.parabolic(bars(spark, [10.0, 11.0, 12.0, 13.0, 5.0, 4.0]))
    assert column(df, "psar_reversal") == [0.0, 0.0, 0.0, 0.0, -1.0, 0.0]
    assert column(df, "psar_long")[:2] == pytest.approx([9.0, 9.0]) and column(df, "psar_long")[4:] == [0.0, 0.0]
    # The stop may not pass the highs of the two bars before (14 and 6).
    assert column(df, "psar_short") == pytest.approx([0.0] * 4 + [14.0, 14.0])
    falling = K.parabolic(bars(spark, [10.0, 9.0, 8.0]))
    assert column(falling, "psar_short")[0] == 11.0 and column(falling, "psar_long") == [0.0] * 3


def test_histogram_keeps_volume_and_control_is_inside(spark):
    rng = np.random.default_rng(5)
    b = bars(spark, (50 + rng.normal(size=30).cumsum()).tolist(), volume=2.0)
    assert P.histogram(b, 20).agg(F.sum("volume")).first()[0] == pytest.approx(60.0)
    r = P.levels(b, 20).first()
    assert r["val"] <= r["poc"] <= r["vah"]


def test_control_ties_go_to_the_centre_then_lower(spark):
    v = F.array(*[F.lit(float(x)) for x in (5, 1, 1, 5, 1, 5)])
    assert spark.range(1).select(P.control_bucket(v, 6)).first()[0] == 3


def test_value_area_prefers_the_upper_side(spark):
    v = F.array(*[F.lit(float(x)) for x in (0, 2, 5, 2, 0)])
    area = spark.range(1).select(P.value_area(v, F.lit(2), 5, 0.7)).first()[0]
    assert (area["lo"], area["hi"]) == (2, 3)


def test_asof_is_backward_and_inclusive_and_crosses_chunks(spark):
    left = bars(spark, [1.0] * 60).select("symbol", "ts", "close")
    right = spark.createDataFrame([("A", T0 + dt.timedelta(hours=2), 7.0), ("A", T0 + dt.timedelta(hours=30), 8.0)], "symbol string, ts timestamp, value double")
    got = column(J.asof(left, right, "value"), "value")
    assert got == [None] * 2 + [7.0] * 28 + [8.0] * 30


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([("A", T0, 1), (None, T0, 2), ("A", None, 3), ("A", T0, 1)], "symbol string, ts timestamp, n int")
    right = spark.createDataFrame([("A", T0, 7.0), (None, T0, 8.0), ("A", None, 9.0)], "symbol string, ts timestamp, value double")
    got = sorted((r["n"], r["value"]) for r in J.asof(left, right, "value").collect())
    assert got == [(1, 7.0), (1, 7.0), (2, None), (3, None)]


def test_near_band_keeps_repeats_and_wide_bands(spark):
    left = spark.createDataFrame([("A", 10.0), ("A", 10.0), ("A", -1.0), ("A", None), (None, 10.0)], "symbol string, price double")
    right = spark.createDataFrame([("A", 6.0), ("A", 0.0)], "symbol string, price double")
    assert J.near_band(left, right, "symbol", "price", 0.7).count() == 2
    assert J.near_band(left, right, "symbol", "price", 0.6).count() == 0


def test_smoothing_over_many_runs_and_chunks(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=500).cumsum() + 100
    rows = [("A", T0 + dt.timedelta(hours=i), None if i in (7, 260) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    out = K.smoothed(df, {"e": K.ema_series("x", 5), "w": K.wilder_series("x", 6, 3), "z": K.Smooth("x", 0.5, start=0.0)}, least_run=1)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    have = np.array([v for i, v in enumerate(x) if i not in (7, 260)])
    got = [r for r in out.orderBy("ts").collect() if r["x"] is not None]

    def line(alpha, first, y):
        values = [None] * first
        for v in have[first:]:
            values.append(y)
            y = y + alpha * (v - y)
        return values

    e = [None] * 4 + [have[:5].mean()]
    for v in have[5:]:
        e.append(e[-1] + (v - e[-1]) / 3)
    w = [None] * 8 + [have[3:9].mean()]
    for v in have[9:]:
        w.append(w[-1] + (v - w[-1]) / 6)
    z = []
    for v in have:
        z.append((z[-1] if z else 0.0) + 0.5 * (v - (z[-1] if z else 0.0)))
    for name, want in (("e", e), ("w", w), ("z", z)):
        assert [r[name] for r in got] == [None if v is None else pytest.approx(v, rel=1e-9) for v in want]


def test_supertrend_starts_up_at_the_first_bar(spark):
    # Before the range is seeded both bands are the middle of the bar, and a close at a band does not cross it.
    df = K.supertrend(bars(spark, [10.0, 9.0, 8.0, 20.0]), 10)
    assert column(df, "trend") == [1.0] * 4 and column(df, "supertrend") == [10.0, 9.0, 8.0, 20.0]


def test_flips_of_a_textbook_top(spark):
    from tidemark.operators import figures

    path = [10, 11, 12, 16, 13, 12, 11, 14, 17, 20, 18, 16, 15, 16, 17, 18, 17, 14, 9, 8]
    got = {(r["side"], r["kind"]): (r["level"], r["bodies"]) for r in figures.flips(bars(spark, [float(x) for x in path])).collect()}
    # The leg's top came out of the low at 11; the last low before the lower high is at 15.
    assert got[("short", "true")] == (10.0, 2) and got[("short", "early")] == (14.0, 2)


def test_ranks_and_quantiles_against_numpy(spark):
    rng = np.random.default_rng(12)
    v = rng.integers(0, 40, 500).astype(float).tolist() + rng.normal(size=200).tolist()
    df = spark.createDataFrame([("k", x) for x in v] + [("k", None)], "key string, v double")
    q = stats.quantiles(df, "key", "v", {"a": 0.1, "b": 0.5, "c": 0.93}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.93]).tolist())
    below = {r["v"]: r["below"] for r in stats.cumulated(df, "key", "v", parts=8).collect()}
    assert below == {x: sum(1 for y in v if y < x) for x in set(v)}


def test_context_does_not_fan_out(spark):
    ctx = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, c int")
    assert J.attach_context(bars(spark, [1.0, 2.0]), ctx).count() == 2


def test_near_band_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(90, 110, 60), rng.uniform(90, 110, 10)
    left = spark.createDataFrame([("A", float(x)) for x in a], "symbol string, price double")
    right = spark.createDataFrame([("A", float(x)) for x in b], "symbol string, price double")
    got = sorted(r["price"] for r in J.near_band(left, right, "symbol", "price", 0.003).collect())
    assert got == sorted(x for x in a.tolist() if any(abs(x - y) <= 0.003 * y for y in b))


def test_clusters_hang_on_their_first_level(spark):
    levels = spark.createDataFrame([("A", "bid", p, 1.0) for p in (100.0, 100.2, 100.4, 103.0)], "k string, side string, price double, qty double")
    got = [(r["anchor"], r["n"]) for r in L.wall_clusters(levels, "k", 0.003).orderBy("anchor").collect()]
    assert got == [(100.0, 2), (100.4, 1), (103.0, 1)]


def test_equity_skips_over_the_cap_and_draws_down(spark):
    rows = [("x", i, i, 100, -1.0) for i in range(8)] + [("x", 9, 200, 300, 1.0)]
    got = K.equity_curve(spark.createDataFrame(rows, "account string, trade_id long, opened long, closed long, r double")).orderBy("trade_id").collect()
    assert [r["taken"] for r in got] == [1] * 6 + [0, 0, 1]
    assert got[-1]["equity"] == pytest.approx(9400.0) and got[-1]["drawdown"] == pytest.approx(-0.06)


def test_equity_of_many_accounts_in_one_task(spark):
    # Trades of one id and opening have one order too, however the rows arrive; batches end within accounts.
    rows = [(f"a{i}", 1, 0, 10 + j, r) for i in range(30) for j, r in enumerate((-1.0, 2.0))] + [(f"a{i}", 2, 20, 30, 1.0) for i in range(30)] + [(None, 1, 0, 10, 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        runs = []
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "account string, trade_id long, opened long, closed long, r double").coalesce(1)
            out = K.equity_curve(df)
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
            runs.append([tuple(r) for r in out.orderBy("account", "trade_id", "equity").collect()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert runs[0] == runs[1] and len(runs[0]) == 91
    assert all(r[3] == pytest.approx(10_000 - 100 + 200) for r in runs[0] if r[1] == 2)


def test_constant_series_has_no_z(spark):
    df = spark.range(40).select(F.lit("a").alias("k"), F.lit(5.0).alias("v"), F.col("id").alias("t"))
    assert stats.robust_z(df, "k", "v", "t").first()["z"] is None


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.lit("a").alias("k"), (F.col("id") % 7).cast("double").alias("v"), "id")
    r = stats.bootstrap_interval(df, "k", "v", 200).first()
    assert r["lo"] < r["mean"] < r["hi"] and r["hi"] - r["lo"] < 1


def test_bootstrap_draws_by_value(spark):
    # A billion draws if each row drew; the values do, and the partitioning doesn't change the result.
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("double")).alias("v"))
    one, many = (sorted(map(tuple, stats.bootstrap_interval(d, "k", "v", 5000).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert [[round(x, 9) for x in r] for r in one] == [[round(x, 9) for x in r] for r in many]
    for _, mean, lo, hi in one:
        half = 1.96 * (99 / 12 / (100_000 * 10 / 11)) ** 0.5
        assert mean == pytest.approx(5.5, abs=1e-3) and lo == pytest.approx(mean - half, abs=half / 10) and hi == pytest.approx(mean + half, abs=half / 10)


def test_zones_do_not_overlap(spark):
    rows = []
    for i in range(40):
        price = 100.0 if i % 2 else 105.0
        rows.append(("A", T0 + dt.timedelta(hours=i), price, price, 1.0, i % 2 == 0, i % 2 == 1))
    swings = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, volume double, ph boolean, pl boolean")
    got = Y.accumulation_zones(swings).collect()
    assert [(r["lo"], r["hi"], r["touches"]) for r in got] == [(100.0, 105.0, 40)]


def test_groups_resolve_their_needs():
    assert resolved(["trend"]) == ["returns", "trend"]


def test_feature_table_round_trip(spark, tmp_path):
    df = bars(spark, [1.0, 2.0, 3.0]).withColumn("tf", F.lit("1h"))
    path = str(tmp_path / "features")
    tables.append_features(df, path)
    tables.append_features(df.where("close > 2").withColumn("extra", F.lit(1)), path)
    got = tables.read_features(spark, path, "A", "1h", F.lit(T0), F.lit(T0 + dt.timedelta(hours=9)))
    assert got.count() == 4 and "extra" in got.columns
    assert tables.last_features(spark, path, "A", "1h", 2).count() == 2


def test_malformed_rows_are_left_out(spark):
    rows = spark.createDataFrame([("A", [1704067200000.0, 1.0, 2.0, 0.5, 1.5, 3.0]), ("A", [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]), ("A", [1.0])], "symbol string, row array<double>")
    got = tables.bars_from_rows(rows, 60_000).collect()
    assert len(got) == 1 and got[0]["close"] == 1.5


def test_empty_tables(spark):
    none = bars(spark, [1.0]).where("false")
    assert prepare(none).count() == 0 and K.macd(none).count() == 0 and P.levels(none).count() == 0 and B.gaps(none, 3600).count() == 0


def test_ladder_merges_by_running_mean(spark):
    from tidemark.operators import book, context

    levels = spark.createDataFrame([("A", x) for x in (100.0, 101.0, 102.0, 110.0, 101.0)], "symbol string, price double")
    assert [(r["price"], r["n"]) for r in book.merged_ladder(levels, "symbol", 0.015).orderBy("price").collect()] == [(pytest.approx(101.0), 3), (110.0, 1)]
    start = spark.createDataFrame([("A", 99.0)], "symbol string, entry double")
    assert [(r["step"], r["price"]) for r in context.ladders(levels, start, 0.01, 2).orderBy("step").collect()] == [(1, 100.0), (2, 101.0)]


def test_clusters_against_one_fold(spark):
    rng = np.random.default_rng(7)
    prices = sorted(100 * np.exp(rng.normal(size=300).cumsum() * 0.002 + rng.uniform(0, 0.5, 300)))
    points = spark.createDataFrame([("A", float(p), 1.0) for p in prices], "symbol string, price double, weight double")
    for by in ("mean", "anchor"):
        want, part = [], []
        for p in [*prices, None]:
            if part and (p is None or p > (sum(part) / len(part) if by == "mean" else part[0]) * 1.004):
                want.append((part[0], part[-1], len(part)))
                part = []
            if p is not None:
                part.append(p)
        got = [(r["lo"], r["hi"], r["n"]) for r in Y.clusters(points, ["symbol"], 0.004, by).orderBy("lo").collect()]
        assert got == want


def test_a_head_at_price_zero(spark):
    from tidemark.operators import figures

    # Pivot lows 10, 0, 10 with two pivot highs between; a pivot low of 0 as a left shoulder too.
    lows = [20.0, 20.0, 20.0, 10.0, 21.0, 30.0, 20.0, 21.0, 0.0, 22.0, 30.0, 21.0, 20.0, 10.0, 21.0, 30.0, 22.0, 20.0, 0.0, 30.0]
    rows = [("A", T0 + dt.timedelta(hours=i), x, x, x, x) for i, x in enumerate(lows)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double")
    got = figures.head_and_shoulders(df).where("side = 'long'").collect()
    assert [(r["left"], r["head"], r["right"]) for r in got] == [(10.0, 0.0, 10.0)]


def test_trades_of_one_id_have_one_order(spark):
    from tidemark.operators import ledger

    # Two trades of id 1 close at one time; only one of them is among the last two before trade 3.
    rows = [(1, "A", "long", T0, T0, -5.0), (1, "A", "long", T0, T0, -7.0), (2, "A", "long", T0, T0, -5.0), (3, "A", "long", T0, T0, 1.0)]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        df = spark.createDataFrame(order, "trade_id long, symbol string, direction string, opened_at timestamp, closed_at timestamp, r double").coalesce(1)
        assert [(r["trade_id"], r["before"]) for r in ledger.repeat_losers(df, 2, -9.0).orderBy("trade_id").collect()] == [(2, -12.0), (3, -10.0)]


def test_burst_counts_over_cell_borders(spark):
    from tidemark.operators import book

    rows = [(i, f"s{i}", "long", T0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 295, 305, 310, 700))]
    got = book.within_caps(spark.createDataFrame(rows, "signal_id long, symbol string, direction string, ts timestamp"), 2, 2, 300).orderBy("signal_id").collect()
    assert [r["in_burst"] for r in got] == [1, 2, 2, 3, 1]


def test_trailing_sums_without_sliding_frames(spark):
    from tidemark.operators import book, ledger

    rng = np.random.default_rng(14)
    at, flag = rng.integers(0, 40_000, 500) * 7, rng.integers(0, 3, 500)
    rows = [(i, "A" if i % 3 else None, "long", T0 + dt.timedelta(seconds=int(a)), float(f) - 1 if f else None) for i, (a, f) in enumerate(zip(at, flag, strict=True))]
    df = spark.createDataFrame(rows, "signal_id long, symbol string, direction string, closed_at timestamp, net_pct double")
    signals = df.withColumn("ts", F.col("closed_at"))
    capped, losing = book.within_caps(signals, 2, 4, 900), ledger.loss_streak(df, 2, 1)
    assert "specifiedwindowframe(RangeFrame, -" not in (capped._jdf.queryExecution().toString() + losing._jdf.queryExecution().toString())
    assert {r["signal_id"]: r["in_burst"] for r in capped.collect()} == {i: sum(a - 900 < b <= a for b in at) for i, a in enumerate(at)}
    want = {i: sum(a - 7200 < b <= a and (j % 3 > 0) == (i % 3 > 0) and (rows[j][4] or 0) < 0 for j, b in enumerate(at)) for i, a in enumerate(at)}
    assert {r["signal_id"]: r["losses"] for r in losing.collect()} == {i: n for i, n in want.items() if n}


def test_spearman_sends_ranks_of_few_values_to_the_rows(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(15)
    x = rng.integers(0, 5, 400)
    pdf = pd.DataFrame({"k": np.where(np.arange(400) % 2, "a", "b"), "x": x, "y": x + rng.normal(size=400), "z": rng.integers(0, 3, 400)})
    df = spark.createDataFrame([(k, float(a), float(b) if i % 7 else None, float(c)) for i, (k, a, b, c) in enumerate(pdf.itertuples(index=False))], "k string, x double, y double, z double")
    pdf.loc[pdf.index % 7 == 0, "y"] = np.nan
    for bound in (100_000, 20):
        monkeypatch.setattr(stats, "BROADCAST_VALUES", bound)
        out = stats.spearman(df, "k", ["x", "y", "z"])
        assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == (3 if bound > 20 else 2)
        for r in out.collect():
            part = pdf[pdf["k"] == r["k"]].copy()
            ranks = part[[r["a"], r["b"]]].rank().dropna()
            assert r["rho"] == pytest.approx(np.corrcoef(ranks[r["a"]], ranks[r["b"]])[0, 1], abs=1e-9)


def test_clusters_of_one_dense_line_are_folded_in_batches(spark):
    # No gap wider than the tolerance: one island; neither a window nor a group holds it.
    prices = [100 * 1.0005**i for i in range(3000)]
    points = spark.createDataFrame([(k, p, 1.0) for k in ("A", None) for p in prices], "symbol string, price double, weight double")
    out = Y.clusters(points, ["symbol"], 0.003, "anchor")
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = out.orderBy("symbol", "lo").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, first = [], None
    for p in prices:
        if first is None or p > first * 1.003:
            first = p
            want.append([p, 0])
        want[-1][1] += 1
    assert [(r["anchor"], r["n"]) for r in got] == 2 * [tuple(w) for w in want] and sum(r["weight"] for r in got) == 6000


def test_cusum_follows_adjusted_mean(spark):
    import pandas as pd

    x = [1.0, 0.0, 2.0, 5.0, 1.0]
    s = pd.Series(x)
    want = (s - s.ewm(span=96, adjust=True).mean()).cumsum()
    assert column(K.cusum(bars(spark, x), "close"), "cusum") == pytest.approx(want.tolist())


def test_kdj_of_a_flat_range_stays_in_the_middle(spark):
    rows = [("A", T0 + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0, 5.0, 0.0, 1) for i in range(12)]
    assert column(K.kdj(spark.createDataFrame(rows, BAR)), "k")[8:] == [50.0] * 4


def test_recursive_groups_are_the_operators(spark):
    rng = np.random.default_rng(5)
    df = bars(spark, (100 + rng.normal(0, 1, 260).cumsum()).tolist())
    got = prepare(df, ["rsi", "atr", "adx", "macd", "keltner"]).orderBy("ts")
    assert not [c for c in got.columns if c.startswith("__")]
    for made, names in ((K.adx(df, 14), {"adx14": "adx", "plus_di14": "plus_di"}), (K.macd(df), {"macd_signal": "macd_signal"}), (K.rsi(df, 14), {"rsi14": "rsi14"}), (K.keltner(df), {"kc_upper": "kc_upper"}), (K.natr(df), {"natr14": "natr14"}), (K.ema(df, 200), {"ema200": "ema200"})):
        rows = made.orderBy("ts").collect()
        for mine, theirs in names.items():
            values = [r[mine] for r in got.select(mine).collect()]
            assert values[-1] is not None and values == [None if r[theirs] is None else pytest.approx(r[theirs], rel=1e-9, abs=1e-9) for r in rows]
