"""Streams replayed from files give what batches give."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.sources import schemas
from tidemark.streaming import live

T0 = dt.datetime(2024, 1, 1)


def test_live_bars_equal_batch_bars(spark, sf, tmp_path):
    trades = B.trades_from_events(spark.read.parquet(f"{sf}/events.parquet"))
    ordered = trades.repartitionByRange(6, "ts").sortWithinPartitions("ts")
    ordered.write.parquet(str(tmp_path / "in"))
    # A last trade far ahead moves the watermark past every bar but its own.
    last = spark.createDataFrame([("end", 0, dt.datetime(2030, 1, 1), 1.0, 1.0, True)], schemas.TRADES)
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = live.replayed(live.live_bars(live.stream(spark, str(tmp_path / "in"), schemas.TRADES, 100)), str(tmp_path / "out"), str(tmp_path / "c"))
    want = B.bars(trades)
    key = ["symbol", F.unix_seconds("ts").alias("s"), "open", "close", "volume", "trades"]
    got, want = got.where("symbol <> 'end'").select(*key), want.select(*key)
    assert got.exceptAll(want).count() == 0 and want.count() == got.count() > 0


def test_repeated_deliveries(spark, tmp_path):
    rows = [("A", i % 5, T0 + dt.timedelta(seconds=i % 5), 1.0, 1.0, True) for i in range(15)]
    spark.createDataFrame(rows, schemas.TRADES).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = live.replayed(live.once_each(live.stream(spark, str(tmp_path / "in"), schemas.TRADES), ["symbol", "trade_id"]), str(tmp_path / "out"), str(tmp_path / "c"))
    assert got.count() == 5


def test_newest_bar_is_revised_and_late_ones_dropped(spark, tmp_path):
    schema = "symbol string, open_s long, close double, received_ms long"
    for i, row in enumerate([("A", 100, 1.0, 1), ("A", 100, 2.0, 2), ("A", 200, 3.0, 3), ("A", 100, 9.0, 4)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # One file at a time, so that the last update comes after the bar behind it has gone.
    df = live.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    got = [(r["open_s"], r["close"], r["revision"]) for r in live.replayed(live.last_bars(df), str(tmp_path / "out"), str(tmp_path / "c")).orderBy("open_s", "close").collect()]
    assert got == [(100, 1.0, False), (100, 2.0, True), (200, 3.0, False)]


def test_trade_lifecycle(spark, tmp_path):
    schema = "trade_id long, event_ms long, direction string, entry double, stop double, tp1 double, tp2 double, high double, low double"
    path = [(10.1, 9.9), (11.2, 10.5), (11.8, 11.5), (11.0, 10.8)]
    rows = [(1, i, "long", 10.0, 9.0, 11.0, 15.0, h, l) for i, (h, l) in enumerate(path)] + [(2, 0, "short", 10.0, 11.0, 9.0, 5.0, 10.5, 9.8), (2, 1, "short", 10.0, 11.0, 9.0, 5.0, 11.5, 4.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = live.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    out = live.replayed(live.trade_lifecycle(df), str(tmp_path / "out"), str(tmp_path / "c")).orderBy("trade_id", "event_ms").collect()
    assert [(r["phase"], r["reason"]) for r in out if r["trade_id"] == 1] == [("armed", "seen"), ("triggered", "entry"), ("tp1_managed", "tp1"), ("closed", "trail")]
    assert [r["reason"] for r in out if r["trade_id"] == 2][-1] == "stop"
    for r in out:
        assert r["phase"] in live.PHASES


def test_trades_end_by_time_and_leave_no_state(spark, tmp_path):
    schema = "trade_id long, event_ms long, direction string, entry double, stop double, tp1 double, tp2 double, high double, low double"
    hour = live.HOUR_MS
    row = lambda i, h, high, low, side="long": (i, h * hour, side, 10.0, 9.0 if side == "long" else 11.0, 12.0, 15.0, high, low)
    batches = [
        [row(1, 0, 11.0, 10.5), row(2, 0, 10.1, 9.9), row(3, 0, 10.1, 9.9, "short"), row(4, 0, 10.2, 9.9)],
        [row(1, 49, 11.0, 10.5), row(2, 121, 10.05, 9.95), row(3, 9, 10.2, 9.95, "short"), row(4, 1, 10.3, 10.1)],
        [row(4, 2, 10.25, 9.9)],
        [row(9, 5000, 10.1, 9.9)],
        [row(9, 5001, 10.1, 9.9)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = live.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    out = live.replayed(live.trade_lifecycle(df), str(tmp_path / "out"), str(tmp_path / "c")).orderBy("trade_id", "event_ms").collect()
    last = {i: [(r["phase"], r["reason"]) for r in out if r["trade_id"] == i][-1] for i in (1, 2, 3, 4)}
    # Never entered, without progress, and (after 3 % in favour) stopped at entry.
    assert last == {1: ("closed", "orphan"), 2: ("closed", "stall"), 3: ("closed", "stall"), 4: ("closed", "trail")}


def test_zones_change_and_expire(spark, tmp_path):
    schema = "symbol string, zone_id string, event_ms long, side string, lo double, hi double, close double, reacted boolean, worked boolean"
    hour = live.HOUR_MS
    batches = [
        [("A", "z", 0, "long", 10.0, 11.0, 12.0, False, False), ("A", "y", 0, "long", 5.0, 6.0, 7.0, False, False)],
        [("A", "z", hour, "long", 10.0, 11.0, 12.0, True, False)],
        [("A", "z", 2 * hour, "long", 10.0, 11.0, 9.0, False, False)],
        [("A", "x", 40 * hour, "short", 20.0, 21.0, 19.0, False, False)],
        [("A", "x", 41 * hour, "short", 20.0, 21.0, 19.0, False, True)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = live.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    out = live.replayed(live.zone_lifecycle(df), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    of = lambda z: [(r["status"], r["role"]) for r in sorted((r for r in out if r["zone_id"] == z), key=lambda r: (r["event_ms"], r["status"] == "expired"))]
    assert of("z") == [("forming", "support"), ("confirmed", "support"), ("broken", "resistance"), ("expired", None)]
    assert of("y") == [("forming", "support"), ("expired", None)]
    assert of("x") == [("forming", "resistance"), ("worked", "resistance")]
