"""The zone registry: hand-worked ticks, and the keyed-state stream against the same ticks in turn."""

import random

import pytest

from tidemark.operators import registry as Z
from tidemark.streaming import live
from tidemark.streaming import registry as ZS

HOUR = 3_600_000


def after(spark, stored, sighted, price, now, **k):
    s = spark.createDataFrame([("A", h, d, "box", lo, hi, (lo + hi) / 2, t) for h, d, lo, hi, t in sighted], Z.SIGHTINGS)
    return Z.updated(stored, s, spark.createDataFrame([("A", price)], "symbol string, price double"), now, **k).checkpoint()


def rows(zones, *columns):
    return sorted(tuple(r) for r in zones.select(*columns).collect())


def test_a_zone_is_met_again_refreshed_worked_or_broken_and_flipped(spark):
    none = spark.createDataFrame([], Z.ZONES)
    one = after(spark, none, [("hourly", "long", 100.0, 102.0, 110.0), ("local", "long", 100.2, 101.8, 110.0), ("hourly", "short", 120.0, 121.0, None)], 101.0, 0)
    # Two timeframes show one zone: the narrower band names it.
    assert rows(one, "direction", "horizon", "lo", "hi", "seen", "touches", "event") == [("long", "local", 100.2, 101.8, 2, 1, "created"), ("short", "hourly", 120.0, 121.0, 1, 0, "created")]
    two = after(spark, one.drop("event"), [("hourly", "long", 100.0, 102.5, 111.0)], 111.5, HOUR)
    # Within the tolerance, wider: the band stays; the target is reached after a touch.
    assert rows(two, "direction", "lo", "hi", "target", "touches", "reactions", "progress", "status", "event") == [("long", 100.2, 101.8, 111.0, 1, 1, 1.054, "worked", "worked"), ("short", 120.0, 121.0, None, 0, 0, None, "forming", None)]
    three = after(spark, two.drop("event"), [("hourly", "short", 120.1, 121.0, None)], 124.0, 2 * HOUR)
    assert rows(three.where("event IS NOT NULL"), "direction", "kind", "status", "event", "lo", "hi", "adverse") == [("long", "flip", "forming", "created", 120.1, 121.0, None), ("short", "box", "broken", "broken", 120.1, 121.0, 2.479)]
    four = after(spark, three.drop("event"), [], 124.0, 11 * HOUR)
    # Only what has not ended expires: the flip, nine hours unseen at eight bars of an hour.
    assert rows(four.where("event IS NOT NULL"), "kind", "event") == [("flip", "expired")]
    assert four.where("flipped_from IS NOT NULL").count() == 1 and four.count() == 3


def test_nulls_and_unusable_sightings_make_no_zone(spark):
    none = spark.createDataFrame([], Z.ZONES)
    s = spark.createDataFrame([("A", "hourly", "long", "box", 5.0, 4.0, 4.5, None), ("A", "hourly", "long", "box", None, 4.0, 4.5, None), ("A", "hourly", "long", "box", 4.0, 5.0, 0.0, None), ("A", "odd", "long", "box", 4.0, 5.0, 4.5, None)], Z.SIGHTINGS)
    got = Z.updated(none, s, spark.createDataFrame([], "symbol string, price double"), 0)
    assert rows(got, "horizon", "status", "touches", "event") == [("odd", "forming", 0, "created")]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_ticks_in_turn(spark, tmp_path, seed):
    rng = random.Random(seed)
    provider = "spark.sql.streaming.stateStore.providerClass"
    ticks, stored, events = [], spark.createDataFrame([], Z.ZONES), []
    for k in range(5):
        now = k * rng.choice([1, 5, 9]) * HOUR if k < 2 else ticks[-1][0][1] + rng.choice([1, 5, 40]) * HOUR
        rows_ = []
        for symbol in "AB":
            price = rng.uniform(95, 110)
            shown = [(symbol, now, price, symbol, rng.choice(["hourly", "local"]), rng.choice(["long", "short"]), "box", lo, lo * rng.uniform(1, 1.02), None, rng.choice([None, lo * 1.03, lo * 0.97])) for lo in [rng.uniform(96, 106) for _ in range(rng.randint(0, 5))]]
            rows_ += [(*r[:9], (r[7] + r[8]) / 2, r[10]) for r in shown] + [(symbol, now, price, symbol, None, None, None, None, None, None, None)]
        ticks.append(rows_)
    for i, rows_ in enumerate(ticks):
        now = rows_[0][1]
        s = spark.createDataFrame([r[3:] for r in rows_ if r[5]], Z.SIGHTINGS)
        prices = spark.createDataFrame(sorted({(r[0], r[2]) for r in rows_}), "symbol string, price double")
        made = Z.updated(stored, s, prices, now).checkpoint()
        events += [(now, r.event, r.symbol, r.zone_id, r.status, r.touches, r.adverse, r.seen) for r in made.where("event IS NOT NULL").collect()]
        stored = made.drop("event")
        # Two files of a tick each, then the rest at once: micro-batches of one tick and of several.
        spark.createDataFrame([(r[1], r[2], *r[3:]) for r in rows_], ZS.TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / ("a" if i < 2 else "b")))
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = spark.createDataFrame([], ZS.TICKS).schema
        got = []
        for part, files in (("a", 1), ("b", 100)):
            spark.read.parquet(str(tmp_path / part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = live.stream(spark, str(tmp_path / "in"), schema, 1)
        out = live.replayed(ZS.zone_registry(df), str(tmp_path / "out"), str(tmp_path / "c"))
        got = [(r.tick_ms, r.event, r.symbol, r.zone_id, r.status, r.touches, r.adverse, r.seen) for r in out.collect()]
    finally:
        spark.conf.unset(provider)
    assert sorted(got, key=repr) == sorted(events, key=repr) and len(events) > 8
    assert {"created", "broken"} <= {e[1] for e in events}
