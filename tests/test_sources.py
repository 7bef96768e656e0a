"""Rotated logs, resumed tables, rings of samples, and the Beta distribution."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import beta
from tidemark.operators import flow
from tidemark.operators import ledger as G
from tidemark.sources import history as H
from tidemark.streaming import live, rings

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def append(path, rows, end="\n"):
    with open(path, "a") as f:
        f.write("".join(json.dumps({"n": n, "s": "x" * (n % 50)}) + "\n" for n in rows)[: -1 if end == "" else None])


def rotate(path, keep=3):
    for k in range(keep - 1, 0, -1):
        if os.path.exists(f"{path}.{k}"):
            os.replace(f"{path}.{k}", f"{path}.{k + 1}")
    os.replace(path, f"{path}.1")


def numbers(df):
    return sorted(r.n for r in H.parsed(df, "n long, s string").collect())


def test_each_line_is_read_once_also_after_rotations(spark, tmp_path):
    path = str(tmp_path / "logs" / "ticks.jsonl")
    os.makedirs(os.path.dirname(path))
    append(f"{path}.bak", [999])  # not a rotation

    def run():
        return numbers(live.replayed(H.rotated_lines(spark, path, stream=True), str(tmp_path / "out"), str(tmp_path / "c")))

    append(path, range(1000))
    append(path, [1000], end="")  # not ended yet
    assert run() == list(range(1000))
    append(path, [], "\n")
    with open(path, "a") as f:
        f.write("\n")
    append(path, range(1001, 1500))
    rotate(path)
    append(path, range(1500, 1700))
    assert run() == list(range(1700))
    append(path, range(1700, 1800))
    rotate(path)
    append(path, range(1800, 1801))
    assert run() == list(range(1801)) and run() == list(range(1801))
    assert numbers(H.rotated_lines(spark, path)) == list(range(1801))
    assert H.rotated_lines(spark, str(tmp_path / "logs" / "none")).count() == 0


def test_pieces_split_at_line_ends(tmp_path):
    path = str(tmp_path / "a.jsonl")
    append(path, range(300))
    for size in (1, 7, 64, 5000, 10**6):
        logs = H._Logs({"path": path, "taskbytes": str(size)})
        ends = {log: n for log, (_, n) in logs.found().items()}
        lines = [x for p in logs.pieces({}, ends) for b in logs.read(p) for x in b.column("line").to_pylist()]
        assert [json.loads(x)["n"] for x in lines] == list(range(300))


def test_lines_that_do_not_parse_are_rows_of_nulls(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\nnot json\n\n{"n": 2, "more": [1]}\n')
    got = H.parsed(H.rotated_lines(spark, str(tmp_path / "a.jsonl")), "n long")
    assert sorted((r.n for r in got.collect()), key=repr) == [1, 2, None, None]


def test_a_table_resumes_where_it_ends(spark, tmp_path):
    row = lambda s, h, v=1.0: (s, T0 + dt.timedelta(hours=h), v)
    schema = "symbol string, ts timestamp, close double"
    path = str(tmp_path / "t")
    assert H.resume(spark.createDataFrame([row("A", 0), row("A", 1), row("A", 1, 2.0), (None, T0, 1.0), ("A", None, 1.0)], schema), path).count() == 2
    added = H.resume(spark.createDataFrame([row("A", 0, 9.0), row("A", 2), row("B", 0)], schema), path)
    assert sorted((r.symbol, r.ts.hour) for r in added.collect()) == [("A", 2), ("B", 0)] and spark.read.parquet(path).count() == 4
    (a,) = H.coverage(spark.read.parquet(path).where("symbol = 'A'").unionAll(spark.createDataFrame([row("A", 9), row("A", 9)], schema)), 3600).collect()
    assert (a.bars, a.gaps, a.repeats, a.coverage_pct) == (4, 1, 1, pytest.approx(400 / 9))


def test_rings_are_bounded_and_begin_with_a_table(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(s, i * 2_000 + (i % 3) * 400, f"{s}{i}") for s in "AB" for i in range(200)] + [("A", 700_000, "late"), ("A", 500_000, "later"), (None, 1, "x"), ("A", None, "x")]
    frame = lambda part: spark.createDataFrame(part, rings.SAMPLES)
    early, rest = [r for r in rows if r[1] is None or r[1] < 200_000], [r for r in rows if r[1] is not None and r[1] >= 200_000]
    options = {"keep": 10, "spacing_ms": 5_000, "age_ms": 60_000}
    try:
        for k, part in enumerate((early, rest)):
            frame(part).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
            frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
        schema = frame([]).schema
        whole = live.replayed(rings.rings(live.stream(spark, str(tmp_path / "all"), schema, 1), **options), str(tmp_path / "o1"), str(tmp_path / "c1"))
        first = live.replayed(rings.rings(live.stream(spark, str(tmp_path / "in0"), schema), **options), str(tmp_path / "o2"), str(tmp_path / "c2"))
        # A second run starts from a table of what the rings held: here, all that was ever added.
        later = live.replayed(rings.rings(live.stream(spark, str(tmp_path / "in1"), schema), begin=first.select("symbol", "ms", "snap"), **options), str(tmp_path / "o3"), str(tmp_path / "c3"))
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, first.unionAll(later).collect()))
        assert whole.agg(F.max("size")).first()[0] == 10 and whole.where("ms - oldest_ms > 60000").count() == 0
        assert whole.where("snap = 'late'").first().size == 1 and whole.where("snap = 'later'").count() == 1
    finally:
        spark.conf.unset(provider)


def test_beta_distribution(spark):
    # Known figures of the distribution, to two digits; binomial tails below are exact.
    rows = [(0.5, 2.0, 2.0, 0.5), (0.2, 2.0, 5.0, 0.34464), (0.9, 30.0, 4.0, 0.5869), (0.5, 0.5, 0.5, 0.5), (0.0, 2.0, 2.0, 0.0), (1.0, 2.0, 2.0, 1.0), (0.25, 1.0, 3.0, 1 - 0.75**3), (0.3, 300.0, 700.0, 0.5061)]
    df = spark.createDataFrame(rows, "x double, a double, b double, want double")
    got = df.select("*", beta.incomplete_beta(F.col("x"), F.col("a"), F.col("b")).alias("share"), beta.beta_quantile(0.3, F.col("a"), F.col("b")).alias("q")).collect()
    from math import comb

    for r in got:
        if r.a == int(r.a) and r.b == int(r.b):
            n = int(r.a + r.b) - 1
            exact = sum(comb(n, j) * r.x**j * (1 - r.x) ** (n - j) for j in range(int(r.a), n + 1))
            assert r.share == pytest.approx(exact, abs=1e-10)
        assert r.share == pytest.approx(r.want, abs=2e-2)
    back = spark.createDataFrame([(r.q, r.a, r.b) for r in got], "q double, a double, b double").select(beta.incomplete_beta(F.col("q"), F.col("a"), F.col("b")).alias("share"))
    assert all(r.share == pytest.approx(0.3, abs=1e-9) for r in back.collect())
    gamma = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.0, 7.5, 1000.0)], "x double").select("x", beta.log_gamma(F.col("x")).alias("g")).collect()
    from math import lgamma

    assert all(r.g == pytest.approx(lgamma(r.x), rel=1e-11, abs=1e-11) for r in gamma)


def test_win_rates_and_tiers(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (6, 10), (60, 100), (199, 200)], "wins long, n long")
    got = G.win_rates(df).orderBy("n", "wins").collect()
    assert [r.tier for r in got] == ["exploratory", "exploratory", "exploratory", "calibrated", "production"] and got[0].mean is None and got[0].exact_lo is None
    assert (got[2].mean, got[2].exact_lo, got[2].exact_hi) == (pytest.approx(8 / 14), pytest.approx(0.3158, abs=1e-3), pytest.approx(0.8078, abs=1e-3))
    assert got[1].normal_lo == 0.0 and all(r.exact_lo < r.mean < r.exact_hi for r in got[1:])


def test_imbalance_by_zone(spark):
    levels = spark.createDataFrame([("A", "bid", 99.0, 1.0), ("A", "ask", 100.4, 1.0), ("A", "bid", 101.0, 50.0), ("B", "bid", 9.99, 2.0), ("C", "bid", 1.0, 1.0), ("A", "ask", None, 1.0), ("A", "ask", 100.1, 0.0)], "symbol string, side string, price double, qty double")
    refs = spark.createDataFrame([("A", 100.0), ("B", 10.0), ("C", 0.0)], "symbol string, ref double")
    got = {(r.symbol, r.zone_pct): (r.imbalance, r.covered_pct) for r in flow.imbalance_by_zone(levels, refs).collect()}
    from math import exp

    bid, ask = 99 * exp(-2.0), 100.4 * exp(-0.8)
    assert got["A", 0.5] == (-1.0, 0.0) and got["A", 1.0] == (pytest.approx((bid - ask) / (bid + ask)), pytest.approx(0.4))
    assert got["B", 0.5] == (1.0, 0.0) and len(got) == 8


def test_rings_with_a_time_to_live_run_by_the_clock(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frame = spark.createDataFrame([("A", i * 10_000, str(i)) for i in range(20)], rings.SAMPLES)
        frame.coalesce(1).write.parquet(str(tmp_path / "in"))
        df = rings.rings(live.stream(spark, str(tmp_path / "in"), frame.schema), keep=5, ttl_ms=60_000)
        q = df.writeStream.format("memory").queryName("ringed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        try:
            for _ in range(60):
                if spark.table("ringed").count() == 20 or not q.isActive:
                    break
                time.sleep(0.5)
        finally:
            q.stop()
        assert spark.table("ringed").agg(F.max("size")).first()[0] == 5 and spark.table("ringed").count() == 20
    finally:
        spark.conf.unset(provider)
