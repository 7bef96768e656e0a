"""Queries of joins, set operations and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import bars as B
from tidemark.operators import joins as J
from tidemark.operators import windows as R
from tidemark.plans.market import _RET, _pivots, _sql, _swings, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.sql import TRADES, r
from tidemark.sources.tables import table

METRIC, TARGET = "view", "click"


def _trades(spark: SparkSession, folder: str) -> DataFrame:
    return B.trades_from_events(table(spark, folder, "events").select("event_type", "event_id", "ts", "value"))


_SHIFT = f"metric AS (SELECT s.symbol, m.us // 1000000 + 1 AS ts_s, m.price AS value FROM trades m JOIN (SELECT DISTINCT symbol FROM trades) s ON s.symbol <> m.symbol WHERE m.symbol = '{METRIC}')"


def _metric(spark: SparkSession, folder: str) -> DataFrame:
    """One symbol's prices, a second late, as a metric of all others."""
    t = _trades(spark, folder)
    # The symbols are a small set: few values, made distinct by a partial aggregate.
    others = t.select("symbol").distinct().where(F.col("symbol") != METRIC)
    seconds = t.where(F.col("symbol") == METRIC).select(F.timestamp_seconds(F.unix_seconds("ts") + 1).alias("ts"), F.col("price").alias("value"))
    return seconds.withColumn("k", F.lit(1)).join(others.withColumn("k", F.lit(1)), "k").select("symbol", "ts", "value")


@query(
    _sql(
        f"SELECT b.symbol, b.ts_s, {r('b.close')} AS close, {r('m.value')} AS metric FROM b ASOF LEFT JOIN (SELECT symbol, ts_s, max(value) AS value FROM metric GROUP BY 1, 2) m ON b.symbol = m.symbol AND b.ts_s >= m.ts_s",
        more=_SHIFT,
    )
)
def asof_metric(spark: SparkSession, folder: str) -> DataFrame:
    out = J.asof(hourly(spark, folder).select("symbol", "ts", "close"), _metric(spark, folder), "value")
    return shown(out, close="close", metric="value")


@query(
    _sql(
        f"""SELECT b.symbol, b.ts_s, {r('m.value')} AS metric FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS n FROM b) b
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC, value) AS n FROM metric) m ON b.symbol = m.symbol AND b.n = m.n""",
        more=_SHIFT.replace("m.us // 1000000 + 1 AS ts_s", "m.us AS ts_s"),
    )
)
def positional_attach(spark: SparkSession, folder: str) -> DataFrame:
    t = _trades(spark, folder)
    others = t.select("symbol").distinct().where(F.col("symbol") != METRIC).withColumn("k", F.lit(1))
    metric = t.where(F.col("symbol") == METRIC).select("ts", F.col("price").alias("value"), F.lit(1).alias("k")).join(others, "k").select("symbol", "ts", "value")
    return shown(J.positional(hourly(spark, folder).select("symbol", "ts"), metric), metric="value")


_ZONES = "zones AS (SELECT symbol, ts_s AS t0, ts_s + 4 * 3600 AS t1, high AS zone_high FROM piv WHERE ph)"


@query(
    _sql(
        f"SELECT z.symbol, z.t0 AS zone_s, t.trade_id, {r('t.price')} AS price FROM zones z JOIN trades t ON t.symbol = z.symbol AND t.us BETWEEN z.t0 * 1000000 AND z.t1 * 1000000",
        more=_pivots(5, 5) + ", " + _ZONES,
    )
)
def interval_join_zone(spark: SparkSession, folder: str) -> DataFrame:
    zones = _swings(spark, folder, 5, 5).where("ph").select("symbol", F.col("ts").alias("t0"), F.timestamp_seconds(F.unix_seconds("ts") + 4 * 3600).alias("t1"))
    met = J.intervals(_trades(spark, folder).select("symbol", "trade_id", "ts", "price"), zones, "symbol", "ts", "t0", "t1")
    return met.select("symbol", F.unix_seconds("t0").alias("zone_s"), "trade_id", rounded("price").alias("price"))


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('high')} AS price FROM piv p WHERE ph AND EXISTS (SELECT 1 FROM piv q WHERE q.pl AND q.symbol = p.symbol AND abs(p.high - q.low) <= 0.25 * q.low)",
        more=_pivots(3, 1),
    )
)
def band_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    s = _swings(spark, folder, 3, 1)
    near = J.near_band(s.where("ph AND high > 0").select("symbol", "ts", F.col("high").alias("price")), s.where("pl AND low > 0").select("symbol", F.col("low").alias("price")), "symbol", "price", 0.25)
    return shown(near, price="price")


@query(_sql(f"SELECT symbol, ts_s, {r('CASE WHEN ts_s % 7200 = 0 THEN close * 2 ELSE close END')} AS close, CASE WHEN ts_s % 7200 = 0 THEN volume + 1 ELSE volume END AS volume FROM b"))
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    old = hourly(spark, folder).select("symbol", "ts", "close", "volume")
    new = old.where(F.unix_seconds("ts") % 7200 == 0).select("symbol", "ts", (F.col("close") * 2).alias("close"), (F.col("volume") + 1).alias("volume"))
    return shown(B.corrected(old, new), close="close", volume="volume")


@query(_sql("SELECT symbol, ts_s, trades FROM b WHERE NOT EXISTS (SELECT 1 FROM b a WHERE a.symbol = b.symbol AND a.ts_s = b.ts_s AND a.trades >= 3)"))
def archive_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    b = hourly(spark, folder)
    return shown(J.not_archived(b.select("symbol", "ts", "trades"), b.where("trades >= 3"), ["symbol", "ts"]), trades="trades")


@query(_sql("SELECT b.symbol, b.ts_s, c.n AS context FROM b LEFT JOIN (SELECT symbol, count(*) AS n FROM trades GROUP BY symbol) c USING (symbol)"))
def context_join(spark: SparkSession, folder: str) -> DataFrame:
    context = _trades(spark, folder).groupBy("symbol").agg(F.count("*").alias("context"))
    return shown(J.attach_context(hourly(spark, folder).select("symbol", "ts"), context), context="context")


@query(
    _sql(
        f"SELECT a.symbol, {r('corr(a.ret, c.ret)')} AS corr, {r('regr_slope(a.ret, c.ret)')} AS beta, count(*) AS n FROM ret a JOIN ret c ON a.ts_s = c.ts_s AND c.symbol = '{TARGET}' AND a.symbol <> '{TARGET}' WHERE a.ret IS NOT NULL AND c.ret IS NOT NULL GROUP BY a.symbol",
        more=_RET,
    )
)
def corr_beta(spark: SparkSession, folder: str) -> DataFrame:
    out = J.corr_beta(J.return_alignment(R.with_returns(hourly(spark, folder)), TARGET))
    return out.select("symbol", rounded("corr").alias("corr"), rounded("beta").alias("beta"), "n")


@query(
    f"""WITH {TRADES}, p AS (SELECT (trade_id % 4)::VARCHAR AS asset, symbol AS venue, arg_max(price, struct_pack(a := us // 1000, b := trade_id)) AS v, max(us // 1000) AS ms FROM trades GROUP BY 1, 2), m AS (SELECT max(us // 1000) AS now FROM trades)
SELECT asset, {", ".join(r(f"max(CASE WHEN venue = '{v}' AND (SELECT now FROM m) - ms <= 3600000 THEN v END)") + f" AS {v}" for v in ("click", "purchase", "view"))} FROM p GROUP BY asset"""
)
def cross_venue_plane(spark: SparkSession, folder: str) -> DataFrame:
    t = _trades(spark, folder)
    last = F.max_by("price", F.struct(F.unix_millis("ts"), "trade_id"))
    planes = t.groupBy((F.col("trade_id") % 4).cast("string").alias("symbol"), F.col("symbol").alias("venue")).agg(last.alias("value"), F.max(F.unix_millis("ts")).alias("received_ms"))
    now = t.agg(F.max(F.unix_millis("ts"))).first()[0] or 0  # one number: the clock of this reading
    wide = J.across_venues(planes.withColumns({"plane": F.lit("last"), "bound_ms": F.lit(3_600_000)}), "last", now, ["click", "purchase", "view"])
    return wide.select(F.col("symbol").alias("asset"), *[rounded(v).alias(v) for v in ("click", "purchase", "view")])


@query("SELECT date_part('hour', ts)::INTEGER AS h FROM events WHERE event_type = 'click' INTERSECT SELECT date_part('hour', ts)::INTEGER FROM events WHERE event_type = 'purchase' AND value > 40")
def common_hours(spark: SparkSession, folder: str) -> DataFrame:
    t = _trades(spark, folder).withColumn("h", F.pmod(F.floor(F.unix_seconds("ts") / 3600), F.lit(24)).cast("int"))
    return t.where("symbol = 'click'").select("h").intersect(t.where("symbol = 'purchase' AND price > 40").select("h"))


@query(
    """WITH u AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part)
SELECT count(*) AS rows_n, count(balance) AS balances, count(size) AS sizes FROM u"""
)
def diagonal_union(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.sources.tables import with_all_columns

    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return with_all_columns(a, b).agg(F.count("*").alias("rows_n"), F.count("balance").alias("balances"), F.count("size").alias("sizes"))
