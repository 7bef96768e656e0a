"""Queries of liquidation heatmaps and candidate setups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import candidates as C
from tidemark.operators import context as X
from tidemark.operators import figures as G
from tidemark.operators import flow as L
from tidemark.operators import heatmap as H
from tidemark.operators import prices as P
from tidemark.operators import structure as T
from tidemark.plans.aggregates import _LEVELS, _PLAN, _TIERS, _levels, rounding
from tidemark.plans.market import _sql, hourly
from tidemark.plans.method import _FLIPS, _recent
from tidemark.plans.registry import query
from tidemark.plans.relations import _trades
from tidemark.plans.sql import LINE, r
from tidemark.sources.tables import table

NOW = 1705276800

# Realised events (trades as liquidations, bought ones closing shorts) at full weight, forward zones at a half.
_MAP = f"""ref AS (SELECT symbol, arg_max(close, ts_s) AS ref FROM b GROUP BY symbol),
ev AS (SELECT symbol, least(floor((price - ref * 0.88) / (ref * 0.24 / 48)), 47)::INTEGER AS bucket, CASE WHEN is_buy THEN 0 ELSE price * qty END AS longs, CASE WHEN is_buy THEN price * qty ELSE 0 END AS shorts, 1 AS events
  FROM trades JOIN ref USING (symbol) WHERE us >= {(NOW - 864000) * 1000000} AND us <= {NOW * 1000000} AND price BETWEEN ref * 0.88 AND ref * 1.12),
fw AS (SELECT symbol, floor((price - ref * 0.88) / (ref * 0.24 / 48))::INTEGER AS bucket, CASE WHEN sgn = 1 THEN money / 2 ELSE 0 END AS longs, CASE WHEN sgn = -1 THEN money / 2 ELSE 0 END AS shorts, 0 AS events FROM (
  SELECT q.symbol, ref, close * (1 - sgn * (margin - 0.005)) AS price, rise * weight * close AS money, sgn FROM (SELECT *, volume - lag(volume) {LINE} AS rise FROM b) q JOIN ref USING (symbol) CROSS JOIN (VALUES {_PLAN}) t(margin, weight, sgn) WHERE rise > 0)
  WHERE floor((price - ref * 0.88) / (ref * 0.24 / 48)) BETWEEN 0 AND 47),
mp AS (SELECT symbol, bucket, sum(longs) AS longs, sum(shorts) AS shorts, sum(events)::BIGINT AS events, any_value(ref) AS ref, any_value(ref) * (0.88 + (bucket + 0.5) * 0.24 / 48) AS price FROM (FROM ev UNION ALL FROM fw) JOIN ref USING (symbol) GROUP BY symbol, bucket)"""


def _map(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    bars = hourly(spark, folder)
    prices = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("ref"))
    events = _trades(spark, folder).select("symbol", "ts", F.when(F.col("is_buy"), "BUY").otherwise("SELL").alias("side"), "qty", "price")
    real = H.realised(events, prices, F.timestamp_seconds(F.lit(NOW)), 864_000)
    ahead = L.forward_liquidations(bars.select("symbol", "ts", "close", F.col("volume").alias("oi")), _TIERS)
    return H.merged([(real, 1.0), (ahead, 0.5)]), prices


@query(
    _sql(
        f"""SELECT symbol, rank, bucket, {r('price')} AS price, {r('longs')} AS longs, {r('shorts')} AS shorts, {r('intensity')} AS intensity, events,
  CASE WHEN longs > shorts * 1.3 THEN 'long_liq' WHEN shorts > longs * 1.3 THEN 'short_liq' END AS side, events = 0 AND intensity < 0.25 AS spent FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(longs + shorts, 6) DESC, bucket)::INTEGER AS rank FROM (SELECT *, coalesce((longs + shorts) / nullif(max(longs + shorts) OVER (PARTITION BY symbol), 0), 0) AS intensity FROM mp) WHERE intensity >= 0.12 OR events > 0) WHERE rank <= 8""",
        more=_MAP,
    )
)
def liquidation_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    heat, prices = _map(spark, folder)
    return rounding(H.density(heat.withColumns({"longs": F.round("longs", 9), "shorts": F.round("shorts", 9)}), prices))


@query(
    _sql(
        f"""SELECT symbol, {r('longs', 4)} AS longs, {r('shorts', 4)} AS shorts, {r('nl')} AS nearest_long, {r('ns')} AS nearest_short,
  CASE WHEN longs > shorts * 1.5 AND longs >= 25000 THEN 'long_flush' WHEN shorts > longs * 1.5 AND shorts >= 25000 THEN 'short_squeeze' END AS cascade,
  {r('CASE WHEN longs + shorts > 0 THEN (0.4 + longs / (longs + shorts)) / 2 ELSE 0.4 END')} AS fuel_long, {r('CASE WHEN longs + shorts > 0 THEN shorts / (longs + shorts) / 2 ELSE 0 END')} AS fuel_short FROM (
  SELECT symbol, coalesce(sum(CASE WHEN price < ref THEN longs END), 0) AS longs, coalesce(sum(CASE WHEN price > ref THEN shorts END), 0) AS shorts, max(CASE WHEN price < ref THEN price END) AS nl, min(CASE WHEN price > ref THEN price END) AS ns FROM mp GROUP BY symbol)""",
        more=_MAP,
    )
)
def liquidation_risk(spark: SparkSession, folder: str) -> DataFrame:
    out = H.at_risk(*_map(spark, folder))
    long, short = H.squeeze_fuel(F.lit(0.0002), F.lit(None).cast("double"), F.col("longs"), F.col("shorts"))
    out = out.withColumns({"fuel_long": long, "fuel_short": short})
    return rounding(out.withColumns({"longs": rounded("longs", 4), "shorts": rounded("shorts", 4)}))


def _zones(bars: DataFrame) -> DataFrame:
    """Boxes where closes of the last 300 bars gather, by log price: eight bars or more in a tenth."""
    recent = G.newest(bars, 300)
    boxes = recent.groupBy("symbol", F.floor(F.log("close") / F.log(F.lit(1.1))).alias("bin")).agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.count("*").alias("touches"), F.sum("quote_volume").alias("volume"))
    return boxes.where("touches >= 8").drop("bin")


def _bias(bars: DataFrame) -> DataFrame:
    recent = G.newest(bars, 100)
    return recent.groupBy("symbol").agg(F.when(F.max_by("close", "i") > F.min_by("close", "i"), "long").otherwise("short").alias("bias"))


_BOXES = """pool AS (SELECT *, max(rn) OVER (PARTITION BY symbol) - rn AS back FROM b),
zn AS (SELECT symbol, min(close) AS lo, max(close) AS hi, sum(quote_volume) AS volume FROM pool WHERE back < 300 GROUP BY symbol, floor(ln(close) / ln(1.1::DOUBLE)) HAVING count(*) >= 8),
st AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY rn), 0) - 1) AS step FROM pool WHERE back < 96),
nw AS (SELECT symbol, arg_min(close, back) AS price, coalesce(avg(step), 0.007) AS delta FROM st GROUP BY symbol),
bs AS (SELECT symbol, CASE WHEN arg_min(close, back) > arg_max(close, back) THEN 'long' ELSE 'short' END AS bias FROM pool WHERE back < 100 GROUP BY symbol)"""
_JUDGED = """lv AS (SELECT DISTINCT symbol, direction, entry FROM raw WHERE candidate IN ('zone_retest', 'zone_edge')),
ah AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS top, min(low) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS bottom FROM pool WHERE back < 60),
bad AS (SELECT lv.symbol, lv.direction, lv.entry FROM lv JOIN ah USING (symbol) GROUP BY 1, 2, 3 HAVING
  coalesce(min(CASE WHEN NOT CASE direction WHEN 'short' THEN least(open, close) > entry ELSE greatest(open, close) < entry END THEN back END), count(*)) >= 2
  OR (count_if(back < 12 AND open < entry AND close > entry) >= 3 AND count_if(back < 12 AND open > entry AND close < entry) >= 3)
  OR count_if(back >= 3 AND CASE direction WHEN 'long' THEN abs(low / entry - 1) <= 0.006 AND top >= entry * 1.025 ELSE abs(high / entry - 1) <= 0.006 AND bottom <= entry * 0.975 END) > 0)"""
_SIMPLE = """raw AS (
  SELECT symbol, 'zone_retest' AS candidate, CASE WHEN price > hi THEN 'long' ELSE 'short' END AS direction, CASE WHEN price > hi THEN hi ELSE lo END AS entry, lo, hi FROM zn JOIN nw USING (symbol) WHERE price > hi OR price < lo
  UNION ALL SELECT symbol, 'zone_edge', CASE WHEN (price - lo) / (hi - lo) <= 0.35 THEN 'long' ELSE 'short' END, CASE WHEN (price - lo) / (hi - lo) <= 0.35 THEN lo ELSE hi END, lo, hi FROM zn JOIN nw USING (symbol)
    WHERE hi > lo AND price BETWEEN lo * (1 - 0.006) AND hi * (1 + 0.006) AND ((price - lo) / (hi - lo) <= 0.35 OR (price - lo) / (hi - lo) >= 0.65)
  UNION ALL SELECT symbol, 'trap_flip', CASE side WHEN 'short' THEN 'long' ELSE 'short' END, level, lo, hi FROM (
    SELECT z.symbol, z.lo, z.hi, z.level, z.side, price, delta, coalesce(min(CASE WHEN NOT CASE side WHEN 'short' THEN least(p.open, p.close) > level ELSE greatest(p.open, p.close) < level END THEN back END), count(*)) AS bodies
    FROM (SELECT symbol, lo, hi, hi AS level, 'short' AS side FROM zn UNION ALL SELECT symbol, lo, hi, lo, 'long' FROM zn) z JOIN nw USING (symbol) JOIN pool p ON p.symbol = z.symbol AND p.back < 60 GROUP BY ALL) WHERE bodies >= 2 AND abs(price / level - 1) <= delta
  UNION ALL SELECT symbol, 'forward_zone', CASE WHEN up THEN 'long' ELSE 'short' END, edge, lo, hi FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, up) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol, up ORDER BY CASE WHEN up THEN dist ELSE -score END, lo) AS q FROM (
        SELECT *, volume / (1 + dist / 10) AS score FROM (SELECT *, price > hi AS up, CASE WHEN price > hi THEN hi ELSE lo END AS edge, abs(CASE WHEN price > hi THEN hi ELSE lo END - price) / price * 100 AS dist FROM zn JOIN nw USING (symbol) WHERE price > hi OR price < lo) WHERE dist BETWEEN 0.5 AND 20)) WHERE q = 1) WHERE k = 1
  UNION ALL SELECT symbol, 'forward_deep', 'long', hi, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY touches * (1 + dist / 10) DESC, hi DESC) AS k FROM (
    SELECT c.*, (price - hi) / price * 100 AS dist FROM (SELECT symbol, min(price) AS lo, max(price) AS hi, count(*) AS touches FROM (SELECT *, sum(apart) OVER (PARTITION BY symbol ORDER BY price ROWS UNBOUNDED PRECEDING) AS chain FROM (
      SELECT *, coalesce(price > lag(price) OVER (PARTITION BY symbol ORDER BY price) * 1.02, false)::INTEGER AS apart FROM p WHERE kind = 'low')) GROUP BY symbol, chain) c JOIN nw USING (symbol)) WHERE dist BETWEEN 0.5 AND 12) WHERE k = 1
  UNION ALL SELECT symbol, 'trend_flip', side, CASE side WHEN 'long' THEN zlo ELSE zhi END, zlo, zhi FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY side = 'long' DESC, kind = 'true' DESC) AS k FROM (
    SELECT hit.*, price, delta, (SELECT max(last) - coalesce(max(CASE WHEN NOT CASE side WHEN 'short' THEN greatest(open, close) < level ELSE least(open, close) > level END THEN i END), -1) FROM w WHERE w.symbol = hit.symbol) AS bodies FROM hit JOIN nw USING (symbol)) WHERE bodies >= 2 AND price BETWEEN zlo * (1 - delta) AND zhi * (1 + delta)) WHERE k = 1
  UNION ALL SELECT symbol, CASE WHEN price BETWEEN lo AND hi THEN 'stop_volume_in' ELSE 'stop_volume_out' END, CASE WHEN price > hi THEN 'long' WHEN price < lo THEN 'short' ELSE bias END, CASE WHEN price > hi THEN hi WHEN price < lo THEN lo ELSE price END, lo, hi
    FROM sv JOIN nw USING (symbol) JOIN bs USING (symbol) WHERE hi > lo AND (price > hi OR price < lo OR (bias = 'long' AND (price - lo) / (hi - lo) <= 1.0 / 3) OR (bias = 'short' AND (price - lo) / (hi - lo) >= 1 - 1.0 / 3)))"""
_SV = """sv AS (SELECT symbol, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, ts_s DESC) AS k FROM (
  SELECT *, (vm / mean) / greatest((hi - lo) / cm, 0.01) AS score FROM (SELECT *, min(low) OVER v AS lo, max(high) OVER v AS hi, avg(volume) OVER v AS vm, avg(close) OVER v AS cm, count(*) OVER v AS n, avg(volume) OVER (PARTITION BY symbol) AS mean FROM b WINDOW v AS (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE n = 6)) WHERE k = 1)"""


@query(
    _sql(
        f"SELECT symbol, candidate, direction, {r('entry')} AS entry, {r('lo')} AS lo, {r('hi')} AS hi FROM raw WHERE NOT (candidate IN ('zone_retest', 'zone_edge') AND EXISTS (SELECT 1 FROM bad WHERE bad.symbol = raw.symbol AND bad.direction = raw.direction AND bad.entry = raw.entry))",
        more=", ".join([_recent(150), _FLIPS, _BOXES, _SV, _SIMPLE, _JUDGED]),
    )
)
def level_candidates(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    zones, now, bias = _zones(bars), C.context(bars), _bias(bars)
    parts = [
        C.zone_retest(zones, now, bars), C.zone_edge(zones, now, bars), C.trap_flip(zones, now, bars), C.forward_zone(zones, now), C.forward_deep(bars, now), C.trend_flip(bars, now),
        C.stop_volume(T.stop_volume(bars, 6), now, bias),
    ]
    return rounding(reduce(DataFrame.unionAll, parts))


@query()
def pennant_candidates(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    return rounding(C.pennant(X.narrowing(bars), bars, C.context(bars), _bias(bars)))


_NEAR = f"""{_LEVELS}, rf AS (SELECT symbol, round(avg(price)) AS ref FROM lv GROUP BY symbol),
nr AS (SELECT lv.*, ref, least(floor((price - ref * 0.95) / (ref * 0.1 / 20)), 19)::INTEGER AS bucket FROM lv JOIN rf USING (symbol) WHERE price BETWEEN ref * 0.95 AND ref * 1.05)"""


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).groupBy("symbol").agg(F.round(F.avg("price")).alias("ref"))


@query(
    f"""WITH {_NEAR}, c AS (SELECT symbol, quantity AS cut FROM (SELECT symbol, price * qty AS quantity, row_number() OVER (PARTITION BY symbol ORDER BY price * qty) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM nr) WHERE k = greatest(floor(n * 0.995), 1)),
d AS (SELECT symbol, bucket, ref, sum(price * qty) AS depth, ref * 0.95 + (bucket + 0.5) * (ref * 0.1 / 20) AS centre FROM nr GROUP BY 1, 2, 3)
SELECT symbol, rank, bucket, {r('centre')} AS price, {r('depth', 2)} AS depth, {r('abs(centre / ref - 1) * 100')} AS distance_pct FROM (SELECT d.*, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(centre / ref - 1) * 100, 9), bucket)::INTEGER AS rank FROM d JOIN c USING (symbol) WHERE depth <= cut * 20) WHERE rank <= 5"""
)
def depth_voids(spark: SparkSession, folder: str) -> DataFrame:
    # Books here are deep, so a level's size counts twentyfold.
    levels = _levels(spark, folder)
    out = L.depth_voids(levels, _refs(spark, folder), share=0.995, scale=20.0)
    return out.withColumns({"price": rounded("price"), "depth": rounded("depth", 2), "distance_pct": rounded("distance_pct")})


@query(f"WITH {_NEAR} SELECT symbol, sample, bucket, {r('sum(price * qty)', 2)} AS notional FROM nr WHERE sample > 2 GROUP BY 1, 2, 3")
def depth_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return L.depth_matrix(_levels(spark, folder), _refs(spark, folder), samples=5).withColumn("notional", rounded("notional", 2))


@query(
    _sql(
        f"""SELECT symbol, {r('hi')} AS high, {r('lo')} AS low, {r('CASE WHEN lo > 0 THEN 100 * (hi / lo - 1) END')} AS range_pct, {r('CASE WHEN hi > lo THEN greatest(0, least(1, (price - lo) / (hi - lo))) ELSE 0.5 END')} AS position, bars_used
FROM (SELECT symbol, max(high) AS hi, min(low) AS lo, count(*) AS bars_used, arg_max(close, ts_s) AS price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS k FROM b) WHERE k <= 24 GROUP BY symbol)"""
    )
)
def session_stats(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    return rounding(P.session_stats(bars, bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price")), 24))


@query(
    f"""WITH v AS (SELECT c_custkey AS key, c_acctbal AS x, c_nationkey AS n, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal END AS last, CASE WHEN c_nationkey % 4 < 2 THEN c_acctbal END AS bid, c_acctbal + c_custkey % 5 - 1 AS ask, CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal - 1 END AS bb, c_acctbal + 1 AS ba FROM customer),
m AS (SELECT *, CASE WHEN last > 0 THEN last WHEN bid > 0 AND ask >= bid THEN (bid + ask) / 2 WHEN bb > 0 AND ba >= bb THEN (bb + ba) / 2 WHEN x > 0 THEN x END AS price,
  CASE WHEN last > 0 THEN 'ticker' WHEN bid > 0 AND ask >= bid THEN 'bbo_mid' WHEN bb > 0 AND ba >= bb THEN 'book_mid' WHEN x > 0 THEN 'mark' END AS source FROM v)
SELECT key, {r('price')} AS price, source, CASE WHEN price IS NULL THEN 'missing_price' WHEN n % 2 = 0 AND abs(price - 4500) / 4500 * 100 > 25 THEN 'price_deviation' END AS doubt FROM m"""
)
def price_sources(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    x, n, k = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    price, source = P.resolved(F.when(n % 3 == 0, x), F.when(n % 4 < 2, x), x + k % 5 - 1, F.when(n % 5 == 0, x - 1), x + 1, x)
    out = c.select(k.alias("key"), price.alias("price"), source.alias("source"), n.alias("n"))
    refs = F.when(F.col("n") % 2 == 0, F.array(F.lit(4000.0), F.lit(5000.0), F.lit(-1.0))).otherwise(F.expr("CAST(array() AS array<double>)"))
    return out.select("key", rounded("price").alias("price"), "source", P.implausible(F.col("price"), refs).alias("doubt"))


@query(
    f"""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS trade_id, l_linestatus = 'O' AS up, l_extendedprice / l_quantity AS p, l_discount AS d, l_tax AS t, l_quantity::INTEGER AS q FROM lineitem),
w AS (SELECT *, CASE WHEN up THEN 1 ELSE -1 END AS s, CASE WHEN up THEN p * 1.002 ELSE p * 0.998 END AS base FROM v)
SELECT trade_id, {r('CASE WHEN q % 3 = 0 THEN 0.4 * s * (p * (1 + s * 0.03) - base) / base * 100 + 0.6 * s * (p * (1 + d - t) - base) / base * 100 ELSE s * (p * (1 + d - t) - base) / base * 100 END')} AS pct, CASE WHEN q % 3 = 0 THEN 'partial' ELSE 'full' END AS basis FROM w"""
)
def partial_results(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    p, up = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_linestatus") == "O"
    hit = F.col("l_quantity").cast("int") % 3 == 0
    pct, basis = P.result_pct(F.when(up, "long").otherwise("short"), p * 0.998, p * 1.002, p * (1 + F.col("l_discount") - F.col("l_tax")), p * F.when(up, 1.03).otherwise(0.97), hit, F.lit(40.0))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), rounded(pct).alias("pct"), basis.alias("basis"))
