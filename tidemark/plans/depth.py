"""Queries of icebergs, absorption, vanished walls, caps and ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import book as D
from tidemark.plans.aggregates import _LEVELS, _levels, rounding
from tidemark.plans.market import _pivots, _sql, _swings
from tidemark.plans.registry import query
from tidemark.plans.relations import _trades
from tidemark.plans.sql import TRADES, r
from tidemark.sources.tables import table

_TAPE = "tape AS (SELECT l_returnflag AS symbol, floor(l_extendedprice / l_quantity)::DOUBLE AS price, l_quantity::DOUBLE AS qty, l_tax > 0.04 AS is_buy FROM lineitem)"


def _tape(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    return l.select(F.col("l_returnflag").alias("symbol"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("qty"), (F.col("l_tax") > 0.04).alias("is_buy"))


@query(
    f"""WITH {_LEVELS}, {_TAPE}, f AS (SELECT symbol, floor(price / 25)::BIGINT AS bucket, sum(qty) AS filled FROM tape WHERE is_buy GROUP BY 1, 2), d AS (SELECT symbol, floor(price / 25)::BIGINT AS bucket, sum(qty) AS displayed FROM lv WHERE side = 'ask' GROUP BY 1, 2)
SELECT symbol, bucket, filled, displayed, {r('filled / displayed')} AS ratio FROM f JOIN d USING (symbol, bucket) WHERE filled / displayed > 1.4"""
)
def icebergs(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(D.icebergs(_tape(spark, folder).where("is_buy"), _levels(spark, folder).where("side = 'ask'"), 25.0))


@query(
    f"""WITH {_LEVELS}, {_TAPE}, f AS (SELECT symbol, floor(price / 25)::BIGINT AS bucket, sum(CASE WHEN is_buy THEN qty ELSE 0 END) AS buy, sum(CASE WHEN NOT is_buy THEN qty ELSE 0 END) AS sell FROM tape GROUP BY 1, 2),
w AS (SELECT symbol, side, floor(price / 25)::BIGINT AS bucket, sum(price * qty) AS notional FROM lv GROUP BY 1, 2, 3)
SELECT symbol, side, bucket, {r('notional', 2)} AS notional, {r('(buy - sell) / nullif(buy + sell, 0)')} AS delta FROM w JOIN f USING (symbol, bucket) WHERE (side = 'bid' AND (buy - sell) / nullif(buy + sell, 0) <= -0.2) OR (side = 'ask' AND (buy - sell) / nullif(buy + sell, 0) >= 0.2)"""
)
def absorption(spark: SparkSession, folder: str) -> DataFrame:
    bucket = D.price_bucket("price", 25.0).alias("bucket")
    foot = _tape(spark, folder).groupBy("symbol", bucket).agg(F.sum(F.when(F.col("is_buy"), F.col("qty")).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("is_buy"), F.col("qty")).otherwise(0.0)).alias("sell"))
    walls = _levels(spark, folder).groupBy("symbol", "side", bucket).agg(F.sum(F.col("price") * F.col("qty")).alias("notional"))
    out = D.absorption(foot, walls)
    return out.withColumns({"notional": rounded("notional", 2), "delta": rounded("delta")})


@query(
    f"""WITH {_LEVELS}, h AS (SELECT symbol, side, floor(price / 10) AS price, sample, sum(price * qty) AS notional FROM lv GROUP BY 1, 2, 3, 4),
v AS (SELECT symbol, side, price, count(DISTINCT CASE WHEN sample < 6 THEN sample END) AS samples, avg(CASE WHEN sample < 6 THEN notional END) AS before, coalesce(sum(CASE WHEN sample = 6 THEN notional END), 0) AS now FROM h GROUP BY 1, 2, 3)
SELECT symbol, side, {r('price')} AS price, samples, {r('before', 2)} AS before, {r('now', 2)} AS now FROM v WHERE samples >= 3 AND now < 0.25 * before"""
)
def vanished_walls(spark: SparkSession, folder: str) -> DataFrame:
    h = _levels(spark, folder).groupBy("symbol", "side", F.floor(F.col("price") / 10).cast("double").alias("price"), "sample").agg(F.sum(F.col("price") * F.col("qty")).alias("notional"))
    out = D.vanished(h, F.lit(6))
    return out.select("symbol", "side", rounded("price").alias("price"), "samples", rounded("before", 2).alias("before"), rounded("now", 2).alias("now"))


@query(
    f"""WITH {TRADES}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol, is_buy, us // 86400000000 ORDER BY us, trade_id) AS nth, count(*) OVER (ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS in_burst FROM trades)
SELECT trade_id AS signal_id, nth::INTEGER AS nth, in_burst, nth <= 2 AS day_ok, in_burst <= 4 AS burst_ok FROM s"""
)
def signal_caps(spark: SparkSession, folder: str) -> DataFrame:
    s = _trades(spark, folder).select(F.col("trade_id").alias("signal_id"), "symbol", F.col("is_buy").alias("direction"), "ts")
    return D.within_caps(s, 2, 4, 900).select("signal_id", "nth", "in_burst", "day_ok", "burst_ok")


@query(
    _sql(
        f"""SELECT symbol, {r('last(total / n ORDER BY k)')} AS price, max(n) AS n FROM f GROUP BY symbol, cluster""",
        more=_pivots(5, 5)
        + """, x AS (SELECT symbol, high AS v, row_number() OVER (PARTITION BY symbol ORDER BY high) AS k FROM (SELECT DISTINCT symbol, high FROM piv WHERE ph)),
f AS (SELECT symbol, k, v AS total, 1::BIGINT AS n, 1 AS cluster FROM x WHERE k = 1
  UNION ALL SELECT x.symbol, x.k, CASE WHEN x.v <= f.total / f.n * 1.015 THEN f.total + x.v ELSE x.v END, CASE WHEN x.v <= f.total / f.n * 1.015 THEN f.n + 1 ELSE 1 END, CASE WHEN x.v <= f.total / f.n * 1.015 THEN f.cluster ELSE f.cluster + 1 END
  FROM f JOIN x ON x.symbol = f.symbol AND x.k = f.k + 1)""",
        recursive=True,
    )
)
def merged_ladders(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(D.merged_ladder(_swings(spark, folder, 5, 5).where("ph").select("symbol", F.col("high").alias("price")), "symbol", 0.015))
