"""Queries of win rates, book imbalance by zone, and the coverage of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import flow as L
from tidemark.operators import ledger as G
from tidemark.operators import recursive as K
from tidemark.operators import stats as S
from tidemark.operators import windows as R
from tidemark.plans.aggregates import _LEVELS, _levels
from tidemark.plans.market import _TR, _sql, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.relations import _trades
from tidemark.plans.setups import _refs
from tidemark.plans.sql import LINE, TRADES, full, over, r, recursion
from tidemark.sources import history as H
from tidemark.sources.tables import table

# For whole parameters the incomplete beta function is a binomial tail.
_TAIL = "list_sum([exp(lgamma(t + 1) - lgamma(j + 1) - lgamma(t - j + 1) + j * ln(x) + (t - j) * ln(1 - x)) FOR j IN range(a, t + 1)])"


@query(
    f"""WITH RECURSIVE c AS (SELECT l_suppkey AS supplier, count_if(l_discount > l_tax)::BIGINT AS wins, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT *, (wins + 2)::BIGINT AS a, n + 3 AS t FROM c),
q AS (SELECT supplier, a, t, share, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM p, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) s(share) UNION ALL
  SELECT supplier, a, t, share, i + 1, CASE WHEN f < share THEN x ELSE lo END, CASE WHEN f < share THEN hi ELSE x END FROM (SELECT *, {_TAIL} AS f FROM (SELECT *, (lo + hi) / 2 AS x FROM q WHERE i < 40)))
SELECT supplier, wins, n, {r('m')} AS mean, {r('el')} AS exact_lo, {r('eh')} AS exact_hi, {r('greatest(0, m - 1.96 * s)')} AS normal_lo, {r('least(1, m + 1.96 * s)')} AS normal_hi, CASE WHEN n < 30 THEN 'exploratory' WHEN n < 50 THEN 'early' WHEN n < 100 THEN 'conservative' WHEN n < 200 THEN 'calibrated' ELSE 'production' END AS tier
FROM (SELECT *, (wins + 2) / (n + 4) AS m, sqrt((wins + 2) * (n - wins + 2) / ((n + 4) * (n + 4) * (n + 5))) AS s FROM c) JOIN (SELECT supplier, max(CASE WHEN share < 0.5 THEN (lo + hi) / 2 END) AS el, max(CASE WHEN share > 0.5 THEN (lo + hi) / 2 END) AS eh FROM q WHERE i = 40 GROUP BY supplier) USING (supplier)"""
)
def win_rate_intervals(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    counts = lines.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if(F.col("l_discount") > F.col("l_tax")).alias("wins"), F.count("*").alias("n"))
    return G.win_rates(counts).withColumns({c: rounded(c) for c in ("mean", "exact_lo", "exact_hi", "normal_lo", "normal_hi")})


_INSIDE = "abs(price - ref) <= ref * zone / 100 AND CASE side WHEN 'bid' THEN price <= ref ELSE price >= ref END"


@query(
    f"""WITH {_LEVELS}, rf AS (SELECT symbol, round(avg(price)) AS ref FROM lv GROUP BY symbol),
w AS (SELECT symbol, zone, side, sum(price * qty * exp(-2.0::DOUBLE / zone * (abs(price - ref) / ref * 100))) AS money, max(abs(price - ref) / ref * 100) AS far FROM lv JOIN rf USING (symbol), (VALUES (0.5::DOUBLE), (1), (2), (5)) z(zone) WHERE {_INSIDE} AND qty > 0 GROUP BY 1, 2, 3),
v AS (SELECT symbol, zone, coalesce(sum(money) FILTER (side = 'bid'), 0) AS bid, coalesce(sum(money) FILTER (side = 'ask'), 0) AS ask, least(coalesce(max(far) FILTER (side = 'bid'), 0), coalesce(max(far) FILTER (side = 'ask'), 0), zone) AS covered FROM w GROUP BY 1, 2)
SELECT symbol, zone AS zone_pct, {r('(bid - ask) / (bid + ask)')} AS imbalance, {r('covered')} AS covered_pct FROM v"""
)
def imbalance_by_zone(spark: SparkSession, folder: str) -> DataFrame:
    return L.imbalance_by_zone(_levels(spark, folder), _refs(spark, folder)).withColumns({c: rounded(c) for c in ("imbalance", "covered_pct")})


@query(
    _sql(
        f"SELECT symbol, count(*) AS bars, min(ts_s) AS first_s, max(ts_s) AS last_s, 0::BIGINT AS repeats, count_if(coalesce(step > 5400, false)) AS gaps, {r('least(100, 100 * count(*) / greatest(1, (max(ts_s) - min(ts_s)) // 3600))')} AS coverage_pct FROM (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY symbol ORDER BY ts_s) AS step FROM b) GROUP BY symbol"
    )
)
def history_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return H.coverage(hourly(spark, folder), 3600).withColumn("coverage_pct", rounded("coverage_pct"))


@query(
    _sql(
        f"SELECT k.symbol, k.ts_s, {r('100 * e.y / nullif(k.close, 0)')} AS natr14, {r('k.k')} AS stoch_k, {r(full(3, 'avg(k.k) ' + over(3), 'count(k.k) ' + over(3)))} AS stoch_d, {r('close - lag(close, 5) ' + LINE)} AS delta5 FROM (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM (SELECT *, {full(14, 'max(high) ' + over(14))} AS hi, {full(14, 'min(low) ' + over(14))} AS lo FROM t)) k LEFT JOIN e USING (symbol, rn)",
        more=_TR + ", " + recursion("e", "t", "tr", 1 / 14, 14),
        recursive=True,
    )
)
def natr_stochastic(spark: SparkSession, folder: str) -> DataFrame:
    bars = K.natr(hourly(spark, folder), 14)
    return shown(R.with_stochastic(bars), natr14="natr14", stoch_k="stoch_k", stoch_d="stoch_d", delta5=R.delta("close", 5))


_PAIRS = [("qty", "price"), ("qty", "discount"), ("price", "discount")]


@query(
    "WITH l AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS qty, CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice END AS price, l_discount AS discount FROM lineitem) "
    + " UNION ALL ".join(f"SELECT k, '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})', 5)} AS r FROM l GROUP BY k" for a, b in _PAIRS)
)
def pearson_matrix(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    price = F.when(F.col("l_partkey") % 5 > 0, F.col("l_extendedprice")).alias("price")
    rows = lines.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("double").alias("qty"), price, F.col("l_discount").alias("discount"))
    return S.pearson(rows, "k", ["qty", "price", "discount"]).withColumn("r", rounded("r", 5))


@query(
    f"""WITH {TRADES}, ref AS (SELECT symbol, arg_max(price, struct_pack(a := us, b := trade_id)) AS ref FROM trades GROUP BY symbol),
f AS (SELECT symbol, least(floor((price - ref * 0.5) / (ref * 1.0 / 20)), 19)::INTEGER AS bucket, sum(CASE WHEN is_buy THEN price * qty ELSE 0 END) - sum(CASE WHEN NOT is_buy THEN price * qty ELSE 0 END) AS net FROM trades JOIN ref USING (symbol) WHERE abs(price / ref - 1) <= 0.5 GROUP BY 1, 2),
g AS (SELECT symbol, sign(net)::INTEGER AS side, bucket, bucket - row_number() OVER (PARTITION BY symbol, sign(net) ORDER BY bucket) AS island FROM f WHERE net <> 0)
SELECT symbol, side, min(bucket) AS first, count(*) AS n FROM g GROUP BY symbol, side, island HAVING count(*) >= 2"""
)
def stacked_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    return L.stacked_imbalance(L.footprint(_trades(spark, folder), 20, 0.5), 2)


@query(
    """WITH c AS (SELECT l_returnflag AS symbol, l_linestatus AS action, l_suppkey::DOUBLE AS entry_lo, l_suppkey + 1.0::DOUBLE AS entry_hi, l_discount AS strength, l_tax AS confidence, l_quantity::DOUBLE AS rr, l_orderkey * 10 + l_linenumber AS candidate_id FROM lineitem)
SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY symbol, action, entry_lo, entry_hi ORDER BY strength DESC, confidence DESC, rr DESC, candidate_id) AS k FROM c) WHERE k = 1"""
)
def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    entry = F.col("l_suppkey").cast("double")
    given = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("action"), entry.alias("entry_lo"), (entry + 1).alias("entry_hi"), F.col("l_discount").alias("strength"), F.col("l_tax").alias("confidence"),
        F.col("l_quantity").cast("double").alias("rr"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"),
    )
    return G.best_candidates(given)
