"""Queries of context, figures and the indicator columns built on recursive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio, rounded
from tidemark.operators import bars as B
from tidemark.operators import context as C
from tidemark.operators import figures as G
from tidemark.operators import recursive as K
from tidemark.operators import windows as R
from tidemark.plans.aggregates import rounding
from tidemark.plans.market import _TR, _pivots, _sql, _swings, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.relations import _trades
from tidemark.plans.sql import LINE, TRADES, full, over, r, recursion
from tidemark.sources.tables import table


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('hi - 3 * y')} AS long_stop, {r('lo + 3 * y')} AS short_stop FROM (SELECT t.symbol, t.ts_s, e.y, {full(22, 'max(high) ' + over(22))} AS hi, {full(22, 'min(low) ' + over(22))} AS lo FROM (SELECT * FROM t) t LEFT JOIN e USING (symbol, rn))".replace("OVER (PARTITION BY symbol ORDER BY ts_s", "OVER (PARTITION BY t.symbol ORDER BY t.ts_s"),
        more=_TR + ", " + recursion("e", "t", "tr", 1 / 22, 22),
        recursive=True,
    )
)
def chandelier22(spark: SparkSession, folder: str) -> DataFrame:
    df = K.atr(hourly(spark, folder), 22)
    return shown(df, long_stop=R.rolling(F.max, "high", 22) - 3 * F.col("atr22"), short_stop=R.rolling(F.min, "low", 22) + 3 * F.col("atr22"))


@query(
    _sql(
        f"""SELECT symbol, ts_s, {r(f'coalesce(CASE WHEN count(rsi) {over(14)} = 14 THEN (rsi - min(rsi) {over(14)}) / nullif((max(rsi) {over(14)}) - (min(rsi) {over(14)}), 0) END, 0.5)')} AS stoch_rsi FROM (
  SELECT t.symbol, t.ts_s, 100 * u.y / nullif(u.y + d.y, 0) AS rsi FROM t LEFT JOIN u ON u.symbol = t.symbol AND u.rn = t.rn LEFT JOIN d ON d.symbol = t.symbol AND d.rn = t.rn)""",
        more=_TR + ", " + recursion("u", "t", "up", 1 / 14, 14, 1) + ", " + recursion("d", "t", "dn", 1 / 14, 14, 1),
        recursive=True,
    )
)
def stoch_rsi14(spark: SparkSession, folder: str) -> DataFrame:
    df = K.rsi(hourly(spark, folder), 14)
    low, high = R.rolling(F.min, "rsi14", 14), R.rolling(F.max, "rsi14", 14)
    return shown(df, stoch_rsi=F.coalesce(ratio(F.col("rsi14") - low, high - low), F.lit(0.5)))


@query(
    _sql(
        f"""SELECT b.symbol, b.ts_s, {r('k.y')} AS k, {r('d.y')} AS d, {r('3 * k.y - 2 * d.y')} AS j FROM b LEFT JOIN k ON k.symbol = b.symbol AND k.rn = b.rn LEFT JOIN d ON d.symbol = b.symbol AND d.rn = b.rn""",
        more=f"""q AS (SELECT symbol, ts_s, rn, coalesce(100 * (close - lo) / nullif(hi - lo, 0), 50) AS rsv FROM (SELECT *, max(high) {over(9)} AS hi, min(low) {over(9)} AS lo FROM b) WHERE rn >= 9),
k AS (SELECT symbol, rn, 50 + (rsv - 50) / 3.0::DOUBLE AS y FROM q WHERE rn = 9 UNION ALL SELECT q.symbol, q.rn, k.y + (q.rsv - k.y) / 3.0::DOUBLE FROM k JOIN q ON q.symbol = k.symbol AND q.rn = k.rn + 1),
d AS (SELECT symbol, rn, 50 + (y - 50) / 3.0::DOUBLE AS y FROM k WHERE rn = 9 UNION ALL SELECT k.symbol, k.rn, d.y + (k.y - d.y) / 3.0::DOUBLE FROM d JOIN k ON k.symbol = d.symbol AND k.rn = d.rn + 1)""",
        recursive=True,
    )
)
def kdj9(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.kdj(hourly(spark, folder)), k="k", d="d", j="j")


@query(
    _sql(f"""SELECT symbol, ts_s, {r(f'close - lag(close, 10) {LINE}')} AS mom10, {r(f'(close - lag(close, 10) {LINE}) / nullif(lag(close, 10) {LINE}, 0)')} AS rocp10,
{r(full(20, f'(lag(close, 11) {LINE}) - avg(close) {over(20)}'))} AS dpo20, {r(full(6, f'100 * (close - avg(close) {over(6)}) / nullif(avg(close) {over(6)}, 0)'))} AS bias6,
{r(f'CASE WHEN count(rise) {over(12)} = 12 THEN 100 * avg(rise) {over(12)} END')} AS psy12, {r(f'CASE WHEN count(emv) {over(14)} = 14 THEN avg(emv) {over(14)} END')} AS emv14
FROM (SELECT *, (close > lag(close) {LINE})::INTEGER AS rise, ((high + low) / 2 - ((lag(high) {LINE}) + (lag(low) {LINE})) / 2) * (high - low) / nullif(volume, 0) AS emv FROM b)""")
)
def extended_columns(spark: SparkSession, folder: str) -> DataFrame:
    return shown(C.with_extended(hourly(spark, folder)), **{c: c for c in ("mom10", "rocp10", "dpo20", "bias6", "psy12", "emv14")})


@query(
    _sql(f"""SELECT symbol, {r('CASE WHEN n >= 10 THEN CASE WHEN sigma <= 1e-12 THEN 0 ELSE (last - mean) / sigma END END')} AS z, CASE WHEN up >= 3 THEN 'rising' WHEN dn >= 3 THEN 'falling' ELSE 'mixed' END AS trend, {r('extreme')} AS extreme FROM (
  SELECT symbol, count(*) AS n, arg_max(close, ts_s) AS last, avg(close) AS mean, stddev_samp(close) AS sigma, sum((k <= 4 AND d > 0)::INTEGER) AS up, sum((k <= 4 AND d < 0)::INTEGER) AS dn, max(abs(close)) AS extreme
  FROM (SELECT *, close - lag(close) {LINE} AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS k FROM b) GROUP BY symbol)""")
)
def funding_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(C.funding_stats(hourly(spark, folder), "close"))


@query(_sql(f"SELECT symbol, ts_s, {r(f'volume / nullif(lag(volume, 4) {LINE}, 0) - 1')} AS oi_change FROM b"))
def oi_change(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), oi_change=C.change_over("volume", 4))


@query(
    f"""WITH {TRADES}, a AS (SELECT symbol, us // 1000 - lag(us // 1000) OVER (PARTITION BY symbol ORDER BY us // 1000) AS d FROM trades), q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, floor(count(*) OVER (PARTITION BY symbol) * 0.9)::BIGINT AS p FROM a WHERE d IS NOT NULL)
SELECT symbol, {r('quantile_cont(d, 0.5)')} AS median_ms, max(CASE WHEN i = p THEN d END) AS p90_ms, max(d) AS max_ms, count(*) AS n FROM q GROUP BY symbol"""
)
def arrival_cadence(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(C.cadence(_trades(spark, folder).select("symbol", F.unix_millis("ts").alias("ms")), "symbol", "ms"))


@query(
    _sql(f"""SELECT symbol, {r('p')} AS pivot, {r('2 * p - l')} AS r1, {r('2 * p - h')} AS s1, {r('p + h - l')} AS r2, {r('p - h + l')} AS s2 FROM (SELECT symbol, max(high) AS h, min(low) AS l, (max(high) + min(low) + arg_max(close, ts_s)) / 3 AS p
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS n FROM b) WHERE n <= 48 GROUP BY symbol)""")
)
def classic_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(C.classic_pivots(hourly(spark, folder)))


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as derivative snapshots; some planes are not measured."""
    c = table(spark, folder, "customer")
    x, n = F.col("c_acctbal") / 10_000, F.col("c_nationkey")
    only = lambda every, v: F.when(n % every != 0, v)
    return c.select(
        F.col("c_custkey").alias("key"), F.when(n % 7 == 0, "none").when(n % 2 == 0, "long").otherwise("short").alias("direction"),
        only(5, x / 500).alias("funding"), only(3, 0.3 + x * 2).alias("long_short"), only(4, 0.5 + x).alias("taker"), only(2, x * 3 - 1).alias("oi_change"), only(6, x - 0.4).alias("price_change"),
        only(8, x * x * 10).alias("bid_qty"), F.lit(4.0).alias("ask_qty"), (x * 1.5).alias("depth_imbalance"), F.lit(100.0).alias("bid"), (100 + F.abs(x) / 5).alias("ask"), only(9, x / 5).alias("basis_pct"),
        F.when(n % 10 == 0, x).alias("liquidation_score"), only(11, x * 100).alias("liq_long"), only(12, F.lit(30.0)).alias("liq_short"),
    )


def _side(a: float, b: float) -> str:
    return f"CASE WHEN d > 0 THEN {a} ELSE {b} END"


_PLANES = {
    "f": (f"CASE WHEN f IS NOT NULL THEN (CASE WHEN abs(f) < 0.0002 THEN 0.05 WHEN f > 0 THEN {_side(-0.25, 0.25)} ELSE {_side(0.25, -0.25)} END) * CASE WHEN abs(f) >= 0.001 THEN 2 ELSE 1 END END", 0.18),
    "l": (f"CASE WHEN ls > 0 THEN CASE WHEN ls >= 2 THEN {_side(-0.4, 0.25)} WHEN ls >= 1.6 THEN {_side(-0.25, 0.18)} WHEN ls <= 0.5 THEN {_side(0.25, -0.4)} WHEN ls <= 0.65 THEN {_side(0.18, -0.25)} ELSE 0 END END", 0.15),
    "t": (f"CASE WHEN tk > 0 THEN CASE WHEN tk >= 1.25 THEN {_side(0.45, -0.35)} WHEN tk <= 0.8 THEN {_side(-0.35, 0.45)} ELSE 0 END END", 0.18),
    "o": ("""CASE WHEN oi IS NULL THEN NULL WHEN abs(oi) < 0.15 THEN 0 WHEN dp IS NULL OR d = 0 THEN CASE WHEN oi > 0 THEN 0.1 ELSE -0.05 END
      WHEN sign(d) = CASE WHEN dp > 0 THEN 1 ELSE -1 END THEN CASE WHEN oi > 0 THEN 0.35 ELSE 0.15 END ELSE CASE WHEN oi > 0 THEN -0.25 ELSE -0.1 END END""", 0.16),
    "b": ("d * CASE WHEN bq + 4 > 0 THEN (bq - 4) / (bq + 4) ELSE greatest(-1, least(1, x * 1.5)) END", 0.12),
    "s": ("CASE WHEN spread <= 2 THEN 0.15 WHEN spread <= 8 THEN 0 ELSE -0.35 END", 0.06),
    "p": (f"CASE WHEN bs IS NULL THEN NULL WHEN bs > 0.08 THEN {_side(0.18, -0.12)} WHEN bs < -0.04 THEN {_side(-0.12, 0.18)} ELSE 0 END", 0.07),
    "q": ("CASE WHEN sc IS NOT NULL OR ll + sh > 0 THEN greatest(-1, least(1, d * coalesce(sc, (sh - ll) / nullif(ll + sh, 0)))) END", 0.08),
}
_HAVE = " + ".join(f"CASE WHEN s_{k} IS NOT NULL THEN {w} ELSE 0 END" for k, (_, w) in _PLANES.items())
_SUM = " + ".join(f"coalesce(s_{k} * {w}, 0)" for k, (_, w) in _PLANES.items())


@query(
    f"""WITH v AS (SELECT *, CASE WHEN n % 7 = 0 THEN 0 WHEN n % 2 = 0 THEN 1 ELSE -1 END AS d, CASE WHEN n % 5 <> 0 THEN x / 500 END AS f, CASE WHEN n % 3 <> 0 THEN 0.3 + x * 2 END AS ls, CASE WHEN n % 4 <> 0 THEN 0.5 + x END AS tk,
  CASE WHEN n % 2 <> 0 THEN x * 3 - 1 END AS oi, CASE WHEN n % 6 <> 0 THEN x - 0.4 END AS dp, CASE WHEN n % 8 <> 0 THEN x * x * 10 END AS bq, (abs(x) / 5) / (100 + abs(x) / 10) * 10000 AS spread, CASE WHEN n % 9 <> 0 THEN x / 5 END AS bs,
  CASE WHEN n % 10 = 0 THEN x END AS sc, greatest(coalesce(CASE WHEN n % 11 <> 0 THEN x * 100 END, 0), 0) AS ll, CASE WHEN n % 12 <> 0 THEN 30 ELSE 0 END AS sh
  FROM (SELECT c_custkey AS key, c_nationkey AS n, c_acctbal / 10000 AS x FROM customer)),
p AS (SELECT *, {", ".join(f"({e})::DOUBLE AS s_{k}" for k, (e, _) in _PLANES.items())} FROM v),
m AS (SELECT *, coalesce(greatest(-1, least(1, ({_SUM}) / nullif({_HAVE}, 0))), 0) AS score, ({_HAVE}) / 1.0 AS confidence, (coalesce(abs(f) >= 0.001, false))::INTEGER + (coalesce(ls >= 2 OR ls <= 0.5, false))::INTEGER + (spread > 8)::INTEGER AS warned FROM p)
SELECT CASE WHEN round(score, 9) >= 0.35 THEN 'supportive' WHEN round(score, 9) <= -0.35 THEN 'against' ELSE 'mixed' END AS label, count(*) AS n, {r('avg(score)')} AS score, {r('avg(confidence)')} AS confidence, sum(warned)::BIGINT AS warnings FROM m GROUP BY 1"""
)
def microstructure_context(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(C.summarised(C.microstructure(_snapshots(spark, folder))))


_REASON = "CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 9000 THEN 'outlier' END"


@query(
    f"""WITH q AS (SELECT {_REASON} AS reason FROM customer), a AS (SELECT count(*) AS total, count(reason) AS failing FROM q), d AS (SELECT reason FROM (SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason) ORDER BY n DESC, reason DESC LIMIT 1)
SELECT total::BIGINT AS total, failing::BIGINT AS failing, (SELECT reason FROM d) AS dominant, {r('failing::DOUBLE / total')} AS share, CASE WHEN failing::DOUBLE / total >= 0.9 THEN 'critical' WHEN failing::DOUBLE / total >= 0.5 THEN 'degraded' ELSE 'healthy' END AS state FROM a"""
)
def universe_health(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") > 9000, "outlier")
    return rounding(C.universe_health(table(spark, folder, "customer"), reason))


@query(_sql("SELECT symbol, tf, n, n >= CASE tf WHEN '1h' THEN 600 ELSE 200 END AS ready FROM (SELECT symbol, '1h' AS tf, count(*) AS n FROM b GROUP BY symbol UNION ALL SELECT symbol, '4h', count(DISTINCT ts_s // 14400) FROM b GROUP BY symbol)"))
def data_readiness(spark: SparkSession, folder: str) -> DataFrame:
    fine = hourly(spark, folder)
    both = fine.select("symbol", F.lit("1h").alias("tf")).unionAll(B.coarser(fine, "4 hours").select("symbol", F.lit("4h").alias("tf")))
    return C.readiness(both, {"1h": 600, "4h": 200})


@query(
    _sql(f"""SELECT symbol, {r('(h2 - l2) / nullif(h1 - l1, 0)')} AS range_ratio, {r('((h2 + l2) - (h1 + l1)) / nullif(h1 + l1, 0)')} AS drift, (h2 - l2) / nullif(h1 - l1, 0) <= 0.7 AS narrow, (h2 - l2) / nullif(h1 - l1, 0) <= 0.7 AND abs(((h2 + l2) - (h1 + l1)) / nullif(h1 + l1, 0)) >= 0.05 AS wedge FROM (
  SELECT symbol, count(*) AS n, max(CASE WHEN k <= 20 THEN high END) AS h2, min(CASE WHEN k <= 20 THEN low END) AS l2, max(CASE WHEN k > 20 THEN high END) AS h1, min(CASE WHEN k > 20 THEN low END) AS l1
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS k FROM b) WHERE k <= 40 GROUP BY symbol) WHERE n = 40""")
)
def narrowing(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(C.narrowing(hourly(spark, folder)))


def _recent(n: int) -> str:
    """CTEs w (the last n bars of a symbol, i from 0, last) and p (their pivots: i, kind, price, zone, seq)."""
    before, after = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"
    return f"""w AS (SELECT *, rn - min(rn) OVER (PARTITION BY symbol) AS i, max(rn) OVER (PARTITION BY symbol) - min(rn) OVER (PARTITION BY symbol) AS last FROM (SELECT *, max(rn) OVER (PARTITION BY symbol) AS top FROM b) WHERE rn > top - {n}),
f AS (SELECT *, count(*) {before} = 3 AND count(*) {after} = 1 AND high > max(high) {before} AND high > max(high) {after} AS ph, count(*) {before} = 3 AND count(*) {after} = 1 AND low < min(low) {before} AND low < min(low) {after} AS pl FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, kind) AS seq FROM (
  SELECT symbol, i, 'high' AS kind, high AS price, greatest(open, close) AS zlo, high AS zhi FROM f WHERE ph UNION ALL SELECT symbol, i, 'low', low, low, least(open, close) FROM f WHERE pl))"""


@query(
    _sql(
        f"""SELECT symbol, side, {r('lft')} AS "left", {r('head')} AS head, {r('rgt')} AS "right" FROM (
  SELECT t.symbol, CASE t.kind WHEN 'high' THEN 'short' ELSE 'long' END AS side, t.li, t.lft, t.head, t.rgt, count(*) AS n, max(q.price) AS hi, min(q.price) AS lo FROM (
    SELECT a.symbol, a.kind, a.i AS li, c.i AS ri, a.price AS lft, h.price AS head, c.price AS rgt FROM s a JOIN s h ON h.symbol = a.symbol AND h.kind = a.kind AND h.k = a.k + 1 JOIN s c ON c.symbol = a.symbol AND c.kind = a.kind AND c.k = a.k + 2
    WHERE a.k > a.m - 60 AND a.price > 0 AND c.price > 0 AND abs(c.price - a.price) / a.price <= 0.08
      AND CASE a.kind WHEN 'high' THEN h.price > greatest(a.price, c.price) AND h.price / greatest(a.price, c.price) - 1 >= 0.03 ELSE h.price < least(a.price, c.price) AND (least(a.price, c.price) - h.price) / h.price >= 0.03 END) t
  JOIN p q ON q.symbol = t.symbol AND q.kind <> t.kind AND q.i > t.li AND q.i < t.ri AND q.price > 0 GROUP BY ALL) WHERE n >= 2 AND hi / lo - 1 <= 20""",
        more=_recent(700) + ", s AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY i) AS k, count(*) OVER (PARTITION BY symbol, kind) AS m FROM p)",
    )
)
def head_and_shoulders(spark: SparkSession, folder: str) -> DataFrame:
    # Prices here jump, so a leaning neckline is let through; the operator's own bounds are the method's.
    return rounding(G.head_and_shoulders(hourly(spark, folder), 700, 60, 20.0))


_FLIPS = """c AS (SELECT symbol, arg_max(close, i) AS close FROM w GROUP BY symbol), z AS (SELECT p.*, max(seq) OVER (PARTITION BY p.symbol) AS total, close FROM p JOIN c USING (symbol)),
tp AS (SELECT symbol, arg_max(i, struct_pack(a := price, b := -seq)) AS i FROM z WHERE kind = 'high' AND seq > total - 6 GROUP BY symbol),
bt AS (SELECT symbol, arg_min(i, struct_pack(a := price, b := seq)) AS i FROM z WHERE kind = 'low' AND seq > total - 6 GROUP BY symbol),
pr AS (SELECT a.symbol, a.price AS ahead, o.* EXCLUDE (symbol), a.kind AS first FROM z a JOIN z o ON o.symbol = a.symbol AND o.seq = a.seq + 1 AND o.kind <> a.kind),
hit AS (
  SELECT z.symbol, 'short' AS side, 'true' AS kind, price AS level, zlo, zhi FROM z JOIN tp ON tp.symbol = z.symbol AND z.i < tp.i WHERE kind = 'low' QUALIFY row_number() OVER (PARTITION BY z.symbol ORDER BY seq DESC) = 1 AND close < price
  UNION ALL SELECT z.symbol, 'long', 'true', price, zlo, zhi FROM z JOIN bt ON bt.symbol = z.symbol AND z.i < bt.i WHERE kind = 'high' QUALIFY row_number() OVER (PARTITION BY z.symbol ORDER BY seq DESC) = 1 AND close > price
  UNION ALL SELECT symbol, CASE first WHEN 'high' THEN 'short' ELSE 'long' END, 'early', price, zlo, zhi FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY symbol, first ORDER BY seq DESC) = 1) q
    WHERE CASE first WHEN 'high' THEN close < price AND NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = q.symbol AND p.i > q.i AND p.kind = 'high' AND p.price > q.ahead) ELSE close > price AND NOT EXISTS (SELECT 1 FROM p WHERE p.symbol = q.symbol AND p.i > q.i AND p.kind = 'low' AND p.price < q.ahead) END)"""


@query(
    _sql(
        f"""SELECT symbol, side, kind, {r('level')} AS level, {r('zlo')} AS zone_lo, {r('zhi')} AS zone_hi,
(SELECT max(last) - coalesce(max(CASE WHEN NOT CASE side WHEN 'short' THEN greatest(open, close) < level ELSE least(open, close) > level END THEN i END), -1) FROM w WHERE w.symbol = hit.symbol)::INTEGER AS bodies FROM hit""",
        more=_recent(150) + ", " + _FLIPS,
    )
)
def trend_flips(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(G.flips(hourly(spark, folder), 150))


_EDGES = "e AS (SELECT symbol, side, CASE side WHEN 'short' THEN quantile_cont(high, 0.7) ELSE quantile_cont(low, 0.3) END AS level FROM w CROSS JOIN (VALUES ('short'), ('long')) s(side) GROUP BY symbol, side)"


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """A level above and one below the newest bars of each symbol."""
    recent = G.newest(hourly(spark, folder), 60)
    both = recent.groupBy("symbol").agg(F.percentile("high", F.lit(0.7)).alias("short"), F.percentile("low", F.lit(0.3)).alias("long"))
    return both.unpivot("symbol", ["short", "long"], "side", "level")


@query(
    _sql(
        f"""SELECT symbol, side, {r('level')} AS level, bodies, CASE WHEN bodies >= 2 THEN 'proboy' WHEN wick THEN 'prokol' WHEN bodies > 0 THEN 'testing' END AS touch FROM (
  SELECT e.symbol, e.side, e.level, (max(last) - coalesce(max(CASE WHEN NOT CASE side WHEN 'short' THEN least(open, close) > level ELSE greatest(open, close) < level END THEN i END), -1))::INTEGER AS bodies,
    bool_or(i > last - 2 AND CASE side WHEN 'short' THEN high > level AND close <= level ELSE low < level AND close >= level END) AS wick FROM e JOIN w USING (symbol) GROUP BY 1, 2, 3)""",
        more=_recent(60) + ", " + _EDGES,
    )
)
def level_touches(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(G.touches(_edges(spark, folder), hourly(spark, folder)).select("symbol", "side", "level", "bodies", "touch"))


@query(
    _sql(
        f"""SELECT e.symbol, e.side, {r('e.level')} AS level, count_if(open < level AND close > level) >= 3 AND count_if(open > level AND close < level) >= 3 AS saw FROM e JOIN w USING (symbol) WHERE i > last - 24 GROUP BY e.symbol, e.side, e.level""",
        more=_recent(60) + ", " + _EDGES,
    )
)
def level_saws(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(G.saws(_edges(spark, folder), hourly(spark, folder), 24).select("symbol", "side", "level", "saw"))


@query(
    _sql(
        f"""SELECT symbol, ts_s, side, CASE WHEN (side = 'bear' AND p > 0) OR (side = 'bull' AND p < 0) THEN 'regular' ELSE 'hidden' END AS kind FROM (
  SELECT symbol, ts_s, 'bear' AS side, sign(high - lag(high) {LINE}) AS p, sign(rsi - lag(rsi) {LINE}) AS i FROM z WHERE ph AND rsi IS NOT NULL
  UNION ALL SELECT symbol, ts_s, 'bull', sign(low - lag(low) {LINE}), sign(rsi - lag(rsi) {LINE}) FROM z WHERE pl AND rsi IS NOT NULL) WHERE p * i < 0""",
        more=", ".join(
            [
                _pivots(3, 1), _TR, recursion("u", "t", "up", 1 / 14, 14, 1), recursion("d", "t", "dn", 1 / 14, 14, 1),
                "z AS (SELECT piv.*, 100 * u.y / nullif(u.y + d.y, 0) AS rsi FROM piv LEFT JOIN u ON u.symbol = piv.symbol AND u.rn = piv.rn LEFT JOIN d ON d.symbol = piv.symbol AND d.rn = piv.rn)",
            ]
        ),
        recursive=True,
    )
)
def rsi_divergence_pivots(spark: SparkSession, folder: str) -> DataFrame:
    rsi = K.rsi(hourly(spark, folder), 14).select("symbol", "ts", "rsi14")
    return shown(C.pivot_divergence(_swings(spark, folder, 3, 1).join(rsi, ["symbol", "ts"]), "rsi14"), side="side", kind="kind")


@query(
    """WITH s AS (SELECT l_returnflag AS symbol, l_linestatus AS side, l_partkey AS price, abs(l_partkey - 500) AS distance, sum(l_quantity)::DOUBLE AS strength FROM lineitem GROUP BY 1, 2, 3)
SELECT symbol, side, price, near, strong FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY distance, price)::INTEGER AS near, row_number() OVER (PARTITION BY symbol, side ORDER BY strength DESC, price)::INTEGER AS strong FROM s) WHERE near <= 2 OR strong <= 2"""
)
def rank_rungs(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")  # noqa: E741
    levels = l.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("side"), F.col("l_partkey").alias("price")).agg(F.sum("l_quantity").cast("double").alias("strength"))
    return C.rungs(levels.withColumn("distance", F.abs(F.col("price") - 500))).select("symbol", "side", "price", "near", "strong")


@query(_sql("SELECT symbol, ts_s, sha256('zone|long|' || floor(ln(high) / ln(1.01::DOUBLE))::BIGINT)[1:16] AS setup_id FROM piv WHERE ph AND high > 0", more=_pivots(5, 5)))
def setup_ids(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_swings(spark, folder, 5, 5).where("ph AND high > 0"), setup_id=C.setup_id(F.lit("zone"), F.col("high"), F.lit("long")))


@query(
    """WITH t AS (SELECT o_custkey AS symbol, o_orderstatus AS tf, CASE WHEN sum(o_totalprice) > 300000 THEN 'bull' WHEN sum(o_totalprice) < 120000 THEN 'bear' ELSE 'neutral' END AS trend FROM orders GROUP BY 1, 2),
w AS (SELECT symbol, max(CASE WHEN tf = 'F' THEN trend END) AS "F", max(CASE WHEN tf = 'O' THEN trend END) AS "O", max(CASE WHEN tf = 'P' THEN trend END) AS "P" FROM t GROUP BY symbol)
SELECT *, CASE WHEN coalesce("F", 'neutral') <> coalesce("O", 'neutral') OR coalesce("F", 'neutral') = 'neutral' THEN 'neutral' ELSE "F" END AS bias FROM w"""
)
def timeframe_votes(spark: SparkSession, folder: str) -> DataFrame:
    total = F.sum("o_totalprice")
    trend = F.when(total > 300_000, "bull").when(total < 120_000, "bear").otherwise("neutral")
    t = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.col("o_orderstatus").alias("tf")).agg(trend.alias("trend"))
    return C.votes(t, ["F", "O", "P"], ["F", "O"])


@query(
    f"""WITH q AS (SELECT o_orderpriority AS symbol, o_orderstatus AS action, o_totalprice AS strength, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS t FROM orders)
SELECT symbol, count_if(action = 'F')::BIGINT AS "F", count_if(action = 'O')::BIGINT AS "O", count_if(action = 'P')::BIGINT AS "P", {r('avg(strength)', 4)} AS strength, {r('max(CASE WHEN i = floor(t * 0.25) THEN strength END)')} AS gate FROM q GROUP BY symbol"""
)
def gate_calibration(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("action"), F.col("o_totalprice").alias("strength"))
    out = C.calibration(s, ["F", "O", "P"])
    return out.withColumns({"strength": rounded("strength", 4), "gate": rounded("gate")})


@query(
    f"""WITH {TRADES}, f AS (SELECT symbol, arg_min(price, struct_pack(a := us, b := trade_id)) AS p0, arg_max(price, struct_pack(a := us, b := trade_id)) AS p1, sum(CASE WHEN is_buy THEN price ELSE -price END) / nullif(sum(price), 0) AS share FROM trades GROUP BY symbol)
SELECT symbol, {r('share')} AS share, CASE WHEN p1 > p0 AND share <= -0.01 THEN 'bearish' WHEN p1 < p0 AND share >= 0.01 THEN 'bullish' END AS divergence FROM f"""
)
def flow_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(C.flow_divergence(_trades(spark, folder), 0.01))


@query(
    _sql(
        """SELECT a.symbol, a.horizon, a.zone_s FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE a.symbol = b.symbol AND a.horizon <> b.horizon AND a.lo <= b.hi AND b.lo <= a.hi AND (a.volume < b.volume OR (a.volume = b.volume AND a.zone_s > b.zone_s)))""",
        more="z AS (SELECT symbol, CASE WHEN ts_s % 14400 = 0 THEN '4h' ELSE '1h' END AS horizon, ts_s AS zone_s, low AS lo, least(high, low * 1.02) AS hi, quote_volume AS volume FROM b)",
    )
)
def zone_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    s = F.unix_seconds("ts")
    zones = hourly(spark, folder).select("symbol", F.when(s % 14_400 == 0, "4h").otherwise("1h").alias("horizon"), s.alias("zone_id"), F.col("low").alias("lo"), F.least("high", F.col("low") * 1.02).alias("hi"), F.col("quote_volume").alias("volume"))
    return C.overlapping(zones).select("symbol", "horizon", F.col("zone_id").alias("zone_s"))


@query(
    _sql(
        f"""SELECT symbol, step, {r('v')} AS price FROM f WHERE step > 0 AND v IS NOT NULL""",
        more=_pivots(5, 5)
        + """, c AS (SELECT symbol, arg_max(close, ts_s) AS entry FROM b GROUP BY symbol), f AS (SELECT symbol, 0 AS step, entry AS v FROM c UNION ALL
  SELECT symbol, step + 1, (SELECT min(high) FROM piv p WHERE p.ph AND p.symbol = f.symbol AND p.high >= f.v * 1.05) FROM f WHERE step < 5 AND v IS NOT NULL)""",
        recursive=True,
    )
)
def target_ladders(spark: SparkSession, folder: str) -> DataFrame:
    levels = _swings(spark, folder, 5, 5).where("ph").select("symbol", F.col("high").alias("price"))
    last = hourly(spark, folder).groupBy("symbol").agg(F.max_by("close", "ts").alias("entry"))
    return rounding(C.ladders(levels, last, 0.05, 5))


@query(
    _sql(
        f"""SELECT q.symbol, q.ts_s, on_::INTEGER AS squeeze_on, off_::INTEGER AS squeeze_off, greatest(1 - on_::INTEGER - off_::INTEGER, 0)::INTEGER AS squeeze_no, {r('coalesce(h.y, 0)')} AS squeeze_hist FROM (
  SELECT symbol, ts_s, rn, coalesce(m - 2 * s > kl AND m + 2 * s < ku, false) AS on_, coalesce(m - 2 * s < kl AND m + 2 * s > ku, false) AS off_ FROM z) q LEFT JOIN h ON h.symbol = q.symbol AND h.rn = q.rn""",
        more=", ".join(
            [
                _TR.replace("coalesce(greatest", "(high + low + close) / 3 AS tp, coalesce(greatest"), recursion("e", "t", "tp", 2 / 21, 1), recursion("a", "t", "tr", 1 / 10, 10),
                f"""z AS (SELECT t.symbol, t.ts_s, t.rn, {full(20, 'avg(close) ' + over(20)).replace('rn >=', 't.rn >=')} AS m, {full(20, 'stddev_pop(close) ' + over(20)).replace('rn >=', 't.rn >=')} AS s, e.y + 1.5 * a.y AS ku, e.y - 1.5 * a.y AS kl,
  close - ((({full(20, '(max(high) ' + over(20) + ' + min(low) ' + over(20) + ') / 2').replace('rn >=', 't.rn >=')}) + {full(20, 'avg(close) ' + over(20)).replace('rn >=', 't.rn >=')}) / 2) AS away
  FROM t LEFT JOIN e ON e.symbol = t.symbol AND e.rn = t.rn LEFT JOIN a ON a.symbol = t.symbol AND a.rn = t.rn)""",
                recursion("h", "z", "away", 2 / 6, 1, 19),
            ]
        ).replace("PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 19", "PARTITION BY t.symbol ORDER BY t.ts_s ROWS BETWEEN 19"),
        recursive=True,
    )
)
def squeeze_momentum(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.squeeze(hourly(spark, folder)), **{f"squeeze_{c}": f"squeeze_{c}" for c in ("on", "off", "no", "hist")})


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('greatest(-50, least(50, sum(x - num / den) OVER (PARTITION BY symbol ORDER BY ts_s ROWS UNBOUNDED PRECEDING)))')} AS cusum FROM k JOIN s USING (symbol, rn)",
        more=f"""s AS (SELECT symbol, ts_s, rn, taker_buy / volume AS x FROM b), k AS (SELECT symbol, rn, x AS num, 1.0::DOUBLE AS den FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, k.num * (1 - 2.0 / 97) + s.x, k.den * (1 - 2.0 / 97) + 1 FROM k JOIN s ON s.symbol = k.symbol AND s.rn = k.rn + 1)""",
        recursive=True,
    )
)
def taker_cusum(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.cusum(hourly(spark, folder).withColumn("flow", ratio("taker_buy", "volume")), "flow"), cusum="cusum")


@query(
    _sql(
        f"""SELECT b.symbol, b.ts_s, {r(f'100 * (q.y / lag(q.y) OVER (PARTITION BY b.symbol ORDER BY b.ts_s) - 1)')} AS trix, {r('100 * (f.y - w.y) / w.y')} AS ppo FROM b
LEFT JOIN q ON q.symbol = b.symbol AND q.rn = b.rn LEFT JOIN f ON f.symbol = b.symbol AND f.rn = b.rn LEFT JOIN w ON w.symbol = b.symbol AND w.rn = b.rn""",
        more=", ".join([recursion("f", "b", "close", 2 / 13, 12, 14), recursion("w", "b", "close", 2 / 27, 26), recursion("x", "b", "close", 2 / 15, 14), recursion("v", "x", "y", 2 / 15, 14, 13), recursion("q", "v", "y", 2 / 15, 14, 26)]),
        recursive=True,
    )
)
def trix_ppo(spark: SparkSession, folder: str) -> DataFrame:
    return shown(K.trix_ppo(hourly(spark, folder)), trix="trix", ppo="ppo")


_ALL = ", ".join(
    [
        _TR, "y AS (SELECT *, (high + low + close) / 3 AS tp FROM t)",
        *[recursion(f"e{n}", "t", "close", 2 / (n + 1), n) for n in (20, 50, 200)], recursion("a", "t", "tr", 1 / 14, 14), recursion("w", "t", "tr", 1 / 10, 10), recursion("k", "y", "tp", 2 / 21, 1),
        recursion("u", "t", "up", 1 / 14, 14, 1), recursion("d", "t", "dn", 1 / 14, 14, 1), recursion("f", "t", "close", 2 / 13, 12, 14), recursion("s", "t", "close", 2 / 27, 26),
        "m AS (SELECT symbol, s.rn - 25 AS rn, f.y - s.y AS macd FROM s JOIN f USING (symbol, rn))", recursion("g", "m", "macd", 2 / 10, 9),
    ]
)


@query(
    _sql(
        f"""SELECT t.symbol, t.ts_s, {r('e20.y')} AS ema20, {r('e50.y')} AS ema50, {r('e200.y')} AS ema200, {r('a.y')} AS atr14, {r('100 * a.y / nullif(close, 0)')} AS natr14, {r('100 * u.y / nullif(u.y + d.y, 0)')} AS rsi14, {r('m.macd')} AS macd, {r('g.y')} AS macd_signal,
  {r('k.y')} AS kc_middle, {r('k.y + 2 * w.y')} AS kc_upper, {r('k.y - 2 * w.y')} AS kc_lower FROM t {' '.join(f'LEFT JOIN {c} ON {c}.symbol = t.symbol AND {c}.rn = t.rn' for c in ('e20', 'e50', 'e200', 'a', 'w', 'k', 'u', 'd'))}
  LEFT JOIN m ON m.symbol = t.symbol AND m.rn = t.rn - 25 LEFT JOIN g ON g.symbol = t.symbol AND g.rn = t.rn - 25""",
        more=_ALL,
        recursive=True,
    )
)
def prepared_recursive(spark: SparkSession, folder: str) -> DataFrame:
    """The recursive groups of the prepared frame."""
    from tidemark.plans.prepare import RECURSIVE, prepare

    columns = ("ema20", "ema50", "ema200", "atr14", "natr14", "rsi14", "macd", "macd_signal", "kc_middle", "kc_upper", "kc_lower")
    return shown(prepare(hourly(spark, folder), RECURSIVE), **{c: c for c in columns})
