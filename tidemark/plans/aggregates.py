"""Queries of profiles, order flow, book depth and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import flow as L
from tidemark.operators import profile as P
from tidemark.operators import stats as S
from tidemark.operators import windows as R
from tidemark.plans.market import _RET, _sql, hourly
from tidemark.plans.registry import query
from tidemark.plans.relations import _trades
from tidemark.plans.sql import LINE, TRADES, r
from tidemark.sources.tables import table


def rounding(df: DataFrame) -> DataFrame:
    return df.select([rounded(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


_HIST = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS n FROM b) WHERE n <= 48),
rng AS (SELECT symbol, min(low) AS p_min, (max(high) - min(low)) / 60 AS size FROM near GROUP BY symbol),
sp AS (SELECT near.symbol, p_min, size, volume, least(greatest(floor((low - p_min) / size), 0), 59)::INTEGER AS b0, least(greatest(floor((high - p_min) / size), 0), 59)::INTEGER AS b1 FROM near JOIN rng USING (symbol) WHERE size > 0),
hist AS (SELECT symbol, bucket, round(sum(v), 9) AS volume, any_value(p_min) AS p_min, any_value(size) AS size FROM (SELECT symbol, p_min, size, volume / (b1 - b0 + 1) AS v, unnest(generate_series(b0, b1)) AS bucket FROM sp) GROUP BY 1, 2)"""


@query(_sql(f"SELECT symbol, bucket::INTEGER AS bucket, {r('volume')} AS volume FROM hist", more=_HIST))
def volume_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(P.histogram(P.newest(hourly(spark, folder), 48), 60).select("symbol", "bucket", "volume"))


@query(
    _sql(
        f"SELECT symbol, {r('p_min + (b + 0.5) * size')} AS poc, {r('p_min + (hi + 1) * size')} AS vah, {r('p_min + lo * size')} AS val FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY step DESC) AS k FROM va) WHERE k = 1",
        more=_HIST
        + """, dense AS (SELECT r.symbol, r.p_min, r.size, g.i AS bucket, coalesce(h.volume, 0) AS v FROM rng r CROSS JOIN (SELECT unnest(range(60)) AS i) g LEFT JOIN hist h ON h.symbol = r.symbol AND h.bucket = g.i),
poc AS (SELECT symbol, any_value(p_min) AS p_min, any_value(size) AS size, arg_min(bucket, struct_pack(a := -v, d := abs(bucket - 29.5), i := bucket)) AS b, sum(v) AS total FROM dense GROUP BY symbol),
va AS (
  SELECT p.symbol, p.p_min, p.size, p.b, p.total, p.b AS lo, p.b AS hi, d.v AS acc, 0 AS step FROM poc p JOIN dense d ON d.symbol = p.symbol AND d.bucket = p.b
  UNION ALL
  SELECT symbol, p_min, size, b, total, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, acc + CASE WHEN up THEN rv ELSE lv END, step + 1 FROM (
    SELECT va.*, coalesce(l.v, -1) AS lv, coalesce(h.v, -1) AS rv, coalesce(h.v, -1) >= coalesce(l.v, -1) AND h.v IS NOT NULL AS up
    FROM va LEFT JOIN dense l ON l.symbol = va.symbol AND l.bucket = va.lo - 1 LEFT JOIN dense h ON h.symbol = va.symbol AND h.bucket = va.hi + 1
    WHERE va.acc < 0.7 * va.total AND (l.v IS NOT NULL OR h.v IS NOT NULL))
)""",
        recursive=True,
    )
)
def poc_vah_val(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(P.levels(P.newest(hourly(spark, folder), 48), 60))


@query(
    _sql(
        f"""SELECT symbol, kind, rank, bucket::INTEGER AS bucket, {r('volume')} AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY CASE WHEN kind = 'hvn' THEN -volume ELSE volume END, bucket)::INTEGER AS rank FROM (
    SELECT *, CASE WHEN volume > 1.3 * m THEN 'hvn' WHEN volume < 0.5 * m THEN 'lvn' END AS kind FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS m FROM hist)) WHERE kind IS NOT NULL) WHERE rank <= 3""",
        more=_HIST,
    )
)
def hvn_lvn(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(P.nodes(P.histogram(P.newest(hourly(spark, folder), 48), 60)))


@query(
    f"""WITH {TRADES}, f AS (SELECT symbol, sum(CASE WHEN is_buy THEN price * qty ELSE 0 END) AS buy, sum(CASE WHEN NOT is_buy THEN price * qty ELSE 0 END) AS sell, count(*) AS n FROM trades GROUP BY symbol)
SELECT symbol, {r('buy')} AS buy, {r('sell')} AS sell, n, {r('buy - sell')} AS delta, {r('(buy - sell) / nullif(buy + sell, 0)')} AS delta_ratio FROM f"""
)
def taker_flow(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(L.taker_flow(_trades(spark, folder)))


@query(
    f"""WITH {TRADES}, w AS (SELECT * FROM trades WHERE us > 1705276800000000 - 172800000000 AND us <= 1705276800000000), f AS (SELECT symbol, arg_min(price, struct_pack(a := us, b := trade_id)) AS p0, arg_max(price, struct_pack(a := us, b := trade_id)) AS p1, count(*) AS n FROM w GROUP BY symbol)
SELECT symbol, {r('100 * (p1 / nullif(p0, 0) - 1)')} AS change_pct, n FROM f WHERE n >= 2"""
)
def window_price_change(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(L.window_change(L.trailing(_trades(spark, folder), F.timestamp_seconds(F.lit(1705276800)), 172_800)))


@query(
    f"""WITH {TRADES}, ref AS (SELECT symbol, arg_max(price, struct_pack(a := us, b := trade_id)) AS ref FROM trades GROUP BY symbol)
SELECT symbol, least(floor((price - ref * 0.95) / (ref * 0.1 / 20)), 19)::INTEGER AS bucket, {r('sum(CASE WHEN is_buy THEN price * qty ELSE 0 END)')} AS buy, {r('sum(CASE WHEN NOT is_buy THEN price * qty ELSE 0 END)')} AS sell
FROM trades JOIN ref USING (symbol) WHERE abs(price / ref - 1) <= 0.05 GROUP BY 1, 2"""
)
def footprint_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(L.footprint(_trades(spark, folder)))


@query(
    f"SELECT l_returnflag AS symbol, {r("sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END)", 2)} AS longs, {r("sum(CASE WHEN l_linestatus <> 'O' THEN l_extendedprice ELSE 0 END)", 2)} AS shorts FROM lineitem GROUP BY 1"
)
def liq_notional(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "SELL").otherwise("BUY")
    events = lines.select(F.col("l_returnflag").alias("symbol"), side.alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounding(L.liquidation_notional(events).withColumns({"longs": F.round("longs", 2), "shorts": F.round("shorts", 2)}))


_TIERS = {5: 2.0, 10: 3.0, 25: 1.0}
_PLAN = ", ".join(f"({1 / t!r}::DOUBLE, {x / 6.0 / 2!r}::DOUBLE, {s})" for t, x in _TIERS.items() for s in (1, -1))


@query(
    _sql(f"""SELECT symbol, floor((price - ref * 0.88) / (ref * 0.24 / 48))::INTEGER AS bucket, {r('sum(CASE WHEN sgn = 1 THEN money ELSE 0 END)')} AS longs, {r('sum(CASE WHEN sgn = -1 THEN money ELSE 0 END)')} AS shorts FROM (
  SELECT q.symbol, ref, close * (1 - sgn * (margin - 0.005)) AS price, rise * weight * close AS money, sgn FROM (SELECT *, volume - lag(volume) {LINE} AS rise FROM b) q
  JOIN (SELECT symbol, arg_max(close, ts_s) AS ref FROM b GROUP BY symbol) USING (symbol) CROSS JOIN (VALUES {_PLAN}) t(margin, weight, sgn) WHERE rise > 0)
WHERE floor((price - ref * 0.88) / (ref * 0.24 / 48)) BETWEEN 0 AND 47 GROUP BY 1, 2""")
)
def forward_liquidations(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(L.forward_liquidations(hourly(spark, folder).select("symbol", "ts", "close", F.col("volume").alias("oi")), _TIERS))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as book levels: one book per return flag."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").cast("double").alias("qty"), F.col("l_suppkey").alias("venue"), F.col("l_linenumber").alias("sample"),
    )


_LEVELS = "lv AS (SELECT l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side, floor(l_extendedprice / l_quantity)::DOUBLE AS price, l_quantity::DOUBLE AS qty, l_linenumber AS sample, l_suppkey AS venue FROM lineitem)"


@query(f"WITH {_LEVELS}, m AS (SELECT symbol, side, floor(price / 50)::BIGINT AS bin, sum(price * qty) AS notional FROM lv GROUP BY 1, 2, 3) SELECT symbol, side, bin, {r('notional', 2)} AS notional, {r('notional / max(notional) OVER (PARTITION BY symbol)')} AS intensity FROM m")
def depth_bins(spark: SparkSession, folder: str) -> DataFrame:
    return L.depth_bins(_levels(spark, folder), "symbol", 50.0).select("symbol", "side", "bin", rounded("notional", 2).alias("notional"), rounded("intensity").alias("intensity"))


@query(f"WITH {_LEVELS} SELECT symbol, side, rank, {r('price')} AS price, {r('price * qty')} AS notional FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY price * qty DESC, price)::INTEGER AS rank FROM lv) WHERE rank <= 5")
def top_walls(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(L.top_walls(_levels(spark, folder), "symbol", 5))


@query(
    f"""WITH {_LEVELS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, qty) AS n FROM lv) WHERE n <= 20),
s AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN price * qty END) AS b, sum(CASE WHEN side = 'ask' THEN price * qty END) AS a FROM best GROUP BY symbol)
SELECT symbol, {r('(coalesce(b, 0) - coalesce(a, 0)) / nullif(coalesce(b, 0) + coalesce(a, 0), 0)')} AS imbalance FROM s"""
)
def depth_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    books = L.book_from_levels(_levels(spark, folder), "symbol", 20)
    return rounding(books.select("symbol", L.depth_imbalance(F.col("bids"), F.col("asks"), 20).alias("imbalance")))


@query(f"WITH {_LEVELS} SELECT symbol, side, {r('round(price, 0)')} AS price, count(DISTINCT sample) AS samples, {r('avg(price * qty)', 4)} AS notional FROM lv GROUP BY symbol, side, round(price, 0) HAVING count(DISTINCT sample) >= 4")
def sticky_walls(spark: SparkSession, folder: str) -> DataFrame:
    return L.sticky_walls(_levels(spark, folder), 4, 0).select("symbol", "side", rounded("price").alias("price"), "samples", rounded("notional", 4).alias("notional"))


@query(
    f"""WITH {_LEVELS} SELECT symbol, side, {r('round(price, 1)')} AS price, {r('sum(price * qty)', 4)} AS notional, count(DISTINCT venue) AS venues FROM lv GROUP BY symbol, side, round(price, 1)"""
)
def venue_walls(spark: SparkSession, folder: str) -> DataFrame:
    return L.venue_walls(_levels(spark, folder), 1).select("symbol", "side", rounded("price").alias("price"), rounded("notional", 4).alias("notional"), F.size("venues").cast("long").alias("venues"))


@query(
    f"""WITH RECURSIVE {_LEVELS}, m AS (SELECT symbol || '-' || venue AS book, side, price, sum(price * qty) AS w, count(*) AS c FROM lv GROUP BY 1, 2, 3),
x AS (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY price) AS k FROM m),
f AS (SELECT book, side, k, price AS anchor, w, c FROM x WHERE k = 1 UNION ALL
  SELECT x.book, x.side, x.k, CASE WHEN x.price <= f.anchor * 1.003 THEN f.anchor ELSE x.price END, x.w, x.c FROM f JOIN x ON x.book = f.book AND x.side = f.side AND x.k = f.k + 1)
SELECT book, side, {r('anchor')} AS anchor, {r('sum(w)', 4)} AS notional, sum(c)::BIGINT AS n FROM f GROUP BY book, side, anchor"""
)
def wall_clusters(spark: SparkSession, folder: str) -> DataFrame:
    books = _levels(spark, folder).withColumn("book", F.concat_ws("-", "symbol", "venue"))
    out = L.wall_clusters(books, "book")
    return out.withColumns({"anchor": rounded("anchor"), "notional": rounded("notional", 4)})


def _half_up(x: str, digits: int) -> str:
    return f"round({x}, {digits})"


@query(
    f"""WITH l AS (SELECT abs(d) AS change, d > 0 AS rose, q AS quote_volume, CASE WHEN lo > 0 AND hi > lo THEN (hi / lo - 1) * 100 END AS range FROM (
  SELECT c_acctbal / 500 - 3 AS d, abs(c_acctbal) * 10000 AS q, 100 + abs(c_acctbal) / 400 AS hi, 100 - (c_custkey % 7) AS lo FROM customer) WHERE q >= 10000000),
a AS (SELECT count(*) AS n, quantile_cont(change, 0.5) AS median, quantile_cont(change, 0.75) AS p75, quantile_cont(change, 0.9) AS p90, quantile_cont(range, 0.5) AS median_range, quantile_cont(range, 0.75) AS p75_range,
  100 * avg((change >= 8)::INTEGER) AS hot, 100 * avg(rose::INTEGER) AS breadth, quantile_cont(quote_volume, 0.4) AS p40_volume FROM l)
SELECT n, {", ".join(f"{r(c)} AS {c}" for c in ("median", "p75", "p90", "median_range", "p75_range", "hot", "breadth", "p40_volume"))},
CASE WHEN median < 2.5 AND hot < 8 THEN 'quiet' WHEN p90 > 15 OR hot > 30 THEN 'extreme' WHEN median > 5 OR hot > 15 THEN 'hot' ELSE 'normal' END AS regime,
{r("least(greatest(" + _half_up("p75 * 0.85", 1) + ", 4), 22)")} AS anomaly_change, {r("least(greatest(" + _half_up("greatest(median_range * 1.6, p75_range * 0.9)", 1) + ", 6), 28)")} AS anomaly_range,
{r("least(greatest(" + _half_up("median * 0.55", 2) + ", 1), 4.5)")} AS ignition, {r("least(greatest(p40_volume, 2500000), 40000000)")} AS ignition_volume FROM a"""
)
def regime_cross_section(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("c_acctbal")
    t = table(spark, folder, "customer").select((balance / 500 - 3).alias("change_pct"), (F.abs(balance) * 10_000).alias("quote_volume"), (100 + F.abs(balance) / 400).alias("high"), (100 - F.col("c_custkey") % 7).cast("double").alias("low"))
    return rounding(S.regime(t))


@query(
    _sql(
        f"""SELECT symbol, {r('CASE WHEN n >= 30 AND scale > 0 THEN greatest(-12, least(12, (last - median) / scale)) END')} AS z, n FROM (
  SELECT *, CASE WHEN mad > 1e-12 THEN mad * 1.4826 * n / (n - 0.8) ELSE sigma END AS scale FROM (
    SELECT a.symbol, any_value(a.median) AS median, any_value(a.last) AS last, any_value(a.n) AS n, any_value(a.sigma) AS sigma, quantile_cont(abs(b.close - a.median), 0.5) AS mad
    FROM b JOIN (SELECT symbol, quantile_cont(close, 0.5) AS median, arg_max(close, ts_s) AS last, count(close) AS n, stddev_pop(close) AS sigma FROM b GROUP BY symbol) a USING (symbol) GROUP BY a.symbol))"""
    )
)
def robust_z_mad(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(S.robust_z(hourly(spark, folder), "symbol", "close", "ts"))


@query(_sql(f"SELECT symbol, count(*) AS n, {r('skewness(log_ret)')} AS skew, {r('kurtosis(log_ret)')} AS kurt FROM ret WHERE log_ret IS NOT NULL GROUP BY symbol", more=_RET))
def return_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(S.moments(R.with_returns(hourly(spark, folder)), "symbol", "log_ret"))


@query(
    _sql(
        f"SELECT symbol, {r('-sum(c / t * ln(c / t))')} AS entropy, count(*) AS bins FROM (SELECT *, sum(c) OVER (PARTITION BY symbol) AS t FROM (SELECT symbol, floor(log_ret / 0.1) AS bin, count(*)::DOUBLE AS c FROM ret WHERE log_ret IS NOT NULL GROUP BY 1, 2)) GROUP BY symbol",
        more=_RET,
    )
)
def return_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(S.entropy(R.with_returns(hourly(spark, folder)), "symbol", "log_ret", 0.1))


@query(
    _sql(f"""SELECT symbol, {r('max(d)')} AS ks, any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2, {r('any_value(sqrt(-ln(0.025) / 2) * sqrt((n1 + n2) / (n1 * n2)))')} AS critical, max(d) > any_value(sqrt(-ln(0.025) / 2) * sqrt((n1 + n2) / (n1 * n2))) AS broken FROM (
  SELECT symbol, abs((sum(late) OVER w)::DOUBLE / n1 - (sum(1 - late) OVER w)::DOUBLE / n2) AS d, n1, n2 FROM (
    SELECT *, (sum(late) OVER (PARTITION BY symbol))::DOUBLE AS n1, (sum(1 - late) OVER (PARTITION BY symbol))::DOUBLE AS n2 FROM (
      SELECT symbol, quote_volume, (n <= 32)::INTEGER AS late FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS n FROM b) WHERE n <= 64))
  WINDOW w AS (PARTITION BY symbol ORDER BY quote_volume RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY symbol""")
)
def ks_volume_break(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    near = hourly(spark, folder).withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))).where("n <= 64").withColumn("late", F.col("n") <= 32)
    return rounding(S.two_sample(near, "symbol", "quote_volume", "late"))


@query(
    f"""WITH l AS (SELECT l_returnflag AS k, l_quantity::DOUBLE AS qty, l_extendedprice AS price, l_discount AS discount FROM lineitem),
q AS (SELECT k, {", ".join(f"rank() OVER (PARTITION BY k ORDER BY {c}) + (count(*) OVER (PARTITION BY k, {c}) - 1) / 2.0 AS {c}" for c in ("qty", "price", "discount"))} FROM l),
c AS (SELECT k, corr(qty, price) AS a, corr(qty, discount) AS b, corr(price, discount) AS c FROM q GROUP BY k)
SELECT k, 'qty' AS a, 'price' AS b, {r('c.a')} AS rho FROM c UNION ALL SELECT k, 'qty', 'discount', {r('c.b')} FROM c UNION ALL SELECT k, 'price', 'discount', {r('c.c')} FROM c"""
)
def spearman_matrix(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("double").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))  # noqa: E741
    return rounding(S.spearman(l, "k", ["qty", "price", "discount"]))


@query(
    f"""WITH l AS (SELECT l_returnflag AS k, l_discount AS score, l_linestatus = 'O' AS pos FROM lineitem), q AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2.0 AS rk FROM l)
SELECT k, {r('(sum(CASE WHEN pos THEN rk END) - count_if(pos) * (count_if(pos) + 1) / 2.0) / nullif(count_if(pos)::DOUBLE * count_if(NOT pos), 0)')} AS auc, count_if(pos)::BIGINT AS n1, count_if(NOT pos)::BIGINT AS n0 FROM q GROUP BY k"""
)
def rank_auc(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("score"), (F.col("l_linestatus") == "O").alias("pos"))  # noqa: E741
    return rounding(S.auc(l, "k", "score", "pos"))


@query(
    f"""WITH
f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label)
SELECT a.label AS a, b.label AS b, {r('list_cosine_similarity(a.e, b.e)')} AS cosine FROM f a JOIN f b ON a.label < b.label"""
)
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    # One vector per label: labels are a small closed set.
    a, b = first.select(F.col("label").alias("a"), F.col("e").alias("x")), first.select(F.col("label").alias("b"), F.col("e").alias("y"))
    return rounding(a.join(b, F.col("a") < F.col("b")).select("a", "b", S.cosine("x", "y").alias("cosine")))


@query("SELECT event_type AS event, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def funnel_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("event")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    """SELECT code, n FROM (SELECT code, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS code FROM orders) GROUP BY code) ORDER BY n DESC, code LIMIT 20"""
)
def blocker_topk(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "orders").select(F.explode(F.split("o_orderpriority", "-")).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(20)


@query("SELECT o_orderstatus AS action, o_orderpriority AS gate, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets_actions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    counted = orders.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id("o_orderstatus", "o_orderpriority").alias("level"))
    return counted.select(F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("gate"), "n", "level")


@query(
    f"""WITH {TRADES}, d AS (SELECT symbol, us // 86400000000 AS day, count(*)::DOUBLE AS c FROM trades GROUP BY 1, 2)
SELECT symbol, count(*) AS days, {r('avg(c)')} AS mean, {r('stddev_samp(c) / avg(c)')} AS cv FROM d GROUP BY symbol"""
)
def signal_daily_cv(spark: SparkSession, folder: str) -> DataFrame:
    daily = _trades(spark, folder).groupBy("symbol", F.floor(F.unix_seconds("ts") / 86_400).alias("day")).agg(F.count("*").alias("c"))
    return rounding(daily.groupBy("symbol").agg(F.count("*").alias("days"), F.avg("c").alias("mean"), F.try_divide(F.stddev_samp("c"), F.avg("c")).alias("cv")))


@query(f"SELECT event_type AS symbol, count(*) AS n, count(value) AS have, {r('count(value)::DOUBLE / count(*)')} AS completeness, {r('min(value)')} AS low, {r('max(value)')} AS high, count_if(value <= 0)::BIGINT AS not_positive FROM events GROUP BY 1")
def column_audit(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return rounding(
        e.groupBy(F.col("event_type").alias("symbol")).agg(
            F.count("*").alias("n"), F.count("value").alias("have"), (F.count("value") / F.count("*")).alias("completeness"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") <= 0).alias("not_positive")
        )
    )


@query("SELECT event_type AS symbol, json_extract_string(props, '$.page') AS page, count(*) AS n FROM events GROUP BY 1, 2")
def props_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("symbol"), F.get_json_object("props", "$.page").alias("page")).agg(F.count("*").alias("n"))
