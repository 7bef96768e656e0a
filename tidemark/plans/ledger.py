"""Queries over closed trades, candidate signals and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import ledger as G
from tidemark.operators import recursive as K
from tidemark.operators import signals as Z
from tidemark.operators import stats as S
from tidemark.operators import structure as T
from tidemark.operators import zones as Y
from tidemark.plans.aggregates import rounding
from tidemark.plans.market import _pivots, _sql, _swings, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.sql import LINE, r
from tidemark.sources.tables import table

_TRADES = """t AS (SELECT l_orderkey * 10 + l_linenumber AS trade_id, o_custkey AS customer, l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS direction, o_orderpriority AS phase,
  epoch_us(o_orderdate) AS opened_us, epoch_us(l_shipdate) AS closed_us, l_extendedprice / l_quantity AS entry, l_extendedprice / l_quantity * (1 + (l_discount - l_tax)) AS exit,
  l_extendedprice / l_quantity * (1 + CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END * (0.01 + (l_quantity::INTEGER % 5) / 100.0)) AS stop, 100 * l_tax / 10 AS cost_pct
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate),
r AS (SELECT *, gross_pct - cost_pct AS net_pct, CASE WHEN stop_pct >= 0.05 THEN (gross_pct - cost_pct) / stop_pct END AS r FROM (
  SELECT *, 100 * CASE WHEN direction = 'long' THEN 1 ELSE -1 END * (exit / entry - 1) AS gross_pct, 100 * abs(stop / entry - 1) AS stop_pct FROM t))"""


def _trades(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return G.with_r(G.trades_from_orders(orders, table(spark, folder, "lineitem")))


@query(f"WITH {_TRADES} SELECT trade_id, symbol, direction, {r('gross_pct', 5)} AS gross_pct, {r('stop_pct', 5)} AS stop_pct, {r('r', 5)} AS r FROM r")
def trade_r_frame(spark: SparkSession, folder: str) -> DataFrame:
    return _trades(spark, folder).select("trade_id", "symbol", "direction", *[rounded(c, 5).alias(c) for c in ("gross_pct", "stop_pct", "r")])


_COHORT = f"""SELECT symbol, direction, count(*) AS n, count_if(net_pct > 0.15)::BIGINT AS wins, count_if(abs(net_pct) > 0.15)::BIGINT AS decided, {r('avg(r)')} AS mean_r, {r('sum(r)', 3)} AS sum_r,
{r('sum(CASE WHEN r > 0 THEN r END) / -sum(CASE WHEN r < 0 THEN r END)')} AS profit_factor"""


@query(
    f"""WITH {_TRADES}, c AS ({_COHORT} FROM r GROUP BY 1, 2)
SELECT *, {r('wins::DOUBLE / decided')} AS win_rate, {r('(wins::DOUBLE / decided + 1.96 * 1.96 / (2 * decided)) / (1 + 1.96 * 1.96 / decided) - 1.96 * sqrt((wins::DOUBLE / decided) * (1 - wins::DOUBLE / decided) / decided + 1.96 * 1.96 / (4.0 * decided * decided)) / (1 + 1.96 * 1.96 / decided)')} AS lo,
{r('(wins::DOUBLE / decided + 1.96 * 1.96 / (2 * decided)) / (1 + 1.96 * 1.96 / decided) + 1.96 * sqrt((wins::DOUBLE / decided) * (1 - wins::DOUBLE / decided) / decided + 1.96 * 1.96 / (4.0 * decided * decided)) / (1 + 1.96 * 1.96 / decided)')} AS hi FROM c"""
)
def wilson_by_group(spark: SparkSession, folder: str) -> DataFrame:
    out = G.cohorts(_trades(spark, folder), "symbol", "direction")
    return rounding(out.withColumn("sum_r", F.round("sum_r", 3)))


@query(f"WITH {_TRADES} SELECT CASE WHEN stop_pct < 1.5 THEN 0 WHEN stop_pct < 2.5 THEN 1 WHEN stop_pct < 3.5 THEN 2 WHEN stop_pct < 4.5 THEN 3 ELSE 4 END AS band, count(*) AS n, {r('avg(r)')} AS mean_r, {r('quantile_cont(r, 0.5)')} AS median_r FROM r WHERE r IS NOT NULL GROUP BY 1")
def stop_band_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(G.stop_bands(_trades(spark, folder)))


@query(f"WITH {_TRADES}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r DESC, trade_id) AS n FROM r WHERE r > 0) SELECT symbol, {r('sum(CASE WHEN n <= 10 THEN r END)', 4)} AS top, {r('sum(r)', 3)} AS all_gains, {r('sum(CASE WHEN n <= 10 THEN r END) / sum(r)')} AS share FROM w GROUP BY symbol")
def concentration_topk(spark: SparkSession, folder: str) -> DataFrame:
    out = G.concentration(_trades(spark, folder), 10)
    return out.select("symbol", rounded("top", 4).alias("top"), rounded("all_gains", 3).alias("all_gains"), rounded("share").alias("share"))


@query(f"WITH {_TRADES}, q AS (SELECT phase, quantile_cont(net_pct, 0.1) AS lo, quantile_cont(net_pct, 0.9) AS hi FROM r GROUP BY phase) SELECT phase, {r('avg(net_pct)')} AS trimmed, count(*) AS n FROM r JOIN q USING (phase) WHERE net_pct BETWEEN lo - 1e-9 AND hi + 1e-9 GROUP BY phase")
def trimmed_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(G.trimmed_mean(_trades(spark, folder), "phase", "net_pct", slack=1e-9))


@query(
    f"""WITH {_TRADES} SELECT coalesce(CASE WHEN entry <= 0 THEN 'no_entry' WHEN exit <= 0 THEN 'no_exit' WHEN direction = 'long' AND stop >= entry THEN 'stop_side' WHEN direction = 'short' AND stop <= entry THEN 'stop_side' END, 'genuine') AS reason, count(*) AS n FROM t GROUP BY 1"""
)
def pollution_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _trades(spark, folder).groupBy(F.coalesce(G.pollution(), F.lit("genuine")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TRADES} SELECT phase, direction, count_if(o = 'win')::BIGINT AS win, count_if(o = 'loss')::BIGINT AS loss, count_if(o = 'flat')::BIGINT AS flat FROM (
  SELECT *, CASE WHEN net_pct > 0.15 THEN 'win' WHEN net_pct < -0.15 THEN 'loss' ELSE 'flat' END AS o FROM r) GROUP BY 1, 2"""
)
def phase_matrix(spark: SparkSession, folder: str) -> DataFrame:
    t = _trades(spark, folder).withColumn("o", G.outcome(F.col("net_pct")))
    return t.groupBy("phase", "direction").agg(*[F.count_if(F.col("o") == o).alias(o) for o in ("win", "loss", "flat")])


@query(
    f"""WITH {_TRADES} SELECT trade_id, losses FROM (SELECT trade_id, sum((net_pct < 0)::INTEGER) OVER (PARTITION BY symbol ORDER BY closed_us // 1000000 RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)::BIGINT AS losses FROM r) WHERE losses >= 8"""
)
def loss_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return G.loss_streak(_trades(spark, folder), 24, 8).select("trade_id", "losses")


@query(
    f"""WITH {_TRADES} SELECT trade_id, before::DOUBLE / 1000000 AS before FROM (SELECT trade_id, sum(round(r * 1000000)::BIGINT) OVER w AS before, count(r) OVER w AS seen FROM r WINDOW w AS (PARTITION BY symbol, direction ORDER BY closed_us, trade_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE seen = 10 AND before < -9000000"""
)
def repeat_losers(spark: SparkSession, folder: str) -> DataFrame:
    return G.repeat_losers(_trades(spark, folder), 10, -9.0).select("trade_id", "before")


@query()
def equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    t = _trades(spark, folder).where("r IS NOT NULL")
    sized = t.select(F.col("customer").cast("string").alias("account"), "trade_id", F.unix_micros("opened_at").alias("opened"), F.unix_micros("closed_at").alias("closed"), "r")
    return K.equity_curve(sized).select("account", "trade_id", "taken", rounded("equity", 4).alias("equity"), rounded("drawdown").alias("drawdown"))


def _setups(spark: SparkSession, folder: str) -> DataFrame:
    """Every pivot low as a long setup at its close."""
    return _swings(spark, folder, 3, 1).where("pl").select(
        "symbol", "ts", F.unix_seconds("ts").alias("trade_id"), F.lit("long").alias("direction"), F.col("close").alias("entry"), (F.col("close") * 0.9).alias("stop"), (F.col("close") * 1.2).alias("target")
    )


_AHEAD = "OVER (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)"


@query(_sql(f"SELECT symbol, ts_s AS trade_id, {r('100 * (top / close - 1)')} AS mfe_pct, {r('100 * (bottom / close - 1)')} AS mae_pct FROM (SELECT *, max(high) {_AHEAD} AS top, min(low) {_AHEAD} AS bottom FROM piv) WHERE pl", more=_pivots(3, 1)))
def path_mfe_mae(spark: SparkSession, folder: str) -> DataFrame:
    setups = _setups(spark, folder).withColumn("trade_id", F.struct("symbol", "trade_id"))
    out = G.path_extremes(setups, hourly(spark, folder), 12)
    return rounding(out.select("trade_id.symbol", "trade_id.trade_id", "mfe_pct", "mae_pct"))


@query(
    _sql(
        f"""SELECT symbol, ts_s AS trade_id, target, nullif(coalesce(list_position(list_transform(hs, lambda x: x >= close * (1 + target / 100)), true), 0), 0)::BIGINT AS bars
FROM (SELECT *, list(high) {_AHEAD} AS hs FROM piv) CROSS JOIN (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (20.0::DOUBLE)) g(target) WHERE pl""",
        more=_pivots(3, 1),
    )
)
def first_passage_grid(spark: SparkSession, folder: str) -> DataFrame:
    setups = _setups(spark, folder).withColumn("trade_id", F.struct("symbol", "trade_id"))
    return G.first_passage(setups, hourly(spark, folder), 12, [1.0, 5.0, 20.0]).select("trade_id.symbol", "trade_id.trade_id", "target", "bars")


@query(
    _sql(
        """SELECT symbol, ts_s AS setup_s, CASE WHEN s IS NOT NULL AND (g IS NULL OR s <= g) THEN 'stop' WHEN g IS NOT NULL THEN 'tp' ELSE 'open' END AS result, least(s, g)::BIGINT AS bars FROM (
  SELECT symbol, ts_s, nullif(coalesce(list_position(list_transform(ls, lambda x: x <= close * 0.9), true), 0), 0) AS s, nullif(coalesce(list_position(list_transform(hs, lambda x: x >= close * 1.2), true), 0), 0) AS g
  FROM (SELECT *, list(high) """
        + _AHEAD
        + " AS hs, list(low) "
        + _AHEAD
        + " AS ls FROM piv) WHERE pl)",
        more=_pivots(3, 1),
    )
)
def level_backtest(spark: SparkSession, folder: str) -> DataFrame:
    setups = _setups(spark, folder).withColumn("setup_id", F.struct("symbol", "trade_id"))
    return G.level_backtest(setups, hourly(spark, folder), 12).select("setup_id.symbol", F.col("setup_id.trade_id").alias("setup_s"), "result", "bars")


@query(
    _sql(f"""SELECT symbol, ts_s, state AS bos FROM (SELECT *, lag(state) {LINE} AS before FROM (
  SELECT *, CASE WHEN n = 20 AND close > hh * 1.003 THEN 1 WHEN n = 20 AND close < ll * 0.997 THEN -1 ELSE 0 END AS state FROM (
    SELECT *, count(*) OVER w AS n, max(high) OVER w AS hh, min(low) OVER w AS ll FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))) WHERE state <> 0 AND state <> coalesce(before, 0)""")
)
def structure_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return shown(T.breaks(hourly(spark, folder)).where("bos <> 0"), bos="bos")


@query(
    _sql("""SELECT symbol, min(ts_s) AS first_s, max(ts_s) AS last_s, count(*) AS n FROM (SELECT *, sum(far) OVER (PARTITION BY symbol ORDER BY ts_s) AS run FROM (
  SELECT *, coalesce(rn - lag(rn) OVER (PARTITION BY symbol ORDER BY ts_s) > 3, false)::INTEGER AS far FROM b WHERE low <= 50 AND high >= 30)) GROUP BY symbol, run""")
)
def band_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = T.runs(hourly(spark, folder), (F.col("low") <= 50) & (F.col("high") >= 30), 2)
    return out.select("symbol", F.unix_seconds("first").alias("first_s"), F.unix_seconds("last").alias("last_s"), "n")


@query(
    _sql(f"""SELECT symbol, ts_s, rn - coalesce(max(CASE WHEN NOT least(open, close) > 20 THEN rn END) OVER (PARTITION BY symbol ORDER BY ts_s ROWS UNBOUNDED PRECEDING), 0) AS bodies FROM b""")
)
def confirmation_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return shown(hourly(spark, folder), bodies=T.confirmation_bodies(F.lit(20.0)).cast("long"))


@query(
    _sql(f"""SELECT symbol, ts_s, {r('lo')} AS lo, {r('hi')} AS hi, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, ts_s DESC) AS k FROM (
  SELECT *, (vm / mean) / greatest((hi - lo) / cm, 0.01) AS score FROM (
    SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi, avg(volume) OVER w AS vm, avg(close) OVER w AS cm, count(*) OVER w AS n, avg(volume) OVER (PARTITION BY symbol) AS mean FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE n = 6)) WHERE k = 1""")
)
def stop_volume(spark: SparkSession, folder: str) -> DataFrame:
    return shown(T.stop_volume(hourly(spark, folder), 6), lo="lo", hi="hi", score="score")


@query(
    _sql("""SELECT symbol, sum((abs(low / 20 - 1) <= 0.05 AND ahead >= 20 * 1.025 AND back > 3)::INTEGER)::BIGINT AS worked FROM (
  SELECT *, coalesce(max(high) OVER (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS ahead, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) AS back FROM b) GROUP BY symbol""")
)
def level_worked(spark: SparkSession, folder: str) -> DataFrame:
    return T.level_worked(hourly(spark, folder), F.lit(20.0), 0.05)


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    t = _trades(spark, folder).where("r IS NOT NULL").select("phase", "trade_id", "r")
    return rounding(S.bootstrap_interval(t, "phase", "r"))


# Clusters by recursion along sorted prices; boxes in order of volume; a box is taken if it overlaps none taken before.
_ZONES = """pts AS (SELECT symbol, side, price, sum(volume) AS w, count(*) AS c, row_number() OVER (PARTITION BY symbol, side ORDER BY price) AS k FROM (SELECT symbol, 'hi' AS side, high AS price, volume FROM piv WHERE ph UNION ALL SELECT symbol, 'lo', low, volume FROM piv WHERE pl) GROUP BY symbol, side, price),
cl AS (SELECT symbol, side, k, price, w, c, price * c AS total, c AS n, 1 AS cluster FROM pts WHERE k = 1 UNION ALL
  SELECT p.symbol, p.side, p.k, p.price, p.w, p.c, CASE WHEN p.price <= cl.total / cl.n * 1.02 THEN cl.total ELSE 0 END + p.price * p.c, CASE WHEN p.price <= cl.total / cl.n * 1.02 THEN cl.n ELSE 0 END + p.c, CASE WHEN p.price <= cl.total / cl.n * 1.02 THEN cl.cluster ELSE cl.cluster + 1 END
  FROM cl JOIN pts p ON p.symbol = cl.symbol AND p.side = cl.side AND p.k = cl.k + 1),
cs AS (SELECT symbol, side, min(price) AS lo, max(price) AS hi, sum(c) AS n, sum(w) AS w FROM cl GROUP BY symbol, side, cluster),
bx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, hi - lo, lo, hi) AS k FROM (SELECT a.symbol, a.lo, z.hi, (a.n + z.n)::BIGINT AS touches, a.w + z.w AS volume FROM cs a JOIN cs z ON z.symbol = a.symbol AND a.side = 'lo' AND z.side = 'hi' WHERE a.lo > 0 AND z.hi > a.lo AND z.hi / a.lo - 1 <= 9.0 AND a.n + z.n >= 4)),
tk AS (SELECT symbol, 0::BIGINT AS k, []::STRUCT(lo DOUBLE, hi DOUBLE)[] AS taken, false AS fits FROM (SELECT DISTINCT symbol FROM bx) UNION ALL
  SELECT symbol, k, CASE WHEN fits THEN list_append(taken, {'lo': lo, 'hi': hi}) ELSE taken END, fits FROM (
    SELECT bx.symbol, bx.k, bx.lo, bx.hi, tk.taken, len(tk.taken) < 5 AND len(list_filter(tk.taken, lambda t: t.lo <= bx.hi AND t.hi >= bx.lo)) = 0 AS fits FROM tk JOIN bx ON bx.symbol = tk.symbol AND bx.k = tk.k + 1)),
zones AS (SELECT bx.symbol, lo, hi, touches, volume FROM bx JOIN tk ON tk.symbol = bx.symbol AND tk.k = bx.k WHERE fits)"""


@query(_sql(f"SELECT symbol, {r('lo')} AS lo, {r('hi')} AS hi, touches, {r('volume')} AS volume FROM zones", more=_pivots(3, 1) + ", " + _ZONES, recursive=True))
def accumulation_zones(spark: SparkSession, folder: str) -> DataFrame:
    return rounding(Y.accumulation_zones(_swings(spark, folder, 3, 1), 0.02, 9.0))


@query(
    _sql(
        f"""SELECT symbol, {r('lo')} AS lo, {r('hi')} AS hi, touches, {r('volume')} AS volume, {r('price')} AS price, direction, {r('entry')} AS entry, {r('stop')} AS stop, {r('target')} AS target, {r('rr')} AS rr, {r('strength')} AS strength,
  CASE WHEN target IS NULL THEN 'no_target' WHEN rr < 2 THEN 'low_rr' END AS abstain, CASE WHEN strength >= 0.55 THEN 'A' WHEN strength >= 0.4 THEN 'B' ELSE 'C' END AS grade FROM (
  SELECT *, CASE direction WHEN 'long' THEN (target - entry) / nullif(entry - stop, 0) ELSE (entry - target) / nullif(stop - entry, 0) END AS rr,
    greatest(0, least(1, 0.5 * greatest(0.8, least(1.2, 1 + greatest(-0.15, least(0.15, 0.03 * (touches - 4))) + greatest(-0.1, least(0.15, 0.1 * (volume / avg(volume) OVER (PARTITION BY symbol) - 1))))))) AS strength FROM (
    SELECT c.*, (SELECT CASE c.direction WHEN 'long' THEN min(CASE WHEN z.lo > c.entry * 1.003 THEN z.lo END) ELSE max(CASE WHEN z.hi < c.entry * 0.997 THEN z.hi END) END FROM zones z WHERE z.symbol = c.symbol) AS target FROM (
      SELECT *, CASE direction WHEN 'long' THEN greatest(lo * 0.98, entry * 0.94) ELSE least(hi * 1.02, entry * 1.06) END AS stop FROM (
        SELECT zones.*, price, CASE WHEN price > hi THEN 'long' ELSE 'short' END AS direction, CASE WHEN price > hi THEN hi ELSE lo END AS entry FROM zones JOIN (SELECT symbol, arg_max(close, ts_s) AS price FROM b GROUP BY symbol) USING (symbol) WHERE price > hi OR price < lo)) c))""",
        more=_pivots(3, 1) + ", " + _ZONES,
        recursive=True,
    )
)
def zone_signals(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    return rounding(Z.signals(bars, Y.accumulation_zones(_swings(spark, folder, 3, 1), 0.02, 9.0)))


@query()
def prepared_frame(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.plans.prepare import prepare

    return rounding(prepare(hourly(spark, folder)).withColumn("ts", F.unix_seconds("ts")))
