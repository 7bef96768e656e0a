"""Queries across timeframes. The tables hold a month, so the seniors are of two, four and six hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import multiframe as M
from tidemark.operators import windows as R
from tidemark.plans.market import _sql, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.sql import over, r, recursion
from tidemark.sources.tables import table

WIDTHS = {"quick": 900, "h2": 7200, "h4": 14400, "h6": 21600}
WEIGHTS = {"h6": 0.45, "h4": 0.35, "h2": 0.20}


def _frame_sql(f: str, seconds: int) -> str:
    """CTE f: what is known of each bar of a frame from at_s on."""
    line = "OVER (PARTITION BY symbol ORDER BY ts_s)"
    return f"""{f}_b AS (SELECT *, row_number() {line} AS rn, coalesce(greatest(high - low, abs(high - lag(close) {line}), abs(low - lag(close) {line})), high - low) AS tr, greatest(close - lag(close) {line}, 0) AS up, greatest(lag(close) {line} - close, 0) AS dn FROM (
  SELECT symbol, (us // {seconds}000000) * {seconds} AS ts_s, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(a := us, b := trade_id)) AS close FROM trades GROUP BY 1, 2)),
{recursion(f'{f}_20', f'{f}_b', 'close', 2 / 21, 20)}, {recursion(f'{f}_50', f'{f}_b', 'close', 2 / 51, 50)}, {recursion(f'{f}_a', f'{f}_b', 'tr', 1 / 14, 14)}, {recursion(f'{f}_u', f'{f}_b', 'up', 1 / 14, 14, 1)}, {recursion(f'{f}_d', f'{f}_b', 'dn', 1 / 14, 14, 1)},
{f} AS (SELECT b.symbol, b.ts_s + {seconds} AS at_s, p.y IS NOT NULL AND q.y IS NOT NULL AS warm, CASE WHEN b.close > p.y AND p.y > q.y THEN 'bull' WHEN b.close < p.y AND p.y < q.y THEN 'bear' ELSE 'neutral' END AS trend, 100 * u.y / nullif(u.y + d.y, 0) AS rsi, a.y AS atr
  FROM {f}_b b LEFT JOIN {f}_20 p USING (symbol, rn) LEFT JOIN {f}_50 q USING (symbol, rn) LEFT JOIN {f}_a a USING (symbol, rn) LEFT JOIN {f}_u u USING (symbol, rn) LEFT JOIN {f}_d d USING (symbol, rn))"""


_SEEN = ", ".join([_frame_sql(f, s) for f, s in WIDTHS.items()]) + f""",
fine AS (SELECT symbol, ts_s, close, min(low) {over(20)} AS support, max(high) {over(20)} AS resistance FROM b),
seen AS (SELECT fine.*, {', '.join(f'{f}.warm AS {f}_warm, {f}.trend AS {f}_trend, {f}.rsi AS {f}_rsi, {f}.atr AS {f}_atr' for f in WIDTHS)}
  FROM fine {' '.join(f'ASOF LEFT JOIN {f} ON fine.symbol = {f}.symbol AND fine.ts_s + 3600 >= {f}.at_s' for f in WIDTHS)})"""


def _sum(term: str) -> str:
    return " + ".join(term.format(f=f, w=w) for f, w in WEIGHTS.items())


_VOTES = f"""vt AS (SELECT *, {_sum("CASE WHEN {f}_warm THEN {w} * CASE {f}_trend WHEN 'bull' THEN 1 WHEN 'bear' THEN -1 ELSE 0 END ELSE 0 END")} AS net, {_sum("CASE WHEN {f}_warm THEN {w} ELSE 0 END")} AS weight FROM seen)"""
_CONFLUENCE = f"""sc AS (SELECT *, {_sum("coalesce({f}_trend <> 'neutral', false)::INTEGER")} AS htf_total, {_sum("coalesce({f}_trend = 'bull', false)::INTEGER")} AS long_count, {_sum("coalesce({f}_trend = 'bear', false)::INTEGER")} AS short_count,
  coalesce(h4_atr, h2_atr, quick_atr, close * 0.01) AS atr, coalesce(h4_atr, h2_atr, quick_atr) IS NULL AS atr_assumed, coalesce(quick_rsi, 50) AS quick FROM seen),
sd AS (SELECT *, round(1000 * (coalesce(long_count / nullif(htf_total, 0), 0) * 0.6 + greatest(0, least(1, (quick - 40) / 30)) * 0.4))::INTEGER AS long_score, round(1000 * (coalesce(short_count / nullif(htf_total, 0), 0) * 0.6 + greatest(0, least(1, (60 - quick) / 30)) * 0.4))::INTEGER AS short_score FROM sc)"""


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    trades = B.trades_from_events(table(spark, folder, "events").select("event_type", "event_id", "ts", "value"))
    frames = {f: (M.snapshots(B.bars(trades, f"{s} seconds")), s) for f, s in WIDTHS.items()}
    fine = hourly(spark, folder).select("symbol", "ts", "close", R.rolling(F.min, "low", 20, 1).alias("support"), R.rolling(F.max, "high", 20, 1).alias("resistance"))
    return M.seen_closed(fine, 3600, frames)


@query(_sql("SELECT symbol, ts_s, h6_trend AS h6, h4_trend AS h4, h2_trend AS h2, " + r("net / nullif(weight, 0)") + " AS htf_net, " + r("weight") + " AS htf_weight, CASE WHEN weight = 0 THEN 'unknown' WHEN round(net / weight, 9) >= 0.3 THEN 'long' WHEN round(net / weight, 9) <= -0.3 THEN 'short' ELSE 'neutral' END AS htf_bias FROM vt", more=f"{_SEEN}, {_VOTES}", recursive=True))
def senior_bias(spark: SparkSession, folder: str) -> DataFrame:
    out = M.senior_bias(_seen(spark, folder), WEIGHTS)
    return shown(out, **{f: F.col(f"{f}.trend") for f in WEIGHTS}, htf_net="htf_net", htf_weight=F.coalesce("htf_weight", F.lit(0.0)), htf_bias="htf_bias")


_STOPS = {"entry_lo": "close - 0.3 * atr", "entry_hi": "close + 0.3 * atr", "long_stop": "least(CASE WHEN support > 0 AND support < close THEN support ELSE close - 2 * atr END, close - greatest(atr, close * 0.5 / 100))", "short_stop": "greatest(CASE WHEN resistance > close THEN resistance ELSE close + 2 * atr END, close + greatest(atr, close * 0.5 / 100))"}


@query(
    _sql(
        f"SELECT symbol, ts_s, htf_total, long_count, short_count, long_score, short_score, atr_assumed, {', '.join(f'{r(x)} AS {c}' for c, x in _STOPS.items())}, CASE WHEN long_score - short_score >= 150 THEN 'long' WHEN short_score - long_score >= 150 THEN 'short' ELSE 'neutral' END AS dominant FROM sd",
        more=f"{_SEEN}, {_CONFLUENCE}",
        recursive=True,
    )
)
def mtf_confluence(spark: SparkSession, folder: str) -> DataFrame:
    out = M.confluence(_seen(spark, folder), "close", "quick", ["h4", "h2", "quick"], WEIGHTS)
    return shown(out, **{c: c for c in ("htf_total", "long_count", "short_count", "long_score", "short_score", "atr_assumed", *_STOPS, "dominant")})
