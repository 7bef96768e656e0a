"""Queries of moving profiles, compared with profiles that are made anew at each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import moving as M
from tidemark.plans.market import _sql, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.sql import r

STEP = 0.02


def _profile_sql(p: str, n: int) -> str:
    """CTE p: the profile of the n bars up to each bar."""
    here = f"{p}_g.symbol = {p}_h.symbol AND {p}_g.rn = {p}_h.rn"
    at = lambda i: f"coalesce({p}_h.v[{i} + 1], -1)"
    return f"""{p}_b AS (SELECT symbol, ts_s, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts_s) AS rn FROM b WHERE low > 0),
{p}_s AS (SELECT *, round(volume / (z - a + 1) * 1000000)::BIGINT AS part FROM (SELECT *, floor(ln(low) / {STEP}::DOUBLE)::BIGINT AS a, floor(ln(high) / {STEP}::DOUBLE)::BIGINT AS z FROM {p}_b)),
{p}_c AS (SELECT w.symbol, w.rn, k.bucket, sum(s.part) AS v FROM {p}_b w JOIN {p}_s s ON s.symbol = w.symbol AND s.rn BETWEEN w.rn - {n - 1} AND w.rn, unnest(range(s.a, s.z + 1)) k(bucket) WHERE w.rn >= {n} GROUP BY ALL),
{p}_m AS (SELECT symbol, rn, min(bucket) AS base, max(bucket) AS top, arg_max(bucket, struct_pack(v := v, k := -bucket)) AS poc, sum(v) AS total FROM {p}_c GROUP BY ALL),
{p}_h AS (SELECT m.symbol, m.rn, any_value(base) AS base, any_value(poc) - any_value(base) AS poc, any_value(total) AS total, list(coalesce(c.v, 0)::BIGINT ORDER BY k.bucket) AS v FROM {p}_m m, unnest(range(base, top + 1)) k(bucket) LEFT JOIN {p}_c c ON c.symbol = m.symbol AND c.rn = m.rn AND c.bucket = k.bucket GROUP BY m.symbol, m.rn),
{p}_g AS (SELECT symbol, rn, 0 AS i, poc AS lo, poc AS hi, v[poc + 1]::HUGEINT AS held FROM {p}_h UNION ALL
  SELECT {p}_g.symbol, {p}_g.rn, i + 1, CASE WHEN {at('hi + 1')} >= CASE WHEN lo > 0 THEN {at('lo - 1')} ELSE -1 END THEN lo ELSE lo - 1 END, CASE WHEN {at('hi + 1')} >= CASE WHEN lo > 0 THEN {at('lo - 1')} ELSE -1 END THEN hi + 1 ELSE hi END, held + greatest({at('hi + 1')}, CASE WHEN lo > 0 THEN {at('lo - 1')} ELSE -1 END)
  FROM {p}_g JOIN {p}_h ON {here} WHERE held < 0.7::DOUBLE * total AND (lo > 0 OR hi < len(v) - 1)),
{p} AS (SELECT b.symbol, b.ts_s, b.rn, b.close, exp((h.poc + base + 0.5) * {STEP}::DOUBLE) AS poc, exp((g.hi + base + 1) * {STEP}::DOUBLE) AS vah, exp((g.lo + base) * {STEP}::DOUBLE) AS val FROM {p}_b b LEFT JOIN {p}_h h USING (symbol, rn) LEFT JOIN (SELECT symbol, rn, min(lo) AS lo, max(hi) AS hi FROM {p}_g GROUP BY ALL) g USING (symbol, rn)),
{p}_r AS (SELECT x.*, y.poc AS prior, CASE WHEN y.poc IS NOT NULL THEN EXISTS (SELECT 1 FROM {p}_b b WHERE b.symbol = x.symbol AND b.rn BETWEEN x.rn - {n - 1} AND x.rn AND low <= y.poc AND high >= y.poc) END AS touched,
  CASE WHEN (x.poc - y.poc) / y.poc * 100 > 0.15 THEN 'up' WHEN (x.poc - y.poc) / y.poc * 100 < -0.15 THEN 'down' WHEN y.poc > 0 AND x.poc > 0 THEN 'flat' END AS migrated FROM {p} x LEFT JOIN {p} y ON y.symbol = x.symbol AND y.rn = x.rn - {n})"""


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('poc')} AS poc, {r('vah')} AS vah, {r('val')} AS val, migrated, {r('CASE WHEN NOT touched AND abs(prior - close) / close > 0.002 THEN prior END')} AS naked_poc, CASE WHEN close > vah THEN 'long' WHEN close < val THEN 'short' END AS direction FROM q_r",
        more=_profile_sql("q", 24),
        recursive=True,
    )
)
def moving_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = M.profile_reading(M.moving_profile(hourly(spark, folder), 24, STEP))
    return shown(out, **{c: c for c in ("poc", "vah", "val", "migrated", "naked_poc", "direction")})


_WIDTH = "CASE WHEN {0}vah > {0}val AND {0}poc > 0 THEN ({0}vah - {0}val) / {0}poc * 100 END"
_SCORE = """CASE WHEN contraction < 0.7 THEN 0.35 WHEN contraction < 0.85 THEN 0.22 WHEN contraction < 0.95 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN migrated = 'flat' THEN 0.25 WHEN migrated IS NULL AND poc IS NOT NULL THEN 0.08 ELSE 0 END::DOUBLE
  + CASE WHEN (close - val) / (vah - val) BETWEEN 0 AND 0.35 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN vah > val AND abs(close - poc) / poc * 100 <= 1.5 THEN 0.12 ELSE 0 END::DOUBLE"""


@query(
    _sql(
        f"SELECT symbol, ts_s, {r('width')} AS width_pct, {r('contraction')} AS contraction, {r('CASE WHEN score > 0 THEN least(1, score) END')} AS accumulation FROM (SELECT *, {_SCORE} AS score FROM (SELECT *, width / nullif(slow, 0) AS contraction FROM (SELECT q_r.*, {_WIDTH.format('q_r.')} AS width, {_WIDTH.format('w.')} AS slow FROM q_r LEFT JOIN w USING (symbol, rn))))",
        more=f"{_profile_sql('q', 24)}, {_profile_sql('w', 96)}",
        recursive=True,
    )
)
def profile_accumulation(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    out = M.accumulation(M.moving_profile(bars, 24, STEP), M.moving_profile(bars, 96, STEP))
    return shown(out, **{c: c for c in ("width_pct", "contraction", "accumulation")})
