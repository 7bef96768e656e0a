"""Queries of the decision ledger: every sixth bar of a symbol is a decision at its close, long or short in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import bars as B
from tidemark.operators import decisions as D
from tidemark.operators import invalidation as I
from tidemark.operators import windows as R
from tidemark.plans.market import _sql, hourly
from tidemark.plans.registry import query
from tidemark.plans.sql import over, r
from tidemark.sources.tables import instant, table

_MOVE = "CASE WHEN dir = 'long' THEN {0} - entry ELSE entry - {0} END / atr"
_BEST, _WORST = _MOVE.format("CASE WHEN dir = 'long' THEN p.high ELSE p.low END"), _MOVE.format("CASE WHEN dir = 'long' THEN p.low ELSE p.high END")
_GRID = [str(g).replace(".", "_") for g in D.GRID]
_DECISIONS = f"""rg AS (SELECT *, high - low AS span, avg(high - low) {over(14)} AS atr FROM b),
dc AS (SELECT symbol, symbol || ':' || ts_s AS candidate_id, ts_s + 3600 AS at_s, CASE WHEN rn % 12 = 0 THEN 'long' ELSE 'short' END AS dir, close AS entry, nullif(atr, 0) AS atr, CASE WHEN trades > 2 THEN 'passed' WHEN taker_buy > 0 THEN 'thin' ELSE 'one_sided' END AS gate FROM rg WHERE rn % 6 = 0 AND rn >= 14),
mv AS (SELECT d.candidate_id, (p.ts_s - at_s) / 60.0::DOUBLE AS m, {_BEST} AS best, {_WORST} AS worst, {_MOVE.format('p.close')} AS last, CASE WHEN dir = 'long' THEN 1 ELSE -1 END * (p.close / entry - 1) * 100 AS pct
  FROM dc d JOIN b p ON p.symbol = d.symbol AND p.ts_s BETWEEN at_s AND at_s + 86400 WHERE entry > 0 AND atr > 0),
pt AS (SELECT candidate_id, count(*) AS bars, greatest(max(best), 0) AS mfe, min(-worst) AS nw, least(min(worst), 0) AS mae,
  {', '.join(f"min(CASE WHEN best >= {g} THEN m END) AS for_{n}, min(CASE WHEN worst <= -{g} THEN m END) AS against_{n}" for g, n in zip(D.GRID, _GRID, strict=True))},
  {', '.join(f"arg_min(last, m) FILTER (m >= {o}) AS ret_{o}_atr, arg_min(pct, m) FILTER (m >= {o}) AS ret_{o}_pct" for o in D.OFFSETS_MIN)} FROM mv GROUP BY candidate_id),
tm AS (SELECT candidate_id, min(m) FILTER (best = mfe AND mfe > 0) AS mfe_min, min(m) FILTER (worst = mae AND mae < 0) AS mae_min FROM mv JOIN pt USING (candidate_id) GROUP BY candidate_id),
pa AS (SELECT d.*, coalesce(bars, 0) AS bars, mfe, mae, mfe_min, mae_min, {', '.join(f"least(for_{n}, against_{n}) AS touch_{n}, CASE WHEN against_{n} <= for_{n} OR (for_{n} IS NULL AND against_{n} IS NOT NULL) THEN -1 WHEN for_{n} IS NOT NULL THEN 1 END AS side_{n}" for n in _GRID)}, {', '.join(f"ret_{o}_atr, ret_{o}_pct" for o in D.OFFSETS_MIN)}
  FROM dc d LEFT JOIN pt USING (candidate_id) LEFT JOIN tm USING (candidate_id))"""


def _paths(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    bars = hourly(spark, folder)
    number = F.row_number().over(R.by_symbol())
    gate = F.when(F.col("trades") > 2, "passed").when(F.col("taker_buy") > 0, "thin").otherwise("one_sided")
    rows = bars.withColumns({"rn": number, "atr": R.rolling(F.avg, F.col("high") - F.col("low"), 14)}).where("rn % 6 = 0 AND rn >= 14")
    decided = F.timestamp_seconds(F.unix_seconds("ts") + 3600)
    made = rows.select(F.concat_ws(":", "symbol", F.unix_seconds("ts")).alias("candidate_id"), "symbol", decided.alias("decided"), F.when(F.col("rn") % 12 == 0, "long").otherwise("short").alias("direction"), F.col("close").alias("entry"), F.nullif("atr", F.lit(0.0)).alias("atr"), gate.alias("gate"))
    return made, D.forward_paths(made, bars)


_SHOWN = ["mfe_atr", "mae_atr", *[f"ret_{o}_{k}" for o in D.OFFSETS_MIN for k in ("atr", "pct")]]


@query(
    _sql(
        f"SELECT candidate_id, bars, {r('mfe')} AS mfe_atr, mfe_min, {r('mae')} AS mae_atr, mae_min, {', '.join(f'touch_{n}, side_{n}' for n in _GRID)}, {', '.join(f'{r(c)} AS {c}' for c in _SHOWN[2:])} FROM pa",
        more=_DECISIONS,
    )
)
def decision_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = _paths(spark, folder)[1].drop(*D.DECISION[1:])
    return paths.withColumns({c: rounded(c) for c in _SHOWN})


@query(
    _sql(
        f"SELECT gate, count(*) AS n, count(side_2_0) AS resolved, count_if(side_2_0 = 1) AS hits, {r('avg(mfe)')} AS mean_mfe, {r('count_if(side_2_0 = 1) / nullif(count(side_2_0), 0)')} AS hit_rate FROM pa WHERE bars > 0 GROUP BY gate",
        more=_DECISIONS,
    )
)
def gate_blindness(spark: SparkSession, folder: str) -> DataFrame:
    made, paths = _paths(spark, folder)
    return D.gate_blindness(paths.join(made.select("candidate_id", "gate"), "candidate_id")).withColumns({c: rounded(c) for c in ("mean_mfe", "hit_rate")})


_ENDS = f"""v AS (SELECT *, count(volume) OVER w = 20 AND volume > 1.5 * avg(volume) OVER w AS loud FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
si AS (SELECT *, entry - 0.3 * atr AS entry_lo, entry + 0.3 * atr AS entry_hi, CASE WHEN dir = 'long' THEN entry - 2 * atr WHEN at_s % 7200 = 0 THEN entry + 2 * atr END AS stop, CASE WHEN dir = 'long' THEN entry - atr ELSE entry + atr END AS middle FROM dc),
sl AS (SELECT *, CASE WHEN dir = 'long' THEN CASE WHEN stop > 0 AND stop < entry_lo THEN stop ELSE entry_lo * (1 - 0.005::DOUBLE) END ELSE CASE WHEN stop > entry_hi THEN stop ELSE entry_hi * (1 + 0.005::DOUBLE) END END AS level,
  CASE WHEN CASE WHEN dir = 'long' THEN middle > 0 AND middle < entry_lo ELSE middle > entry_hi END THEN middle END AS zone_level FROM si),
en AS (SELECT candidate_id, any_value(level) AS level, any_value(zone_level) AS zone_level, min(e) FILTER (CASE WHEN dir = 'long' THEN c < level ELSE c > level END) AS structure_s, min(e) FILTER (CASE WHEN dir = 'long' THEN c < zone_level ELSE c > zone_level END) AS zone_s, min(e) FILTER (loud AND CASE WHEN dir = 'long' THEN c < o ELSE c > o END) AS volume_s
  FROM (SELECT sl.*, v.ts_s + 3600 AS e, v.open AS o, v.close AS c, v.loud FROM sl LEFT JOIN v ON v.symbol = sl.symbol AND v.ts_s BETWEEN at_s AND at_s + 172800) GROUP BY candidate_id)"""


@query(
    _sql(
        f"SELECT candidate_id AS scenario_id, {r('level')} AS level, {r('zone_level')} AS zone_level, structure_s, zone_s, volume_s, least(structure_s, zone_s, volume_s) AS ended_s, CASE least(structure_s, zone_s, volume_s) WHEN structure_s THEN 'structure' WHEN zone_s THEN 'zone' WHEN volume_s THEN 'volume' END AS reason FROM en",
        more=f"{_DECISIONS}, {_ENDS}",
    )
)
def scenario_ends(spark: SparkSession, folder: str) -> DataFrame:
    made = _paths(spark, folder)[0]
    long, away = F.col("direction") == "long", F.when(F.col("direction") == "long", F.col("entry") - F.col("atr")).otherwise(F.col("entry") + F.col("atr"))
    stop = F.when(long, F.col("entry") - 2 * F.col("atr")).when(F.unix_seconds("decided") % 7200 == 0, F.col("entry") + 2 * F.col("atr"))
    scenarios = made.select(F.col("candidate_id").alias("scenario_id"), "symbol", "decided", "direction", (F.col("entry") - 0.3 * F.col("atr")).alias("entry_lo"), (F.col("entry") + 0.3 * F.col("atr")).alias("entry_hi"), stop.alias("stop"), away.alias("zone_lo"), away.alias("zone_hi"))
    out = I.first_invalidations(scenarios, hourly(spark, folder), 3600, 172_800)
    return out.select("scenario_id", rounded("level").alias("level"), rounded("zone_level").alias("zone_level"), "structure_s", "zone_s", "volume_s", "ended_s", "reason")


@query(
    """WITH l AS (SELECT l_returnflag || l_linestatus AS symbol, (epoch_us(l_shipdate) // 1000000)::BIGINT AS t, l_quantity::DOUBLE AS open, l_partkey / 20.0::DOUBLE AS high, l_suppkey / 2.0::DOUBLE AS low, CASE WHEN l_linenumber <> 3 THEN l_quantity - 1.0 END::DOUBLE AS close, l_discount - 0.02 AS volume FROM lineitem),
d AS (SELECT symbol, t, count(*) AS n FROM l GROUP BY 1, 2), g AS (SELECT symbol, n, t, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) > 129600 AS wide FROM d)
SELECT * FROM (SELECT symbol, count(*) AS bars, min(t) AS first_s, max(t) AS last_s, count_if(t % 86400 <> 0)::BIGINT AS off_grid, count_if(high < low)::BIGINT AS high_below_low, count_if(coalesce(greatest(open, close) > high OR least(open, close) < low, false))::BIGINT AS outside, count_if(least(open, high, low, close) <= 0)::BIGINT AS not_positive, count_if(volume < 0)::BIGINT AS negative_volume, count_if(close IS NULL)::BIGINT AS nulls FROM l GROUP BY symbol)
JOIN (SELECT symbol, sum(n - 1)::BIGINT AS repeats, count_if(coalesce(wide, false))::BIGINT AS gaps FROM g GROUP BY symbol) USING (symbol)"""
)
def bar_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as daily bars, full of faults."""
    lines = table(spark, folder, "lineitem")
    close = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") - 1.0)
    rows = lines.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), instant(lines, "l_shipdate").alias("ts"), F.col("l_quantity").cast("double").alias("open"), (F.col("l_partkey") / 20.0).alias("high"), (F.col("l_suppkey") / 2.0).alias("low"), close.cast("double").alias("close"),
        (F.col("l_discount") - 0.02).alias("volume"),
    )
    return B.bar_faults(rows, 86_400)
