"""Queries of pump legs, lines of zones and broken trend lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import legs as L
from tidemark.operators import lines as N
from tidemark.operators import recursive as K
from tidemark.operators import windows as R
from tidemark.plans.market import _TR, _sql, hourly, shown
from tidemark.plans.registry import query
from tidemark.plans.setups import _zones
from tidemark.plans.sql import LINE, r, recursion

_MS = 3_600_000
_LEGS = f"""o AS (SELECT symbol, rn, ts_s * 1000 AS ms, close AS price, close / lag(close, 24) {LINE} - 1 AS change FROM b),
f AS (SELECT o.symbol, k.kind, k.s, rn, ms, price, change * k.s >= 0.15 AND change IS NOT NULL AS open, CASE WHEN change * k.s >= 0.15 THEN ms END AS start_ms, price AS start, price AS extreme, 0.0::DOUBLE AS fraction, CASE WHEN change * k.s >= 0.15 THEN 'leg_' || kind END AS event FROM o, (VALUES ('pump', 1), ('dump', -1)) k(kind, s) WHERE rn = 1
  UNION ALL SELECT symbol, kind, s, rn, ms, price, CASE WHEN was THEN ended IS NULL ELSE begun END, CASE WHEN begun THEN ms ELSE start_ms END, CASE WHEN begun THEN price ELSE start END, CASE WHEN begun THEN price ELSE top END, CASE WHEN was THEN way ELSE 0 END, coalesce(ended, CASE WHEN begun THEN 'leg_' || kind END)
  FROM (SELECT *, CASE WHEN NOT was THEN NULL WHEN way + 1e-9 >= 0.5 THEN 'retrace_hit' WHEN ms - start_ms > 48 * {_MS} THEN 'retrace_miss' END AS ended, NOT was AND coalesce(change * s >= 0.15, false) AND (start_ms IS NULL OR ms - start_ms >= 24 * {_MS}) AS begun
  FROM (SELECT *, CASE WHEN s * (top - start) > 0 THEN s * (top - price) / (s * (top - start)) ELSE 0 END AS way
  FROM (SELECT f.symbol, kind, s, o.rn, o.ms, o.price, o.change, f.open AS was, start_ms, start, CASE WHEN NOT f.open THEN extreme WHEN s > 0 THEN greatest(extreme, o.price) ELSE least(extreme, o.price) END AS top FROM f JOIN o ON o.symbol = f.symbol AND o.rn = f.rn + 1)))),
ev AS (SELECT * FROM f WHERE event IS NOT NULL)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    change = F.col("close") / F.lag("close", 24).over(R.by_symbol()) - 1
    return L.leg_events(bars.select("symbol", (F.unix_seconds("ts") * 1000).alias("ms"), F.col("close").alias("price"), change.alias("change")))


@query(_sql(f"SELECT symbol, kind, ms, event, {r('price')} AS price, start_ms, {r('start')} AS start, {r('extreme')} AS extreme, {r('fraction')} AS fraction FROM ev", more=_LEGS, recursive=True))
def pump_legs(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).withColumns({c: rounded(c) for c in ("price", "start", "extreme", "fraction")})


@query(
    _sql(
        f"""SELECT symbol, pumps, dumps, resolved, hits, {r('hours')} AS retrace_hours, {r('rate')} AS retrace_pct,
  CASE WHEN pumps >= 2 THEN 4.0 ELSE 0 END + CASE WHEN pumps >= 2 AND rate >= 55 THEN 6 ELSE 0 END - CASE WHEN pumps >= 3 AND rate < 30 THEN 4 ELSE 0 END + CASE WHEN pumps >= 2 AND hours <= 4 THEN 3 ELSE 0 END::DOUBLE AS bonus,
  concat_ws(',', CASE WHEN pumps >= 2 THEN 'repeat_pumper' END, CASE WHEN pumps >= 2 AND rate >= 55 THEN 'retrace_friendly' END, CASE WHEN pumps >= 3 AND rate < 30 THEN 'sticky_pump' END, CASE WHEN pumps >= 2 AND hours <= 4 THEN 'fast_retrace' END) AS flags
FROM (SELECT symbol, count_if(event = 'leg_pump') AS pumps, count_if(event = 'leg_dump') AS dumps, count_if(event LIKE 'retrace%') AS resolved, count_if(event = 'retrace_hit') AS hits, avg(CASE WHEN event = 'retrace_hit' THEN (ms - start_ms) / {_MS} END) AS hours, 100 * count_if(event = 'retrace_hit') / nullif(count_if(event LIKE 'retrace%'), 0) AS rate FROM ev GROUP BY symbol)""",
        more=_LEGS,
        recursive=True,
    )
)
def pump_history(spark: SparkSession, folder: str) -> DataFrame:
    points, flags = L.score_bonus()
    return L.history(_events(spark, folder)).withColumns({"bonus": points, "flags": F.array_join(flags, ","), "retrace_hours": rounded("retrace_hours"), "retrace_pct": rounded("retrace_pct")})


_KEY = "symbol, lo, hi"
_LINES = f"""pool AS (SELECT *, max(rn) OVER (PARTITION BY symbol) - rn AS back FROM b),
zn AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM pool WHERE back < 300 GROUP BY symbol, floor(ln(close) / ln(1.1::DOUBLE)) HAVING count(*) >= 8 AND min(close) < max(close)),
ins AS (SELECT zn.*, rn, row_number() OVER (PARTITION BY {_KEY} ORDER BY rn) AS k, rn - lag(rn) OVER (PARTITION BY {_KEY} ORDER BY rn) > 3 AS far FROM b JOIN zn USING (symbol) WHERE low <= hi AND high >= lo),
runs AS (SELECT {_KEY}, run, min(rn) AS first, max(rn) AS last FROM (SELECT *, count_if(coalesce(far, false)) OVER (PARTITION BY {_KEY} ORDER BY rn) AS run FROM ins) GROUP BY {_KEY}, run HAVING max(rn) - min(rn) >= 4),
best AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY round(traded, 6) DESC, last - first DESC, first) AS k FROM (SELECT r.*, (SELECT sum(volume) FROM b WHERE b.symbol = r.symbol AND rn BETWEEN first AND last) AS traded FROM runs r)),
st AS (SELECT {_KEY}, high, low, volume, greatest(4, least(120, floor((hi / lo - 1) * 100 / 0.02)))::INTEGER AS n FROM best JOIN b USING (symbol) WHERE k = 1 AND rn BETWEEN first AND last),
bk AS (SELECT {_KEY}, n, bucket, (hi - lo) / n AS step FROM (SELECT DISTINCT {_KEY}, n FROM st WHERE high >= lo AND low <= hi), unnest(range(n)) t(bucket)),
de AS (SELECT {_KEY}, bucket, any_value(step) AS step, count(volume) AS touches, round(coalesce(sum(CASE WHEN high > low THEN volume * greatest(least(high, lo + (bucket + 1) * step) - greatest(low, lo + bucket * step), 0) / (high - low) ELSE volume END), 0), 6) AS volume
  FROM bk LEFT JOIN (SELECT * FROM st WHERE high >= lo AND low <= hi) s USING (symbol, lo, hi) WHERE bucket BETWEEN least(bk.n - 1, floor((greatest(low, lo) - lo) / step)) AND least(bk.n - 1, floor((least(high, hi) - lo) / step)) GROUP BY {_KEY}, bucket),
df AS (SELECT {_KEY}, bucket, bk.step, coalesce(touches, 0) AS touches, coalesce(volume, 0) AS volume FROM bk LEFT JOIN de USING (symbol, lo, hi, bucket)),
pk AS (SELECT {_KEY}, lo + (bucket + 0.5) * step AS price, touches, volume FROM (SELECT *, lag(touches, 1, -1) OVER w AS a, lead(touches, 1, -1) OVER w AS z FROM df WINDOW w AS (PARTITION BY {_KEY} ORDER BY bucket)) WHERE touches > 0 AND touches >= a AND touches >= z),
rk AS (SELECT {_KEY}, price, row_number() OVER (PARTITION BY {_KEY} ORDER BY kind, touches DESC, volume DESC, price) AS k FROM (SELECT *, 0 AS kind FROM pk UNION ALL SELECT DISTINCT {_KEY}, lo, 0, 0, 1 FROM pk UNION ALL SELECT DISTINCT {_KEY}, hi, 0, 0, 2 FROM pk)),
gr AS (SELECT {_KEY}, 0::BIGINT AS k, []::DOUBLE[] AS taken FROM (SELECT DISTINCT {_KEY} FROM rk) UNION ALL
  SELECT {_KEY}, k, CASE WHEN len(taken) < 4 AND len(list_filter(taken, lambda q: abs(price / q - 1) * 100 <= 0.25)) = 0 THEN list_append(taken, price) ELSE taken END FROM (SELECT gr.symbol, gr.lo, gr.hi, rk.k, rk.price, gr.taken FROM gr JOIN rk ON rk.symbol = gr.symbol AND rk.lo = gr.lo AND rk.hi = gr.hi AND rk.k = gr.k + 1)),
ln AS (SELECT {_KEY}, unnest(arg_max(taken, k)) AS price FROM gr GROUP BY {_KEY}),
ms AS (SELECT {_KEY}, price, count_if(hit) AS touches, sum(CASE WHEN hit THEN volume ELSE 0 END) AS volume FROM (SELECT {_KEY}, price, volume, low <= price * (1 + 0.08 / 100) AND high >= price * (1 - 0.08 / 100) AS hit FROM ln JOIN st USING (symbol, lo, hi)) GROUP BY {_KEY}, price)"""


@query(
    _sql(
        f"SELECT symbol, {r('lo')} AS lo, {r('hi')} AS hi, {r('price')} AS price, touches, {r('volume')} AS volume, touches > 0 AND k = 1 AS key FROM (SELECT *, count(*) OVER (PARTITION BY {_KEY}) AS n, row_number() OVER (PARTITION BY {_KEY} ORDER BY round(touches * volume, 6) DESC, price) AS k FROM ms) WHERE n >= 2",
        more=_LINES,
        recursive=True,
    )
)
def zone_lines(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder)
    return N.zone_lines(_zones(bars), bars).withColumns({c: rounded(c) for c in ("lo", "hi", "price", "volume")})


_W = "(PARTITION BY symbol ORDER BY rn"
_BREAKS = f"""z AS (SELECT t.symbol, t.ts_s, t.rn, t.high, t.low, 100 * u.y / nullif(u.y + d.y, 0) AS rsi FROM t LEFT JOIN u ON u.symbol = t.symbol AND u.rn = t.rn LEFT JOIN d ON d.symbol = t.symbol AND d.rn = t.rn),
pv AS (SELECT *, count(*) OVER p = 5 AND lead(high) OVER w IS NOT NULL AND high > max(high) OVER p AND high > lead(high) OVER w AS ph, count(*) OVER p = 5 AND lead(low) OVER w IS NOT NULL AND low < min(low) OVER p AND low < lead(low) OVER w AS pl FROM z WINDOW w AS {_W}), p AS {_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
pr AS (SELECT symbol, 'bear' AS side, rn, rsi, lag(rn) OVER w AS rn1, lag(rsi) OVER w AS rsi1 FROM pv WHERE ph WINDOW w AS {_W}) UNION ALL SELECT symbol, 'bull', rn, rsi, lag(rn) OVER w, lag(rsi) OVER w FROM pv WHERE pl WINDOW w AS {_W})),
nw AS (SELECT z.symbol, z.ts_s, z.rn AS i, z.rsi AS now, z.prev, pr.* EXCLUDE symbol FROM (SELECT *, lag(rsi) OVER {_W}) AS prev FROM z) z ASOF JOIN (SELECT *, rn + 2 AS known FROM pr WHERE side = 'bear') pr ON z.symbol = pr.symbol AND z.rn >= known
  UNION ALL SELECT z.symbol, z.ts_s, z.rn, z.rsi, z.prev, pr.* EXCLUDE symbol FROM (SELECT *, lag(rsi) OVER {_W}) AS prev FROM z) z ASOF JOIN (SELECT *, rn + 2 AS known FROM pr WHERE side = 'bull') pr ON z.symbol = pr.symbol AND z.rn >= known),
cr AS (SELECT *, rsi1 + (rsi - rsi1) * (i - rn1) / (rn - rn1) AS here, rsi1 + (rsi - rsi1) * (i - 1 - rn1) / (rn - rn1) AS held FROM nw WHERE i - rn1 <= 50)"""


@query(
    _sql(
        "SELECT * FROM (SELECT symbol, ts_s, coalesce(bool_or(side = 'bear' AND prev >= held AND now < here), false) AS bear_break, coalesce(bool_or(side = 'bull' AND prev <= held AND now > here), false) AS bull_break FROM cr GROUP BY symbol, ts_s) WHERE bear_break OR bull_break",
        more=", ".join([_TR, recursion("u", "t", "up", 1 / 14, 14, 1), recursion("d", "t", "dn", 1 / 14, 14, 1), _BREAKS]),
        recursive=True,
    )
)
def trendline_breaks(spark: SparkSession, folder: str) -> DataFrame:
    bars = hourly(spark, folder).select("symbol", "ts", "high", "low", "close")
    rsi = bars.join(K.rsi(bars, 14).select("symbol", "ts", "rsi14"), ["symbol", "ts"])
    return shown(N.trendline_breaks(rsi, "rsi14").where("bear_break OR bull_break"), bear_break="bear_break", bull_break="bull_break")
