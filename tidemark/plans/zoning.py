"""Queries of zones: the registry over several ticks, and what follows from zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import rounded
from tidemark.operators import figures as G
from tidemark.operators import registry as Z
from tidemark.plans.market import _sql, hourly
from tidemark.plans.registry import query
from tidemark.plans.sql import r
from tidemark.sources.tables import cut

START = 1705276800
#: Seconds of the ticks, and bars that the map of a horizon looks at.
TICKS = (START, START + 3600, START + 12 * 3600, START + 72 * 3600)
WINDOWS = {"hourly": 48, "local": 150, "weekly": 300}


def sightings(bars: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """The map at a time: boxes where four closes or more of a horizon's bars lie in one tenth of the price; and the prices."""
    recent = G.newest(bars.where(F.unix_seconds("ts") + 3600 <= at), max(WINDOWS.values()))
    prices = recent.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    back = F.max("i").over(G.W.partitionBy("symbol")) - F.col("i")
    horizon = F.explode(F.array_compact(F.array(*[F.when(F.col("back") < n, F.lit(h)) for h, n in WINDOWS.items()])))
    rows = recent.withColumn("back", back).select("symbol", "close", horizon.alias("horizon"))
    boxes = rows.groupBy("symbol", "horizon", F.floor(F.log("close") / F.log(F.lit(1.1))).alias("bin")).agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.count("*").alias("n")).where("n >= 4")
    anchor = (F.col("lo") + F.col("hi")) / 2
    side = F.when(F.col("price") > anchor, "long").otherwise("short").alias("direction")
    target = F.when(F.col("price") > anchor, F.col("hi") * 1.05).otherwise(F.col("lo") * 0.95).alias("target")
    return boxes.join(prices, "symbol").select("symbol", "horizon", side, F.lit("box").alias("kind"), "lo", "hi", anchor.alias("anchor"), target), prices


def _tick_sql(k: int, at: int) -> str:
    """CTEs of one tick: s (sightings), a (with their zone), z (zones after it)."""
    key = "x.symbol = y.symbol AND x.direction = y.direction AND x.kind = y.kind"
    narrow = "struct_pack(w := hi - lo, l := lo, a := anchor, h := horizon)"
    inside = "price BETWEEN lo AND hi"
    return f"""p{k} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) - 1 AS back FROM b WHERE ts_s + 3600 <= {at}),
q{k} AS (SELECT symbol, arg_max(close, ts_s) AS price FROM p{k} GROUP BY symbol),
s{k} AS (SELECT symbol, horizon, CASE WHEN price > (lo + hi) / 2 THEN 'long' ELSE 'short' END AS direction, 'box' AS kind, lo, hi, (lo + hi) / 2 AS anchor, CASE WHEN price > (lo + hi) / 2 THEN hi * 1.05 ELSE lo * 0.95 END AS target
  FROM (SELECT symbol, horizon, min(close) AS lo, max(close) AS hi FROM p{k} JOIN (VALUES {', '.join(f"('{h}', {n})" for h, n in WINDOWS.items())}) h(horizon, size) ON back < size GROUP BY symbol, horizon, floor(ln(close) / ln(1.1::DOUBLE)) HAVING count(*) >= 4) JOIN q{k} USING (symbol)),
m{k} AS (SELECT x.*, arg_min(y.zone_id, struct_pack(d := abs(x.anchor / y.anchor - 1), z := y.zone_id)) AS zone_id FROM s{k} x JOIN z{k - 1} y ON {key} AND abs(x.anchor / y.anchor - 1) <= 0.01 GROUP BY ALL),
n{k} AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction, kind ORDER BY anchor) AS i FROM (SELECT * FROM s{k} EXCEPT SELECT * EXCLUDE zone_id FROM m{k})),
f{k} AS (SELECT *, anchor AS head FROM n{k} WHERE i = 1 UNION ALL SELECT y.*, CASE WHEN y.anchor > x.head * 1.01 THEN y.anchor ELSE x.head END FROM f{k} x JOIN n{k} y ON {key} AND y.i = x.i + 1),
g{k} AS (SELECT symbol, direction, kind, head, arg_min(horizon, {narrow}) AS h, arg_min(anchor, {narrow}) AS a FROM f{k} GROUP BY ALL),
a{k} AS (FROM m{k} UNION ALL SELECT x.symbol, x.horizon, x.direction, x.kind, lo, hi, anchor, target, concat_ws(':', h, x.direction, x.kind, floor(ln(a) / ln(1.01::DOUBLE))::BIGINT) FROM f{k} x JOIN g{k} y ON {key} AND x.head = y.head),
t{k} AS (SELECT symbol, zone_id, count(*) AS times, arg_min(horizon, {narrow}) AS h, arg_min(direction, {narrow}) AS d, arg_min(kind, {narrow}) AS c, arg_min(lo, {narrow}) AS l, arg_min(hi, {narrow}) AS u, arg_min(anchor, {narrow}) AS a, arg_min(target, {narrow}) AS g FROM a{k} GROUP BY ALL),
v{k} AS (SELECT symbol, zone_id, coalesce(horizon, h) AS horizon, coalesce(direction, d) AS direction, coalesce(kind, c) AS kind, times IS NOT NULL AND (u - l <= hi - lo OR hi IS NULL OR hi <= lo) AS taken,
  CASE WHEN taken THEN l ELSE lo END AS lo, CASE WHEN taken THEN u ELSE hi END AS hi, CASE WHEN taken THEN a ELSE anchor END AS anchor, CASE WHEN times IS NOT NULL THEN g ELSE target END AS target,
  coalesce(first_ms, {at}000) AS first_ms, CASE WHEN times IS NOT NULL THEN {at}000 ELSE last_ms END AS last_ms, coalesce(seen, 0) + coalesce(times, 0) AS seen, coalesce(touches, 0) AS touches, coalesce(reactions, 0) AS reactions, progress, adverse,
  coalesce(status, 'forming') AS status, coalesce(in_zone, false) AS in_zone, flipped_from, CASE WHEN times IS NOT NULL THEN price END AS price, times IS NOT NULL AS shown, status IS NULL AS new, status IN ('broken', 'expired', 'worked') AND status IS NOT NULL AS ended
  FROM z{k - 1} FULL JOIN t{k} USING (symbol, zone_id) LEFT JOIN q{k} USING (symbol)),
w{k} AS (SELECT * REPLACE (touches + (shown AND {inside} AND NOT in_zone)::INTEGER AS touches, CASE WHEN shown THEN {inside} ELSE in_zone END AS in_zone),
  CASE WHEN shown AND touches + ({inside} AND NOT in_zone)::INTEGER > 0 AND CASE direction WHEN 'long' THEN target - hi ELSE lo - target END > 0 THEN CASE direction WHEN 'long' THEN (price - hi) / (target - hi) ELSE (lo - price) / (lo - target) END END AS way,
  CASE WHEN shown THEN CASE direction WHEN 'long' THEN (lo - price) / lo * 100 ELSE (price - hi) / hi * 100 END END AS past FROM v{k}),
x{k} AS (SELECT * REPLACE (CASE WHEN way > 0 THEN greatest(progress, round(way, 3)) ELSE progress END AS progress, reactions + coalesce(way >= 1 AND reactions < touches, false)::INTEGER AS reactions, CASE WHEN past > 0 THEN greatest(adverse, round(past, 3)) ELSE adverse END AS adverse) FROM w{k}),
y{k} AS (SELECT *, CASE WHEN ended THEN status
    WHEN NOT shown THEN CASE WHEN {at}000 - last_ms > 8000 * CASE horizon WHEN 'local' THEN 14400 WHEN 'weekly' THEN 86400 ELSE 3600 END THEN 'expired' ELSE status END
    WHEN adverse >= 2 THEN 'broken' WHEN reactions > 0 AND CASE direction WHEN 'long' THEN price >= target ELSE price <= target END THEN 'worked' WHEN reactions >= 1 THEN 'confirmed' ELSE status END AS after FROM x{k}),
o{k} AS (SELECT symbol, zone_id, horizon, direction, kind, lo, hi, anchor, target, first_ms, last_ms, seen, touches, reactions, progress, adverse, after AS status, in_zone, flipped_from, CASE WHEN after <> status THEN after WHEN new THEN 'created' END AS event FROM y{k}),
r{k} AS (SELECT *, concat_ws(':', horizon, CASE direction WHEN 'long' THEN 'short' ELSE 'long' END, 'flip', split_part(zone_id, ':', -1)) AS flip FROM o{k} WHERE event = 'broken'),
e{k} AS (FROM o{k} UNION ALL SELECT symbol, flip, horizon, CASE direction WHEN 'long' THEN 'short' ELSE 'long' END, 'flip', lo, hi, anchor, NULL, {at}000, {at}000, 1, 0, 0, NULL, NULL, 'forming', false, zone_id, 'created' FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, flip ORDER BY zone_id) AS i FROM r{k}) q WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM o{k} y WHERE y.symbol = q.symbol AND y.zone_id = flip)),
z{k} AS (SELECT * EXCLUDE event FROM e{k})"""


_NONE = "z0 AS (SELECT NULL::VARCHAR AS symbol, NULL::VARCHAR AS zone_id, NULL::VARCHAR AS horizon, NULL::VARCHAR AS direction, NULL::VARCHAR AS kind, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS anchor, NULL::DOUBLE AS target, NULL::BIGINT AS first_ms, NULL::BIGINT AS last_ms, NULL::BIGINT AS seen, NULL::BIGINT AS touches, NULL::BIGINT AS reactions, NULL::DOUBLE AS progress, NULL::DOUBLE AS adverse, NULL::VARCHAR AS status, NULL::BOOLEAN AS in_zone, NULL::VARCHAR AS flipped_from WHERE false)"
_REGISTRY = ", ".join([_NONE, *[_tick_sql(k, at) for k, at in enumerate(TICKS, 1)]])
_SHOWN = f"symbol, zone_id, horizon, direction, kind, {r('lo')} AS lo, {r('hi')} AS hi, {r('anchor')} AS anchor, {r('target')} AS target, first_ms, last_ms, seen::BIGINT AS seen, touches::BIGINT AS touches, reactions::BIGINT AS reactions, {r('progress', 3)} AS progress, {r('adverse', 3)} AS adverse, status, in_zone, flipped_from"


def _zones_after(spark: SparkSession, folder: str) -> list[DataFrame]:
    bars = cut(hourly(spark, folder))
    none = spark.createDataFrame([], Z.ZONES)
    out = []
    for at in TICKS:
        sighted, prices = sightings(bars, at)
        out.append(cut(Z.updated(out[-1].drop("event") if out else none, sighted, prices, at * 1000)))
    return out


def _rounded_zones(zones: DataFrame) -> DataFrame:
    return zones.withColumns({c: rounded(c) for c in ("lo", "hi", "anchor", "target")} | {c: rounded(c, 3) for c in ("progress", "adverse")})


@query(_sql(f"SELECT {_SHOWN} FROM z{len(TICKS)}", more=_REGISTRY, recursive=True))
def zone_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The zones known after four ticks, with their touches and fates."""
    return _rounded_zones(_zones_after(spark, folder)[-1].drop("event"))


@query(_sql("SELECT tick, symbol, zone_id, event FROM (" + " UNION ALL ".join(f"SELECT {k} AS tick, symbol, zone_id, event FROM e{k}" for k in range(1, len(TICKS) + 1)) + ") WHERE event IS NOT NULL", more=_REGISTRY, recursive=True))
def zone_events(spark: SparkSession, folder: str) -> DataFrame:
    """What each tick changed."""
    changed = [z.where("event IS NOT NULL").select(F.lit(k).alias("tick"), "symbol", "zone_id", "event") for k, z in enumerate(_zones_after(spark, folder), 1)]
    return reduce(DataFrame.unionAll, changed)
