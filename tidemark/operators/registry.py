"""A keyed table of zones, brought up to date by what a map shows at a tick.

A map is computed anew at each tick and its bands wander, so a zone is known by
its anchor, not its coordinates: a sighting belongs to the stored zone of its
symbol, direction and kind whose anchor is nearest within a tolerance, whatever
timeframe it was seen on. What is stored keeps its touches and its worst and best
so far; a level that breaks changes its side and starts a record of its own; what
the map has not shown for some bars of its timeframe expires.

Sightings and stored zones meet on buckets of the anchor's logarithm, and the
rest is one full outer join on the zone's key, so a tick is one upsert over all
symbols at once. `streaming.registry` keeps the same table as keyed state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.zones import clusters

#: Tolerance of the anchor (a share), bars without a sighting, reactions that confirm, seconds of a horizon's bar.
TOLERANCE, EXPIRE_BARS, CONFIRM = 0.01, 8, 1
BAR_S = {"intraday": 900, "hourly": 3600, "local": 14400, "weekly": 86400}
ENDED = ("broken", "expired", "worked")

KEY = ["symbol", "direction", "kind"]
ZONES = "symbol string, zone_id string, horizon string, direction string, kind string, lo double, hi double, anchor double, target double, first_ms long, last_ms long, seen long, touches long, reactions long, progress double, adverse double, status string, in_zone boolean, flipped_from string"
SIGHTINGS = "symbol string, horizon string, direction string, kind string, lo double, hi double, anchor double, target double"


def zone_key(horizon: Column, direction: Column, kind: Column, anchor: Column, tolerance: float = TOLERANCE) -> Column:
    """The name a new zone gets: its anchor falls into a bucket as wide as the tolerance."""
    return F.concat_ws(":", horizon, direction, kind, F.floor(F.log(anchor) / math.log(1 + tolerance)).cast("string"))


def assigned(stored: DataFrame, sighted: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The sightings (without unusable ones) with the zone_id of the stored zone they belong to, or of a new one.

    Nearest anchor first, then least zone_id. Sightings that match nothing stored are one zone while their anchors
    stay within the tolerance of the lowest of them, named after the narrowest.
    """
    usable = sighted.where("lo <= hi AND anchor > 0").select([f.split()[0] for f in SIGHTINGS.split(", ")]).distinct()
    width = math.log1p(tolerance)
    bucket = F.floor(F.log("anchor") / width)
    held = stored.where("anchor > 0").select(*KEY, "zone_id", F.col("anchor").alias("held"), F.explode(F.array(*[bucket + k for k in (-2, -1, 0, 1, 2)])).alias("bucket"))
    apart = F.abs(F.col("anchor") / F.col("held") - 1)
    near = usable.withColumn("bucket", bucket).join(held, [*KEY, "bucket"], "left")
    known = near.groupBy(*usable.columns).agg(F.min_by("zone_id", F.when(apart <= tolerance, F.struct(apart, "zone_id"))).alias("zone_id"))
    alone = known.where("zone_id IS NULL").drop("zone_id")
    groups = clusters(alone.select(*KEY, F.col("anchor").alias("price"), F.lit(1.0).alias("weight")), KEY, tolerance, by="anchor").select(*KEY, F.col("lo").alias("least"), F.col("hi").alias("most"))
    grouped = alone.join(groups, KEY).where("anchor BETWEEN least AND most")
    first = F.min_by(F.struct("horizon", "anchor"), _narrowest()).over(W.partitionBy(*KEY, "least"))
    named = grouped.withColumn("first", first).withColumn("zone_id", zone_key(F.col("first.horizon"), F.col("direction"), F.col("kind"), F.col("first.anchor"), tolerance))
    return known.where("zone_id IS NOT NULL").unionByName(named.select(*known.columns))


def _narrowest() -> Column:
    return F.struct(F.col("hi") - F.col("lo"), "lo", "anchor", "horizon")


def observed(rows: DataFrame, price: Column, buffer: float) -> DataFrame:
    """touches, reactions, progress, adverse, in_zone and status of zones after a look at a price; NULL or not above 0 is no look."""
    long = F.col("direction") == "long"
    edge = F.when(long, F.col("hi")).otherwise(F.col("lo"))
    looked = rows.withColumn("__p", F.when(price > 0, price)).withColumn("__in", F.coalesce(F.col("__p").between(F.col("lo"), F.col("hi")), F.lit(False)))
    past = F.when(long, (F.col("lo") - F.col("__p")) / F.col("lo") * 100).otherwise((F.col("__p") - F.col("hi")) / F.col("hi") * 100)
    touched = looked.withColumns({
        "touches": F.col("touches") + F.when(F.col("__in") & ~F.col("in_zone"), 1).otherwise(0),
        "in_zone": F.when(F.col("__p").isNull(), F.col("in_zone")).otherwise(F.col("__in")),
        "__past": past,
        "__span": F.when(long, F.col("target") - edge).otherwise(edge - F.col("target")),
    })
    # A price that never touched the zone proves nothing about it.
    gone = F.when(long, F.col("__p") - edge).otherwise(edge - F.col("__p"))
    gone_far = touched.withColumn("__way", F.when((F.col("touches") > 0) & (F.col("__span") > 0), gone / F.col("__span")))
    judged = gone_far.withColumns({
        "progress": F.when(F.col("__way") > 0, F.greatest("progress", F.round("__way", 3))).otherwise(F.col("progress")),
        "reactions": F.col("reactions") + F.when((F.col("__way") >= 1) & (F.col("reactions") < F.col("touches")), 1).otherwise(0),
        "adverse": F.when(F.col("__past") > 0, F.greatest("adverse", F.round("__past", 3))).otherwise(F.col("adverse")),
    })
    reached = F.when(long, F.col("__p") >= F.col("target")).otherwise(F.col("__p") <= F.col("target"))
    status = (
        F.when(F.col("status").isin(*ENDED) | F.col("__p").isNull(), F.col("status"))
        .when(F.col("adverse") >= buffer * 100, "broken")
        .when(reached & (F.col("reactions") > 0), "worked")
        .when(F.col("reactions") >= CONFIRM, "confirmed")
        .otherwise(F.col("status"))
    )
    return judged.withColumn("status", status).drop("__p", "__in", "__past", "__span", "__way")


def updated(stored: DataFrame, sighted: DataFrame, prices: DataFrame, now_ms: int, buffer: float = 0.02, tolerance: float = TOLERANCE) -> DataFrame:
    """The stored zones after one tick, and `event`: created, or the status it changed to; NULL without a change.

    stored: ZONES, one row per (symbol, zone_id); sighted: SIGHTINGS; prices: symbol, price, one row a symbol.
    """
    seen = assigned(stored, sighted, tolerance)
    each = ["symbol", "zone_id"]
    best = seen.groupBy(*each).agg(F.min_by(F.struct("horizon", "direction", "kind", "lo", "hi", "anchor", "target"), _narrowest()).alias("s"), F.count("*").alias("times"))
    priced = prices.groupBy("symbol").agg(F.max("price").alias("price"))
    rows = stored.withColumn("known", F.lit(True)).join(best, each, "full").join(priced, "symbol", "left")
    new, shown = F.col("known").isNull(), F.col("s").isNotNull()
    narrower = F.coalesce(F.col("s.hi") - F.col("s.lo") <= F.col("hi") - F.col("lo"), F.lit(True)) | (F.col("hi") <= F.col("lo"))
    taken = {c: F.when(shown & narrower, F.col(f"s.{c}")).otherwise(F.col(c)) for c in ("lo", "hi", "anchor")}
    fixed = {c: F.coalesce(c, F.col(f"s.{c}")) for c in ("horizon", "direction", "kind")}
    begun = {"first_ms": F.coalesce("first_ms", F.lit(now_ms)), "status": F.coalesce("status", F.lit("forming")), "in_zone": F.coalesce("in_zone", F.lit(False))} | {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("touches", "reactions")}
    met = {"target": F.when(shown, F.col("s.target")).otherwise(F.col("target")), "last_ms": F.when(shown, F.lit(now_ms)).otherwise(F.col("last_ms")), "seen": (F.coalesce("seen", F.lit(0)) + F.coalesce("times", F.lit(0))).cast("long")}
    rows = rows.withColumns(taken | fixed | begun | met | {"before": F.col("status"), "shown": shown, "new": new})
    rows = observed(rows, F.when(F.col("shown"), F.col("price")), buffer)
    bar_ms = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BAR_S.items() for x in kv]), F.col("horizon")), F.lit(3600)) * 1000
    absent = ~F.col("shown") & ~F.col("status").isin(*ENDED) & (F.lit(now_ms) - F.col("last_ms") > bar_ms * EXPIRE_BARS)
    rows = rows.withColumn("status", F.when(absent, "expired").otherwise(F.col("status")))
    columns = [f.split()[0] for f in ZONES.split(", ")]
    # A new zone has its changes of status after its creation; both happen at this tick and the later one is told.
    after = rows.withColumn("event", F.when(F.col("status") != F.coalesce("before", F.lit("forming")), F.col("status")).when(F.col("new"), "created"))
    after = after.select(*columns, "event")
    # A broken zone leaves another of the opposite side, unless that is there already; two that break at once leave one.
    opposite = F.when(F.col("direction") == "long", "short").otherwise("long")
    fresh = {"kind": F.lit("flip"), "direction": opposite, "target": F.lit(None).cast("double"), "first_ms": F.lit(now_ms), "last_ms": F.lit(now_ms), "seen": F.lit(1).cast("long"), "touches": F.lit(0).cast("long"), "reactions": F.lit(0).cast("long"), "progress": F.lit(None).cast("double"), "adverse": F.lit(None).cast("double"), "status": F.lit("forming"), "in_zone": F.lit(False), "flipped_from": F.col("zone_id"), "zone_id": F.concat_ws(":", "horizon", opposite, F.lit("flip"), F.element_at(F.split("zone_id", ":"), -1)), "event": F.lit("created")}
    flip = F.struct(F.lit(1).alias("turned"), *[fresh.get(c, F.col(c)).alias(c) for c in after.columns])
    own = F.struct(F.lit(0).alias("turned"), *after.columns)
    both = after.select(F.inline(F.when(F.col("event") == "broken", F.array(own, flip)).otherwise(F.array(own))))
    place = F.row_number().over(W.partitionBy(*each).orderBy("turned", "flipped_from"))
    return both.withColumn("place", place).where("place = 1").select(*after.columns)
