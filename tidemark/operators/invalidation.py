"""What ends a scenario, as levels, and when its bars did: structure, volume against it, a way back into the zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import intervals
from tidemark.operators.windows import by_symbol

#: Share beyond the entry band, and volume of a bar against it over the mean of bars before.
BEYOND, LOUD, MEAN_BARS = 0.005, 1.5, 20
SCENARIO = ("scenario_id", "symbol", "decided", "direction", "entry_lo", "entry_hi", "stop", "zone_lo", "zone_hi")


def invalidation_levels(scenarios: DataFrame) -> DataFrame:
    """scenarios (SCENARIO) with level (the stop, where it lies beyond the entry band; else half a per cent beyond) and zone_level (the zone's middle, where it lies beyond the band)."""
    long = F.col("direction") == "long"
    level = F.when(long, F.when((F.col("stop") > 0) & (F.col("stop") < F.col("entry_lo")), F.col("stop")).otherwise(F.col("entry_lo") * (1 - BEYOND)))
    level = level.otherwise(F.when(F.col("stop") > F.col("entry_hi"), F.col("stop")).otherwise(F.col("entry_hi") * (1 + BEYOND)))
    middle = (F.col("zone_lo") + F.col("zone_hi")) / 2
    zone = F.when(F.when(long, (middle > 0) & (middle < F.col("entry_lo"))).otherwise(middle > F.col("entry_hi")), middle)
    return scenarios.withColumns({"level": level, "zone_level": zone})


def first_invalidations(scenarios: DataFrame, bars: DataFrame, width_s: int, horizon_s: int) -> DataFrame:
    """One row per scenario: level, zone_level, and the close (seconds) of the first bar of each condition, with the earliest and its reason.

    structure: a close beyond `level`; volume: a close beyond `level`'s side of the open with LOUD times the mean volume of
    the MEAN_BARS bars before; zone: a close beyond `zone_level`. Bars open from `decided` to the horizon. Of conditions in
    one bar structure comes first, then zone. Rows of one scenario_id are one; nothing found, or no bars: NULL.
    """
    once = invalidation_levels(scenarios.select(*SCENARIO).dropDuplicates(["scenario_id"]))
    before = by_symbol().rowsBetween(-MEAN_BARS, -1)
    mean = F.when(F.count("volume").over(before) == MEAN_BARS, F.avg("volume").over(before))
    loud = bars.select("symbol", "ts", "open", "close", F.coalesce(F.col("volume") > LOUD * mean, F.lit(False)).alias("loud"))
    spans = once.where("symbol IS NOT NULL AND decided IS NOT NULL").withColumn("until", F.timestamp_seconds(F.unix_seconds("decided") + horizon_s))
    met = intervals(loud, spans, "symbol", "ts", "decided", "until")
    long, at = F.col("direction") == "long", F.unix_seconds("ts") + width_s
    past = lambda level: F.when(long, F.col("close") < level).otherwise(F.col("close") > level)
    first = lambda condition: F.min(F.when(condition, at))
    found = met.groupBy("scenario_id").agg(first(past(F.col("level"))).alias("structure_s"), first(past(F.col("zone_level"))).alias("zone_s"), first(F.col("loud") & past(F.col("open"))).alias("volume_s"))
    out = once.join(found, "scenario_id", "left").withColumn("ended_s", F.least("structure_s", "zone_s", "volume_s"))
    reason = F.when(F.col("structure_s") == F.col("ended_s"), "structure").when(F.col("zone_s") == F.col("ended_s"), "zone").when(F.col("volume_s") == F.col("ended_s"), "volume")
    return out.withColumn("reason", reason)
