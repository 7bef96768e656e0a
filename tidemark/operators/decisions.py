"""The decision ledger: what happened to the price after each decision, taken or filtered.

A decision is written when it is made and never changed; its path follows when
its horizon has passed. A path is one aggregate over the bars of the decision's
interval, so a hot symbol's decisions are combined before they are shuffled. The
stream of `streaming.decisions` keeps pending decisions as the state of an
interval join and uses the same aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import intervals

#: Minutes after which the return is noted, and thresholds (in average ranges) whose first touch is.
OFFSETS_MIN, GRID = (15, 60, 240, 480, 1440), (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
HORIZON_S = 24 * 3600


def _name(g: float) -> str:
    return str(g).replace(".", "_")


def path_aggregates() -> dict[str, Column]:
    """Over rows with decided, direction, entry, atr and a bar's ts, high, low, close (NULL where a decision has no bar)."""
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    usable = (F.col("entry") > 0) & (F.col("atr") > 0) & F.col("ts").isNotNull()
    move = lambda price: F.when(usable, sign * (price - F.col("entry")) / F.col("atr"))
    long = F.col("direction") == "long"
    best, worst = move(F.when(long, F.col("high")).otherwise(F.col("low"))), move(F.when(long, F.col("low")).otherwise(F.col("high")))
    ms = lambda c: F.unix_micros(c) / 1000
    elapsed = (ms("ts") - ms("decided")) / 60_000
    first = lambda condition: F.min(F.when(condition, elapsed))
    out = {
        "bars": F.count(F.when(usable, 1)),
        "__best": F.max(F.when(best > 0, F.struct(best.alias("x"), (-elapsed).alias("m")))),
        "__worst": F.min(F.when(worst < 0, F.struct(worst.alias("x"), elapsed.alias("m")))),
    }
    for g in GRID:
        out |= {f"__for_{_name(g)}": first(best >= g), f"__against_{_name(g)}": first(worst <= -g)}
    for m in OFFSETS_MIN:
        out[f"__ret_{m}"] = F.min(F.when(usable & (elapsed >= m), F.struct(elapsed.alias("m"), move(F.col("close")).alias("atr"), (sign * (F.col("close") / F.col("entry") - 1) * 100).alias("pct"))))
    return out


def path_columns(rows: DataFrame, *keep: str) -> DataFrame:
    """The aggregates as columns: mfe, mae (in ranges, with minutes), ret_* (ranges and percent), touch_* (minutes) and side_* (1 for, -1 against; against first in a bar)."""
    some = F.col("bars") > 0
    out = [F.when(some, F.coalesce("__best.x", F.lit(0.0))).alias("mfe_atr"), (-F.col("__best.m")).alias("mfe_min"), F.when(some, F.coalesce("__worst.x", F.lit(0.0))).alias("mae_atr"), F.col("__worst.m").alias("mae_min")]
    for m in OFFSETS_MIN:
        out += [F.col(f"__ret_{m}.atr").alias(f"ret_{m}_atr"), F.col(f"__ret_{m}.pct").alias(f"ret_{m}_pct")]
    for g in map(_name, GRID):
        good, bad = F.col(f"__for_{g}"), F.col(f"__against_{g}")
        out += [F.least(good, bad).alias(f"touch_{g}"), F.when(bad.isNotNull() & (good.isNull() | (bad <= good)), -1).when(good.isNotNull(), 1).alias(f"side_{g}")]
    return rows.select(*keep, "bars", *out)


DECISION = ("candidate_id", "symbol", "decided", "direction", "entry", "atr")


def forward_paths(decisions: DataFrame, bars: DataFrame, horizon_s: int = HORIZON_S) -> DataFrame:
    """One row per decision (candidate_id, symbol, decided, direction, entry, atr) and what its bars (symbol, ts, high, low, close) from `decided` to the horizon made of it.

    A decision without bars, entry or range has NULLs and bars = 0. Rows of one candidate_id are one decision.
    """
    once = decisions.select(*DECISION).dropDuplicates(["candidate_id"])
    spans = once.where("symbol IS NOT NULL AND decided IS NOT NULL").withColumn("until", F.timestamp_seconds(F.unix_seconds("decided") + horizon_s))
    met = intervals(bars.select("symbol", "ts", "high", "low", "close"), spans, "symbol", "ts", "decided", "until")
    paths = met.groupBy("candidate_id").agg(*[x.alias(c) for c, x in path_aggregates().items()])
    shown = once.join(paths, "candidate_id", "left").withColumn("bars", F.coalesce("bars", F.lit(0).cast("long")))
    return path_columns(shown, *DECISION)


def pending(decisions: DataFrame, paths: DataFrame, now: Column, horizon_s: int = HORIZON_S) -> DataFrame:
    """Decisions whose horizon has passed and that have no path yet; the last row of a candidate_id counts."""
    newest = decisions.groupBy("candidate_id").agg(F.max_by(F.struct(*decisions.columns), "decided").alias("d")).select("d.*")
    due = newest.where(F.unix_seconds("decided") + horizon_s <= F.unix_seconds(now))
    return due.join(paths.select("candidate_id").distinct(), "candidate_id", "left_anti")


def gate_blindness(paths: DataFrame, threshold: float = 2.0) -> DataFrame:
    """gate, n, resolved, hits, hit_rate, mean_mfe: whether what a gate filtered would have paid; paths with `gate`, over those with bars."""
    side = F.col(f"side_{_name(threshold)}")
    out = paths.where("bars > 0").groupBy("gate").agg(F.count("*").alias("n"), F.count(side).alias("resolved"), F.count_if(side == 1).alias("hits"), F.avg("mfe_atr").alias("mean_mfe"))
    return out.withColumn("hit_rate", F.try_divide("hits", "resolved"))
