"""Joins the method needs: as-of, positional, interval, band, semi and anti.

None compares all pairs. As-of joins cut time into chunks, so a hot symbol is
spread over tasks; interval and band joins meet on buckets and keep a residual
test; the rest are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.stats import correlation


def asof(left: DataFrame, right: DataFrame, value: str, by: str = "symbol", on: str = "ts", chunk_s: int = 86_400) -> DataFrame:
    """left with the last `value` of right at or before each row's time (NULL if there is none).

    Every row of left stays; one without key or time has NULL.

    Rows of both sides meet in (key, time chunk) windows. What a chunk inherits is
    the last value of the chunks before it, from a table of one row per chunk.
    """
    chunk = F.floor(F.unix_seconds(on) / chunk_s)
    r = right.where(F.col(value).isNotNull()).groupBy(by, on).agg(F.max(value).alias(value))
    extra = [c for c in left.columns if c not in (by, on)]
    rows = (
        left.select(by, on, F.struct(*[F.col(c) for c in extra]).alias("__row") if extra else F.lit(None).cast("struct<>").alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("__left"))
        .unionByName(r.select(by, on, value, F.lit(0).alias("__left")), allowMissingColumns=True)
        .withColumn("__chunk", chunk)
    )
    lasts = r.withColumn("__chunk", chunk).groupBy(by, "__chunk").agg(F.max_by(value, on).alias("__last"))
    chunks = rows.select(by, "__chunk").distinct().join(lasts, [by, "__chunk"], "left")
    before = W.partitionBy(by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    inherited = chunks.select(by, "__chunk", F.last("__last", ignorenulls=True).over(before).alias("__inherited"))
    inside = W.partitionBy(by, "__chunk").orderBy(on, "__left").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn(value, F.last(value, ignorenulls=True).over(inside)).where("__left = 1")
    # Rows without key or time meet no chunk, and nothing that a window of such rows has seen counts.
    met = seen.join(inherited, [by, "__chunk"], "left")
    found = F.when(F.col(by).isNotNull() & F.col(on).isNotNull(), F.coalesce(value, "__inherited"))
    return met.select(by, on, *[F.col("__row")[c].alias(c) for c in extra], found.alias(value))


def positional(left: DataFrame, right: DataFrame, by: str = "symbol", on: str = "ts", value: str = "value") -> DataFrame:
    """The last value to the last row, the one before to the one before, and so on."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(on)))
    return left.withColumn("__n", place).join(right.select(by, on, value).withColumn("__n", place).drop(on), [by, "__n"], "left").drop("__n")


def intervals(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, bucket_s: int = 86_400) -> DataFrame:
    """Points inside closed spans of the same key: both sides meet on time buckets, then the bounds are tested."""
    bucket = lambda c: F.floor(F.unix_seconds(c) / bucket_s)
    wide = spans.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("__bucket", bucket(at)).join(wide, [by, "__bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def near_band(left: DataFrame, right: DataFrame, by: str, price: str, tolerance: float) -> DataFrame:
    """left rows that have a right row of the same key within tolerance (a share of the right price), each as often as it is there.

    Each right price stands in all log-price buckets that its band reaches into; a left price looks in its own. Prices
    of 0 or less have no band on the right and are in no band on the left; the tolerance is below 1.
    """
    import math

    if not 0 <= tolerance < 1:
        raise ValueError("tolerance must be from 0 to below 1")
    width = max(math.log1p(tolerance), 1e-4)
    bucket = lambda x: F.floor(F.log(x) / width)
    p = F.col(price)
    reach = F.sequence(bucket(p * (1 - tolerance)) - 1, bucket(p * (1 + tolerance)) + 1)
    r = right.where(p > 0).select(F.col(by).alias("__by"), p.alias("__price"), F.explode(reach).alias("__bucket_r")).distinct()
    near = (F.col(by) == F.col("__by")) & (F.col("__bucket") == F.col("__bucket_r")) & (F.abs(p - F.col("__price")) <= tolerance * F.col("__price"))
    return left.withColumn("__bucket", F.when(p > 0, bucket(p))).join(r, near, "left_semi").drop("__bucket")


def not_archived(new: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(archive.select(*keys).distinct(), keys, "left_anti")


def attach_context(rows: DataFrame, context: DataFrame, by: str = "symbol") -> DataFrame:
    """Context columns by key; one context row per key, so rows don't fan out."""
    return rows.join(context.dropDuplicates([by]), by, "left")


def across_venues(planes: DataFrame, plane: str, now_ms: int, venues: list[str]) -> DataFrame:
    """symbol and one column per venue: its newest value of the plane, NULL if older than its bound."""
    fresh = F.when(F.lit(now_ms) - F.col("received_ms") <= F.col("bound_ms"), F.col("value"))
    newest = planes.where(F.col("plane") == plane).groupBy("symbol", "venue").agg(F.max_by(fresh, "received_ms").alias("value"))
    return newest.groupBy("symbol").pivot("venue", venues).agg(F.first("value"))


def return_alignment(bars: DataFrame, benchmark: str) -> DataFrame:
    """symbol, ts, ret, base: each symbol's returns beside those of the benchmark at the same time."""
    base = bars.where(F.col("symbol") == benchmark).select("ts", F.col("ret").alias("base"))
    return bars.where(F.col("symbol") != benchmark).select("symbol", "ts", "ret").join(base, "ts").where("ret IS NOT NULL AND base IS NOT NULL")


def corr_beta(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("symbol").agg(correlation(F.col("ret"), F.col("base")).alias("corr"), F.regr_slope("ret", "base").alias("beta"), F.count("*").alias("n"))


def nearest_level(rows: DataFrame, levels: Column, price: Column) -> Column:
    """Of an array of levels, the one nearest to price (the lower of two equally near)."""
    return F.array_sort(F.transform(levels, lambda x: F.struct(F.abs(x - price).alias("d"), x.alias("v"))))[0]["v"]
