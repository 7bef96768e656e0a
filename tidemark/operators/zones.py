"""Clusters of prices and accumulation zones.

A cluster is a fold along sorted prices: a task has its keys' prices in order and
passes through them once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clusters(points: DataFrame, keys: list[str], tolerance: float, by: str = "mean") -> DataFrame:
    """keys, lo, hi, mean, anchor, n, weight of each cluster. points: keys, price, weight (and count, if given).

    A price joins the cluster below it while it is within tolerance (a share) of its mean, or of its first price
    (by="anchor"). Equal prices are summed before they meet. A task walks once through its keys' prices in order and
    holds the cluster at hand, so neither a dense line of prices nor many small clusters take memory.
    """
    count = F.sum("count") if "count" in points.columns else F.count("*")
    merged = points.where("price IS NOT NULL").groupBy(*keys, F.col("price").cast("double").alias("price")).agg(F.sum("weight").cast("double").alias("weight"), count.cast("long").alias("count"))
    names = [*keys, "lo", "hi", "mean", "anchor", "n", "weight"]
    kinds = [points.schema[k].dataType for k in keys]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, types = None, None
        for batch in batches:
            types = types or [batch.schema.field(k).type for k in keys] + [pa.float64()] * 4 + [pa.int64(), pa.float64()]
            out = []
            lists = [batch.column(c).to_pylist() for c in (*keys, "price", "weight", "count")]
            for key, price, w, c in zip(zip(*lists[:-3], strict=True), *lists[-3:], strict=True):
                if at is None or key != at or price > (total / n if by == "mean" else first) * (1 + tolerance) or price != price:
                    if at is not None:
                        out.append((*at, first, last, total / n, first, n, weight))
                    at, first, total, n, weight = key, price, 0.0, 0, None
                total, n, last = total + price * c, n + c, price
                weight = w if weight is None else weight if w is None else weight + w
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, first, last, total / n, first, n, weight), types, strict=True)], names=names)

    schema = "".join(f"`{k}` {t.simpleString()}, " for k, t in zip(keys, kinds, strict=True)) + "lo double, hi double, mean double, anchor double, n long, weight double"
    return merged.repartition(*keys).sortWithinPartitions(*keys, "price").mapInArrow(fold, schema)


def apart_by_rank(boxes: DataFrame, most: int, *order) -> DataFrame:
    """Of each symbol's boxes (lo, hi, ...) up to `most` that don't overlap, taken in an order (columns, best last)."""
    rest, taken = boxes, None
    for _ in range(most):
        best = rest.groupBy("symbol").agg(F.max_by(F.struct(*boxes.columns), F.struct(*order)).alias("b")).select("b.*")
        taken = best if taken is None else taken.unionAll(best)
        edge = best.select("symbol", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        rest = rest.join(edge, "symbol").where("hi < __lo OR lo > __hi").select(*boxes.columns)
    return taken


def accumulation_zones(swings: DataFrame, tolerance: float = 0.006, width: float = 0.12, least: int = 4, most: int = 5) -> DataFrame:
    """symbol, lo, hi, touches, volume: boxes between a cluster of pivot lows and one of pivot highs above it.

    At least `least` pivots touch a box of at most `width`; boxes are taken by volume, narrower first of equals, and
    must not overlap. Clusters meet on log-price buckets of the width.
    """
    import math

    side = lambda flag, price: swings.where(flag).select("symbol", F.col(price).alias("price"), F.col("volume").alias("weight"))
    low, high = clusters(side("pl", "low"), ["symbol"], tolerance), clusters(side("ph", "high"), ["symbol"], tolerance)
    step = F.lit(math.log1p(width))
    low = low.where("lo > 0").select("symbol", "lo", F.col("n").alias("n1"), F.col("weight").alias("v1"), F.floor(F.log("lo") / step).alias("bucket"))
    at = F.floor(F.log("hi") / step)
    high = high.where("hi > 0").select("symbol", "hi", F.col("n").alias("n2"), F.col("weight").alias("v2"), F.explode(F.array(at - 1, at)).alias("bucket"))
    boxes = low.join(high, ["symbol", "bucket"]).where((F.col("hi") > F.col("lo")) & (F.col("hi") / F.col("lo") - 1 <= width) & (F.col("n1") + F.col("n2") >= least))
    boxes = boxes.select("symbol", "lo", "hi", (F.col("n1") + F.col("n2")).alias("touches"), (F.col("v1") + F.col("v2")).alias("volume"))
    return apart_by_rank(boxes, most, F.col("volume"), F.col("lo") - F.col("hi"), -F.col("lo"), -F.col("hi"))
