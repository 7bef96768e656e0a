"""Robust and descriptive statistics by key, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, ratio


def cumulated(rows: DataFrame, key: str, value: str, *sums: Column, parts: int = 64) -> DataFrame:
    """key, value, n, the sums, below (rows of smaller values) and total: one row for each different value, ranked without one task per key.

    Rows are counted by value first; a key's values are then cut at sketched quantiles into parts that are cumulated
    side by side, each from the total of the parts before it. NULL values don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), *sums)
    cuts = counts.groupBy(key).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("__cuts"), F.sum("n").alias("total"))
    placed = counts.join(cuts, key).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    before = placed.groupBy(key, "__part").agg(F.sum("n").alias("__n"))
    before = before.select(key, "__part", F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.sum("n").over(W.partitionBy(key, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("__to", inside).join(before, [key, "__part"]).withColumn("below", F.col("__base") + F.col("__to") - F.col("n")).drop("__part", "__base", "__to")


def trailing_sums(rows: DataFrame, keys: list[str], at: str, span: int, value: Column) -> DataFrame:
    """keys, at, total: for each place `at` (whole numbers) of a key, the sum of `value` over the places in (at - span, at].

    Values are summed by place first. A sum enters at its place and leaves `span` later, so a running sum within
    stretches of one span is enough: it begins with the stretch before, whose sums all leave in this one. No frame
    slides over rows, so the work doesn't grow with the rows in a span. Rows without a place don't count.
    """
    sums = rows.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__in"))
    enter = sums.select(*keys, at, F.col("__in").alias("__move"), F.lit(0).cast("long").alias("__leave"))
    leave = sums.select(*keys, (F.col(at) + span).alias(at), (-F.col("__in")).alias("__move"), F.col("__in").alias("__leave"))
    moves = enter.withColumn("__own", F.lit(True)).unionAll(leave.withColumn("__own", F.lit(False)))
    stretch = W.partitionBy(*keys, F.col(at) - F.pmod(F.col(at), F.lit(span)))
    total = F.sum("__leave").over(stretch) + F.sum("__move").over(stretch.orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    return moves.withColumn("total", total).where("__own").select(*keys, at, "total")


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and one column per share: exact quantiles, between neighbouring values by distance."""
    c = cumulated(rows, key, value)
    out = []
    for name, p in shares.items():
        at = p * (F.col("total") - 1)
        covers = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
        v = F.col(value).cast("double")
        low, high = F.max(F.when(covers(F.floor(at)), v)), F.max(F.when(covers(F.ceil(at)), v))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return c.groupBy(key).agg(*out)


def robust_z(rows: DataFrame, key: str, value: str, order: str, least: int = 30, bound: float = 12.0) -> DataFrame:
    """The last value's distance from the median in scaled median absolute deviations (else population sigma)."""
    summary = rows.groupBy(key).agg(F.max_by(value, order).alias("last"), F.count(value).alias("n"), F.stddev_pop(value).alias("sigma"))
    middle = summary.join(quantiles(rows, key, value, {"median": 0.5}), key)
    spread = quantiles(rows.join(middle.select(key, "median"), key).withColumn("__d", F.abs(F.col(value) - F.col("median"))), key, "__d", {"mad": 0.5})
    scale = F.when(F.col("mad") > 1e-12, F.col("mad") * 1.4826 * F.col("n") / (F.col("n") - 0.8)).otherwise(F.col("sigma"))
    z = F.when((F.col("n") >= least) & (scale > 0), clip((F.col("last") - F.col("median")) / scale, -bound, bound))
    return middle.join(spread, key).select(key, z.alias("z"), "n")


def moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    n = F.col("n").cast("double")
    base = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return base.select(key, "n", skew.alias("skew"), kurt.alias("kurt"))


def entropy(rows: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """Shannon entropy (natural log) of values in bins of a width."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(W.partitionBy(key))
    return counts.withColumn("p", share).groupBy(key).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.count("*").alias("bins"))


def two_sample(rows: DataFrame, key: str, value: str, late: str, alpha: float = 0.05) -> DataFrame:
    """Largest distance between the distributions of rows with and without the flag `late`, and its critical value."""
    import math

    w = W.partitionBy(key).orderBy(value)
    a, b = F.col(late).cast("int"), (~F.col(late)).cast("int")
    whole = W.partitionBy(key)
    # Frames by value (RANGE), so equal values count together.
    far = F.abs(F.sum(a).over(w) / F.sum(a).over(whole) - F.sum(b).over(w) / F.sum(b).over(whole))
    out = rows.withColumn("d", far).groupBy(key).agg(F.max("d").alias("ks"), F.sum(a).alias("n1"), F.sum(b).alias("n2"))
    critical = math.sqrt(-math.log(alpha / 2) / 2) * F.sqrt((F.col("n1") + F.col("n2")) / (F.col("n1") * F.col("n2")))
    return out.withColumn("critical", critical).withColumn("broken", F.col("ks") > F.col("critical"))


def correlation(a: Column, b: Column) -> Column:
    """The aggregate corr over the rows that have both, NULL (not an error) where one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """a, b, n (rows that have both), r per key for all pairs of columns, in one aggregate; NULL where a column does not vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    figures = [x for i, (a, b) in enumerate(pairs) for x in (F.count_if(both(a, b)).alias(f"__n{i}"), correlation(F.col(a), F.col(b)).alias(f"__r{i}"))]
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__n{i}").alias("n"), F.col(f"__r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return rows.groupBy(key).agg(*figures).select(key, F.inline(listed))


#: Ranks of up to so many different values of a column are sent to the rows; beyond, both meet by a shuffle.
BROADCAST_VALUES = 100_000


def spearman(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """a, b, rho per key for all pairs of columns: correlation of average ranks (of the rows where the column is not NULL).

    The different values of each column are counted (about) first: rows travel only for columns of many values.
    """
    ranked = rows.select(key, *columns)
    many = rows.agg(*[F.approx_count_distinct(F.struct(key, c)).alias(f"__{i}") for i, c in enumerate(columns)]).first()
    few = {c: many[i] <= BROADCAST_VALUES for i, c in enumerate(columns)}
    for c in sorted(columns, key=lambda c: not few[c]):
        met = cumulated(rows, key, c).select(F.col(key).alias("__k"), F.col(c).alias("__v"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"__r_{c}"))
        ranked = ranked.join(F.broadcast(met) if few[c] else met, (F.col(key) == F.col("__k")) & (F.col(c) == F.col("__v")), "left").drop("__k", "__v", c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = ranked.groupBy(key).agg(*[correlation(F.col(f"__r_{a}"), F.col(f"__r_{b}")).alias(f"{a}|{b}") for a, b in pairs])
    long = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho")) for a, b in pairs])
    return wide.select(key, F.explode(long).alias("p")).select(key, "p.*")


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share."""
    p = ratio(wins, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def auc(rows: DataFrame, key: str, score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half, by average ranks."""
    c = cumulated(rows, key, score, F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    out = c.groupBy(key).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("s"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return out.select(key, ratio(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1").cast("double") * F.col("n0")).alias("auc"), "n1", "n0")


def regime(tickers: DataFrame, least_volume: float = 1e7, least: int = 20) -> DataFrame:
    """One row over the liquid cross-section: absolute changes, ranges, volumes, breadth and the regime; NULL below `least` names.

    Input columns: quote_volume, change_pct, high, low.
    """
    # The regimes' cuts and the gates that follow from them.
    liquid = tickers.where(F.col("quote_volume") >= least_volume).select(
        F.lit(1).alias("__all"), F.abs("change_pct").alias("change"), F.col("change_pct") > 0, "quote_volume", F.when((F.col("low") > 0) & (F.col("high") > F.col("low")), (F.col("high") / F.col("low") - 1) * 100).alias("range")
    ).toDF("__all", "change", "rose", "quote_volume", "range")
    base = liquid.groupBy("__all").agg(F.count("*").alias("n"), (100 * F.avg((F.col("change") >= 8).cast("double"))).alias("hot"), (100 * F.avg(F.col("rose").cast("double"))).alias("breadth"))
    for column, shares in (("change", {"median": 0.5, "p75": 0.75, "p90": 0.9}), ("range", {"median_range": 0.5, "p75_range": 0.75}), ("quote_volume", {"p40_volume": 0.4})):
        base = base.join(quantiles(liquid, "__all", column, shares), "__all", "left")
    label = F.when((F.col("median") < 2.5) & (F.col("hot") < 8), "quiet").when((F.col("p90") > 15) | (F.col("hot") > 30), "extreme").when((F.col("median") > 5) | (F.col("hot") > 15), "hot").otherwise("normal")
    gates = {
        "regime": label,
        "anomaly_change": clip(F.round(F.col("p75") * 0.85, 1), 4, 22),
        "anomaly_range": clip(F.round(F.greatest(F.col("median_range") * 1.6, F.col("p75_range") * 0.9), 1), 6, 28),
        "ignition": clip(F.round(F.col("median") * 0.55, 2), 1, 4.5),
        "ignition_volume": clip("p40_volume", 2_500_000, 40_000_000),
    }
    enough = F.col("n") >= least
    return base.select("n", *[F.when(enough, F.col(c)).alias(c) for c in ("median", "p75", "p90", "median_range", "p75_range", "hot", "breadth", "p40_volume")], *[F.when(enough, v).alias(k) for k, v in gates.items()])


def cosine(a: str, b: str) -> Column:
    """Of two array columns, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def bootstrap_interval(rows: DataFrame, key: str, value: str, resamples: int = 20_000, seed: int = 1) -> DataFrame:
    """key, mean, lo, hi (95 %) by Poisson bootstrap over `resamples` resamples.

    A resample weighs each row by a Poisson(1) count. The counts of n equal rows add up to a Poisson(n) count, so rows
    are counted by value first and each different value draws once a resample: the work grows with the values, not
    with the rows. Values are dealt to tasks; a task keeps one weighted sum and one weight for each resample of the key
    at hand, and a sum over tasks combines them. A value's draws follow from the seed, the value and its count, so the
    result doesn't depend on the partitioning.
    """
    import numpy as np
    import pandas as pd

    def drawn(batches):
        key, total = None, None

        def listed():
            return pd.DataFrame({"__key": [key] * resamples, "b": np.arange(resamples), "s": total[0], "w": total[1]})

        for pdf in batches:
            for k, v, n, h in zip(pdf["__key"], pdf["__value"], pdf["__n"], pdf["__hash"], strict=True):
                if total is None or k != key:
                    if total is not None:
                        yield listed()
                    key, total = k, np.zeros((2, resamples))
                w = np.random.Generator(np.random.SFC64([seed, h & (2**64 - 1)])).poisson(float(n), resamples)
                total[0] += v * w
                total[1] += w
        if total is not None:
            yield listed()

    kind = rows.schema[key].dataType.simpleString()
    given = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(value).cast("double").alias("__value"))
    counts = given.groupBy("__key", "__value").agg(F.count("*").alias("__n"))
    # A set number of partitions: a few bytes of values are much work, which must not be put together.
    dealt = counts.withColumn("__hash", F.xxhash64("__key", "__value")).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "__key", "__value").sortWithinPartitions("__key", "__value")
    parts = dealt.mapInPandas(drawn, f"__key {kind}, b int, s double, w double")
    means = parts.groupBy("__key", "b").agg(ratio(F.sum("s"), F.sum("w")).alias("m"))
    interval = means.groupBy("__key").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi")).withColumnRenamed("__key", key)
    return rows.groupBy(key).agg(F.avg(value).alias("mean")).join(interval, key)
