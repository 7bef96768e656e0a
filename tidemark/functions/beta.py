"""The Beta distribution as column expressions: log gamma, regularised incomplete beta, quantiles.

Higher-order functions of fixed length stand for the loops, so the expressions
stay in the JVM and a row costs the same whatever its parameters are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a quantile: Newton's, or a halving where that would leave the interval.
STEPS = 16


def log_gamma(x: Column) -> Column:
    """ln of gamma(x) for x above 0: Stirling's series eight further on, less the factors between."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    factors = x
    for i in range(1, 8):
        factors = factors * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(factors)


def _one(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The share of Beta(a, b) up to x; the parameters are above 0.

    Its series has only positive terms, each the last one times (a + b + n) x / (a + 1 + n). The half of x below 1/2 is
    summed, so the factor falls to 1/2 soon after it has passed 1; the length follows from where that is.
    """
    far = x > 0.5
    given = F.struct(F.when(far, b).otherwise(a).alias("p"), F.when(far, a).otherwise(b).alias("q"), F.when(far, 1 - x).otherwise(x).alias("x"), far.alias("far"))

    def side(g: Column) -> Column:
        both = g["p"] + g["q"]
        length = (80 + 12 * F.sqrt(both) + F.greatest(F.lit(0.0), (both * g["x"] - g["p"]) / (1 - g["x"]))).cast("int")
        start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
        step = lambda z, n: _one(z["t"] * (both + n) * g["x"] / (g["p"] + 1 + n), lambda t: F.struct(t.alias("t"), (z["s"] + t).alias("s")))
        total = F.aggregate(F.sequence(F.lit(0), length), start, step, lambda z: z["s"])
        share = F.exp(g["p"] * F.log(g["x"]) + g["q"] * F.log(1 - g["x"]) + log_gamma(both) - log_gamma(g["p"]) - log_gamma(g["q"])) / g["p"] * total
        return F.when(g["far"], 1 - share).otherwise(share)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_one(given, side))


def beta_quantile(share: float, a: Column, b: Column) -> Column:
    """x with incomplete_beta(x, a, b) = share; NULL where a parameter is not above 0."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), (a / (a + b)).alias("x"))

    def step(s: Column, _: Column) -> Column:
        def moved(over: Column) -> Column:
            lo, hi = F.when(over < 0, s["x"]).otherwise(s["lo"]), F.when(over < 0, s["hi"]).otherwise(s["x"])
            density = F.exp((a - 1) * F.log(s["x"]) + (b - 1) * F.log(1 - s["x"]) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
            return _one(F.struct(lo.alias("lo"), hi.alias("hi"), F.try_divide(-over, density).alias("by")), lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), F.when((s["x"] + r["by"] >= r["lo"]) & (s["x"] + r["by"] <= r["hi"]), s["x"] + r["by"]).otherwise((r["lo"] + r["hi"]) / 2).alias("x")))

        return _one(incomplete_beta(s["x"], a, b) - share, moved)

    return F.when((a > 0) & (b > 0), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["x"]))
