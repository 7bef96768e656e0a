"""Paths of decisions while both decisions and bars arrive: an interval join with watermarks on both sides.

Spark keeps a decision as join state until the watermark of the bars has passed
its horizon, and a bar until no decision can ask for it; what comes later than
its watermark is dropped. A decision is told once, when its interval is over,
also if no bar came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.decisions import DECISION, HORIZON_S, path_aggregates, path_columns


def decision_paths(decisions: DataFrame, bars: DataFrame, horizon_s: int = HORIZON_S, decisions_late: str = "10 minutes", bars_late: str = "10 minutes") -> DataFrame:
    """The rows of `operators.decisions.forward_paths` of streams, each when it can no longer change.

    decisions: candidate_id, symbol, decided, direction, entry, atr, each candidate_id once; bars: symbol, ts, high, low, close.
    """
    d = decisions.select(*DECISION).withWatermark("decided", decisions_late)
    b = bars.select(F.col("symbol").alias("__symbol"), "ts", "high", "low", "close").withWatermark("ts", bars_late)
    near = (F.col("symbol") == F.col("__symbol")) & (F.col("ts") >= F.col("decided")) & (F.col("ts") <= F.col("decided") + F.expr(f"INTERVAL {horizon_s} SECONDS"))
    met = d.join(b, near, "left_outer")
    return path_columns(met.groupBy(*DECISION).agg(*[x.alias(c) for c, x in path_aggregates().items()]), *DECISION)
