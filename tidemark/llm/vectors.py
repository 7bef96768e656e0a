"""Vectors in blocks, shared by the two searches.

Searches compare a stated query set with all rows. Rows are dealt to blocks by
hash. An index block is shuffled once; the queries, a small part of the rows, are
sent to each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str = "embedding") -> Column:
    """Not null, not empty, and all components are finite numbers."""
    c = F.col(vector)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(F.forall(c, lambda x: F.coalesce(ok(x), F.lit(False))), F.lit(False))


def dealt(vectors: DataFrame, n: int, name: str, *by: str) -> DataFrame:
    """Adds the block number `name`, one of n, by hash of the columns `by`."""
    return vectors.withColumn(name, F.pmod(F.xxhash64(*by, F.lit(name)), F.lit(n)).cast("int"))


def blocked(vectors: DataFrame, rows: int, size: int, name: str, *by: str) -> tuple[DataFrame, int]:
    """Adds the block number `name`, by hash of the columns `by`; of the `rows` rows about `size` fall in each. Also the number of blocks."""
    n = max(1, math.ceil(rows / size))
    return dealt(vectors, n, name, *by), n


def paired(left: DataFrame, right: DataFrame, n_right: int) -> DataFrame:
    """One row for each pair of a query block and an index block `rb`. Inputs have one row per block.

    The query blocks are repeated before the join; from the size of their rows Spark takes them for small and would broadcast all of that.
    """
    return left.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).join(right.hint("merge"), "rb")


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1)
