"""Exact top-k inner product by an impact-ordered, score-at-a-time index.

Components are integers floor(256 x). An index block keeps, for each dimension,
the postings of its rows in descending value, cut into segments; the segment's
largest value is its impact. A query takes segments in descending order of what
they can add (for a negative weight from the other end). Each posting adds its
part above the dimension's least possible part, so partial sums only rise, and
the parts still open bound what a row can gain. Processing stops only where this
bound proves that few rows can still be members (or no segment is left); the
possible members are scored exactly. Ties go to the smaller id.

Rows are dealt to blocks by hash, once; the queries, a small part of the rows, go
to each block as rows too. A task reads a block's rows, indexes them, and then
takes the block's queries as they stream past, so it holds one index and one
batch, and the driver holds two numbers.

Rows of null id or of a vector that is null, empty or holds null or non-finite
components take no part. Vectors of different lengths are not compared. Rows of
the query's id are not its candidates. Rows equal in id and vector count once, as
query and as candidate; different vectors under one id are candidates each, and
queries each, with a ranking of their own under that id. Without queries or
candidates the result is empty. Sums are exact whatever the components: in double
precision up to EXACT, in 64 bits up to WHOLE, in numbers of any size beyond. A
score that a long doesn't hold is shown as the nearest long; its rank is that of
the exact sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import dealt, finite, matrix

SCALE = 256
#: Blocks are of so many rows until there are BLOCKS of them, then larger, up to so many components (unless one row has more).
ROW_BLOCK, BLOCKS, BLOCK_COMPONENTS = 8192, 24, 2**22
#: Segments per dimension, segments between two tests of the bound, and the possible members at which it stops: so many or this part of the rows.
SEGMENTS, STEP, FEW, PART = 8, 32, 512, 16
#: Sums below it are exact in double precision; beyond it all rows are scored. Below WHOLE they are exact in 64 bits.
EXACT, WHOLE = 2**52, 2.0**62
#: What orders sums beyond a long: the sum plus this, as so many bytes. Components of 4 bytes give sums far below it.
SHIFT, WIDE = 2**400, 51


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, embedding of the vectors that take part."""
    return vectors.where(F.col("vec_id").isNotNull() & finite()).select("vec_id", F.size("embedding").alias("dims"), "embedding")


def whole_products(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact inner products of integer components given as doubles: 64-bit numbers, or Python's where they may not do."""
    wide = np.abs(values).max(axis=1, initial=0) * np.abs(weights).sum() >= WHOLE
    if not wide.any():
        return values.astype(np.int64) @ weights.astype(np.int64)
    out = np.empty(len(values), dtype=object)
    # Where the product is narrow but the weights are not, the row is all zeros.
    out[~wide] = [int(x) for x in (values[~wide].astype(np.int64) @ weights.astype(np.int64) if np.abs(weights).max() < WHOLE else np.zeros((~wide).sum()))]
    w = [int(x) for x in weights]
    out[wide] = [sum(int(x) * y for x, y in zip(row, w, strict=True)) for row in values[wide]]
    return out


def quantised(column: pa.Array) -> np.ndarray:
    """The integer components as doubles (a double times 256 is exact)."""
    return np.floor(matrix(column) * SCALE)


class ImpactIndex:
    def __init__(self, ids: np.ndarray, values: np.ndarray, postings: np.ndarray):
        # A dimension's postings lie side by side in memory.
        self.ids, self.values, self.postings = ids, values.astype(np.float64), np.ascontiguousarray(postings, dtype=np.int64)
        ordered = np.ascontiguousarray(np.take_along_axis(self.values.T, self.postings, axis=1))
        self.cuts = np.unique(np.linspace(0, len(ids), SEGMENTS + 1).astype(np.int64))
        self.heads, self.lows = ordered[:, self.cuts[:-1]], ordered[:, self.cuts[1:] - 1]
        self.largest = np.abs(ordered).max()
        # What a posting adds above the dimension's least part, for a weight of 1 and for one of -1.
        self.above, self.below = ordered - ordered[:, -1:], ordered[:, :1] - ordered
        # Filled anew by each step: fresh arrays of this size cost more than the sums.
        self.rows, self.parts = (np.empty(STEP * int(np.diff(self.cuts).max()), kind) for kind in (np.int64, np.float64))
        self.processed = 0

    def search(self, query_id: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first."""
        n, weights = len(self.ids), weights.astype(np.float64)
        used = np.flatnonzero(weights)
        w = weights[used]
        own = slice(np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right"))
        members, small = None, np.abs(w).sum() * self.largest < EXACT
        if n > k and len(used) and small:
            # Parts of each dimension in the order its segments are taken, highest first.
            down = w > 0
            heads, lows = self.heads[used], self.lows[used]
            least = np.where(down, w * lows[:, -1], w * heads[:, 0])
            impact = np.where(down[:, None], w[:, None] * heads, (w[:, None] * lows)[:, ::-1]) - least[:, None]
            members = self._possible(weights, k, used, w, least, impact, own)
        if members is None:
            members = np.arange(n)
        members = members[(members < own.start) | (members >= own.stop)]
        exact = self.values[members] @ weights if small else whole_products(self.values[members], weights)
        # Ids rise with the place, so a stable sort breaks ties by the smaller id.
        best = np.argsort(-exact, kind="stable")[:k]
        return [(int(exact[i]), int(self.ids[members[i]])) for i in best]

    def _possible(self, weights, k, used, w, least, impact, own) -> np.ndarray:
        """Rows that can be among the k best: what the open parts can still add is the bound of the others."""
        n, segments, base = len(self.ids), impact.shape[1], least.sum()
        order = np.argsort(-impact, axis=None, kind="stable")
        dims, places = np.divmod(order, segments)
        places_down = np.where(w[dims] > 0, places, segments - 1 - places)
        taken = list(zip(dims.tolist(), used[dims].tolist(), w[dims].tolist(), self.cuts[places_down].tolist(), self.cuts[places_down + 1].tolist(), strict=True))
        after = np.concatenate([impact[:, 1:], np.zeros((len(used), 1))], axis=1)[dims, places]
        sums, open_at, members = np.zeros(n), impact[:, 0].copy(), np.arange(n)
        few = max(FEW, n // PART)
        for at in range(0, len(order), STEP):
            end = 0
            for d, dim, weight, a, b in taken[at : at + STEP]:
                begin, end = end, end + b - a
                self.rows[begin:end] = self.postings[dim, a:b]
                np.multiply((self.above if weight > 0 else self.below)[dim, a:b], abs(weight), out=self.parts[begin:end])
            # A dimension's segments come in falling order, so its last one here leaves the least open.
            open_at[dims[at : at + STEP]] = after[at : at + STEP]
            sums += np.bincount(self.rows[:end], self.parts[:end], n)
            self.processed = at + STEP
            if 3 * at < len(order):
                continue  # a third of the parts proves nothing yet
            low = sums.copy()
            low[own] = -1
            best = np.argpartition(-low, k)[:k]
            best = best[low[best] >= 0]
            if len(best) == k:
                members = np.flatnonzero(low + (open_at.sum() + base) >= (self.values[best] @ weights).min())
                if len(members) <= few:
                    break
        return members


def _indexed(parts: list[tuple[np.ndarray, np.ndarray]]) -> ImpactIndex:
    ids, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    return ImpactIndex(ids, values, np.argsort(-values, axis=0, kind="stable").T)


def _searcher(k: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, index = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "rb", "asks")])
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, to in zip([0, *edges], [*edges, len(keys)], strict=True):
                if at == to:
                    continue
                if block != (block := tuple(keys[at, :2])):
                    parts, index = [], None
                ids, own, values = batch.column("vec_id")[at:to].to_numpy(), batch.column("own")[at:to].to_numpy(), quantised(batch.column("embedding")[at:to])
                if not keys[at, 2]:
                    parts.append((ids, values))
                    continue
                if parts:  # the rows of a block come before its queries
                    parts, index = [], _indexed(parts)
                out = []
                for q, o, w in zip(ids.tolist(), own.tolist(), values, strict=True) if index else ():
                    for s, i in index.search(q, w, k):
                        shown = min(max(s, -(2**63)), 2**63 - 1)
                        out.append((q, o, i, shown, None if s == shown else (s + SHIFT).to_bytes(WIDE, "big")))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["query_id", "own", "vec_id", "score", "beyond"])

    return run


def blocks(rows: int, components: int, tasks: int) -> int:
    """How many blocks: enough of them to share the work, but no more, since each gets all queries."""
    return max(1, math.ceil(components / BLOCK_COMPONENTS), min(math.ceil(rows / ROW_BLOCK), max(BLOCKS, 2 * tasks)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products. Inputs have vec_id and embedding."""
    asked, rows = usable(queries), usable(vectors)
    # Repeated rows count here, so that nothing is shuffled for it; they make blocks smaller.
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dims"), F.lit(0)).alias("components")).first()
    n = blocks(size["rows"], size["components"], rows.sparkSession.sparkContext.defaultParallelism)
    asked, rows = (df.dropDuplicates(["vec_id", "embedding"]).withColumn("own", F.xxhash64("embedding")) for df in (asked, rows))
    asked = asked.withColumns({"asks": F.lit(True), "rb": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    rows = dealt(rows, n, "rb", "vec_id", "embedding").withColumn("asks", F.lit(False))
    # More ranges than blocks, so that each block has a task of its own; by hash some tasks would get several.
    streams = rows.unionByName(asked).repartitionByRange(4 * n, "dims", "rb").sortWithinPartitions("dims", "rb", "asks")
    found = streams.mapInArrow(_searcher(k), "query_id long, own long, vec_id long, score long, beyond binary")
    # A sum beyond the longs has `beyond` too; above them it is larger than the largest long itself, below them smaller than the smallest.
    beyond = F.coalesce("beyond", F.lit(SHIFT.to_bytes(WIDE, "big")))
    w = W.partitionBy("query_id", "own").orderBy(F.desc("score"), beyond.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same for DuckDB.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.own, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
