"""Nearest neighbours by additive quantisation, with a bound on what the codes leave open.

A vector is coded as a sum of full-dimensional codewords, one from each of M
codebooks. Codebooks are fitted level by level to the residuals of a bounded
sample (FIT_ROWS rows of smallest id hash, k-means); every row is then encoded by
beam search over the codebooks and stored as M bytes with the norms of the
vector and of its approximation, and with the distance between the two. A query
makes a table of its products with all codewords; a row's score is M table
entries added and scaled by the stored norms.

The codes alone can't tell apart rows closer to one another than they are to
their approximations (tight clusters, rows unlike the sample, many dimensions).
So in a block the best SHORTLIST rows by score are scored on the original vectors
first; the k-th of these is a limit, and every other row whose score plus what
the stored distance allows (Cauchy-Schwarz) reaches it is scored too. No row that
belongs to the k nearest is left out, whatever the data; the fit only decides how
many rows are scored again.

Rows of null id or of a vector that is null, empty, zero or holds null or
non-finite components take no part. Vectors of different lengths are not compared;
each length has its own codebooks and its own part of the plan, so lengths should
be few. Rows of the query's id are not its candidates. Ties go to the smaller id,
in a block too, so copies of one vector rank as in an exact search. Rows
equal in id and vector count once; different vectors under one id are candidates
each, and queries each, with a ranking of their own under that id. Lists of
blocks are merged FAN at a time, so no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import blocked, finite, matrix, paired

FIT_ROWS = 16_384
BOOKS, WORDS, BEAM, ROUNDS = 32, 64, 4, 8
#: Rows of a query and block that set its limit; block sizes of the scan, and components a block of rows holds at most (unless one row has more).
SHORTLIST = 320
QUERY_BLOCK, ROW_BLOCK, BLOCK_COMPONENTS = 512, 16_384, 2**22
#: Lists of a query that are merged at once.
FAN = 64


def _nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1)[None, :] - 2 * x @ words.T, axis=1)


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """(books, words, dims): k-means on what the earlier books leave."""
    rng = np.random.default_rng(seed)
    rest, out = x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(ROUNDS):
            near = _nearest_words(rest, c)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            used = np.flatnonzero(n)
            c[used] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[used], axis=0) / n[used][:, None]
        near = _nearest_words(rest, c)
        rest -= c[near]
        out.append(c)
    return np.stack(out).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the approximations."""
    n, dims = x.shape
    rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    for c in books:
        cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ c.T + (c**2).sum(1)
        wide = cost.shape[2]
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = best // wide, best % wide
        rows = np.arange(n)[:, None]
        rest = rest[rows, parent] - c[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin((rest**2).sum(2), axis=1)
    rows = np.arange(n)
    codes = codes[rows, best]
    return codes, sum(c[codes[:, m]].astype(np.float64) for m, c in enumerate(books))


def _encoder(books: np.ndarray, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                x = matrix(batch.column("embedding"))
                codes, made = encode(x, books)
                ratio = (np.sqrt((x**2).sum(1)) / np.maximum(np.sqrt((made**2).sum(1)), 1e-30)).astype(np.float32)
                off = np.sqrt(((x - made * ratio[:, None]) ** 2).sum(1))
                binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("own"), binary(codes), pa.array(ratio.astype(np.float64)), pa.array(off), binary(x.astype(kind))], names=["vec_id", "own", "code", "ratio", "off", "vector"]
                )

    return run


def _longs(pdf: pd.DataFrame, column: str) -> list[bytes]:
    return [pdf[column].to_numpy(np.int64).tobytes()]


def _query_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lb": [key[0]], "query_ids": _longs(pdf, "vec_id"), "query_owns": _longs(pdf, "own"), "vectors": [np.stack(pdf["embedding"].to_list()).astype(np.float64).tobytes()]})


def _code_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "own"], kind="stable")
    return pd.DataFrame({
        "rb": [key[0]], "ids": _longs(pdf, "vec_id"), "owns": _longs(pdf, "own"), "codes": [b"".join(pdf["code"])],
        "ratios": [pdf["ratio"].to_numpy(np.float32).tobytes()], "offs": [pdf["off"].to_numpy(np.float64).tobytes()], "rows": [b"".join(pdf["vector"])],
    })


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, component by component, so that equal rows have equal scores wherever they stand."""
    wide = rows.astype(np.float64)
    out = wide[:, 0] * q[0]
    for d in range(1, len(q)):
        out += wide[:, d] * q[d]
    return out


def _best(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best scores (-inf: none): all over the limit's, then those at it in order of place."""
    if len(score) > most:
        limit = np.partition(score, len(score) - most)[len(score) - most]
        over = np.flatnonzero(score > limit)
        best = np.concatenate([over, np.flatnonzero(score == limit)[: most - len(over)]])
    else:
        best = np.arange(len(score))
    return best[score[best] > -np.inf]


#: The best rows of a query in a block, or in several.
LISTS = "query_id long, query_own long, rb int, ids array<long>, owns array<long>, scores array<double>"


def _scanner(books: np.ndarray, k: int, shortlist: int, kind: type):
    """For each pair of blocks: one row per query with its k best rows of the block."""
    n_books, words, dims = books.shape
    # Of a sum of single-precision products, at most, as a share of the norms that take part.
    rounding = (n_books + dims + 8) * 2.0**-23
    reached = np.sqrt((books.astype(np.float64) ** 2).sum(2)).max(1).sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, owns, ratios = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["owns"], np.int64), np.frombuffer(r["ratios"], np.float32)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, n_books)
                columns = [np.ascontiguousarray(codes[:, m]) for m in range(n_books)]
                rows = np.frombuffer(r["rows"], kind).reshape(-1, dims)
                # How much a product can exceed its score, for a query of length 1.
                slack = np.frombuffer(r["offs"], np.float64) * (1 + 1e-9) + rounding * reached * ratios.astype(np.float64)
                out: tuple[list, list, list] = ([], [], [])
                asked = np.frombuffer(r["query_ids"], np.int64)
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(-1, dims)
                tables = np.einsum("qd,mwd->qmw", vectors.astype(np.float32), books, optimize=True).astype(np.float32)
                for q, x, t in zip(asked.tolist(), vectors, tables, strict=True):
                    score = t[0][columns[0]]
                    for m in range(1, n_books):
                        score += t[m][columns[m]]
                    score *= ratios
                    mine = slice(np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right"))
                    score[mine] = -np.inf
                    first = _best(score, max(shortlist, k))
                    exact = np.full(len(ids), -np.inf)
                    if len(first):
                        exact[first] = _products(rows[first], x)
                    limit = np.sort(exact[first])[-k] if len(first) >= k else -np.inf
                    # What is not surely below the limit, figures that are not numbers included.
                    more = ~(score.astype(np.float64) + np.sqrt((x**2).sum()) * slack < limit)
                    more[first], more[mine] = False, False
                    rest = np.flatnonzero(more)
                    if len(rest):
                        exact[rest] = _products(rows[rest], x)
                    best = _best(exact, k)
                    out[0].append(ids[best])
                    out[1].append(owns[best])
                    out[2].append(exact[best])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), pa.array(np.frombuffer(r["query_owns"], np.int64)), pa.array(np.full(len(asked), r["rb"], np.int32)), pa.array(out[0], longs), pa.array(out[1], longs), pa.array(out[2], pa.list_(pa.float64()))],
                    names=["query_id", "query_own", "rb", "ids", "owns", "scores"],
                )

    return run


def _merger(most: int):
    """One list of a query's lists."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, owns, scores = (np.concatenate(pdf[c].to_list()) for c in ("ids", "owns", "scores"))
        best = np.lexsort((owns, ids, -scores))[:most]
        return pd.DataFrame({"query_id": [key[0]], "query_own": [key[1]], "rb": [key[2]], "ids": [ids[best]], "owns": [owns[best]], "scores": [scores[best]]})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, shortlist: int = SHORTLIST, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product. Inputs have vec_id and embedding."""
    zero = ~F.exists("embedding", lambda x: x != 0)
    usable = lambda df: df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite() & ~zero).dropDuplicates(["vec_id", "embedding"]).withColumn("own", F.xxhash64("embedding"))
    rows, asked = usable(vectors), usable(queries)
    lengths = [r[0] for r in rows.select(F.size("embedding").alias("dims")).distinct().orderBy("dims").collect()]
    found = [_nearest(asked.where(F.size("embedding") == d), rows.where(F.size("embedding") == d), d, k, shortlist, fit_rows) for d in lengths or [1]]
    return reduce(DataFrame.unionAll, found)


def _nearest(asked: DataFrame, rows: DataFrame, dims: int, k: int, shortlist: int, fit_rows: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "own").limit(fit_rows).select("embedding").toArrow().column(0).combine_chunks()
    x = matrix(sample if isinstance(sample, pa.Array) else sample.chunk(0)) if len(sample) else np.zeros((1, dims))
    books = fit_codebooks(x)
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    coded = rows.mapInArrow(_encoder(books, kind), "vec_id long, own long, code binary, ratio double, off double, vector binary")
    size = max(1, min(ROW_BLOCK, BLOCK_COMPONENTS // dims))
    (left, _), (right, n_right) = blocked(asked, asked.count(), QUERY_BLOCK, "lb", "vec_id", "own"), blocked(coded, rows.count(), size, "rb", "vec_id", "own")
    left = left.groupBy("lb").applyInPandas(_query_block, "lb int, query_ids binary, query_owns binary, vectors binary")
    right = right.groupBy("rb").applyInPandas(_code_block, "rb int, ids binary, owns binary, codes binary, ratios binary, offs binary, rows binary")
    pairs = paired(left, right, n_right).select("rb", "query_ids", "query_owns", "vectors", "ids", "owns", "codes", "ratios", "offs", "rows")
    lists = pairs.mapInArrow(_scanner(books, k, shortlist, kind), LISTS)
    while n_right > 1:
        n_right = -(-n_right // FAN)
        lists = lists.withColumn("rb", F.expr(f"cast(rb div {FAN} as int)")).groupBy("query_id", "query_own", "rb").applyInPandas(_merger(k), LISTS)
    short = lists.select("query_id", "query_own", F.explode(F.arrays_zip("ids", "owns")).alias("c")).select("query_id", "query_own", F.col("c.ids").alias("vec_id"), F.col("c.owns").alias("own"))
    product = F.aggregate(F.zip_with("a", "b", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    exact = (
        short.join(rows.withColumnRenamed("embedding", "b"), ["vec_id", "own"])
        .join(asked.select(F.col("vec_id").alias("query_id"), F.col("own").alias("query_own"), F.col("embedding").alias("a")), ["query_id", "query_own"])
        .select("query_id", "query_own", "vec_id", product.alias("score"))
    )
    w = W.partitionBy("query_id", "query_own").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
