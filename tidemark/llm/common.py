"""Helpers shared by the training-data operators.

Text reaches Python in Arrow batches. A batch is worked on in slices of a few
megabytes, so memory per task does not follow the batch or partition size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once (a longer document goes alone).
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


#: Rows of an Arrow batch where nothing says otherwise: texts are long, and a batch is held in whole on both sides.
BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For applications (the registered queries, the pipeline): Arrow batches of BATCH_ROWS, unless the session or its start says otherwise."""
    if spark.sparkContext.getConf().get(_ARROW_ROWS) is None and spark.conf.get(_ARROW_ROWS) == "10000":  # Spark's own default
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set a local session (as in tests) gets a folder; on a cluster that is an error."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
        import tempfile

        at = tempfile.mkdtemp(prefix="tidemark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder. The shuffle files behind it have no other reader, so Spark deletes them at the end of the job.

    In an iterative job they would pile up on the executors' disks. The setting holds while this one job runs.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch whose text has about `most` bytes together."""
    offsets = text_offsets(batch.column(column))
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(batch))
        yield batch.slice(at, to - at)
        at = to


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """At the end of a partition, gives what the worker no longer uses back to the system: workers live on between tasks."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return through


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, and where each begins (nulls are empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = text_offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of many documents at once: byte ranges, and the first word of each document."""

    def __init__(self, texts: pa.Array):
        self.raw, self.doc_at = text_bytes(texts)
        n = len(self.raw)
        solid = ~_SPACE[self.raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.doc_at] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.doc_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        n = len(self.raw)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.raw] * _power(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _power(_BASE_INVERSE, n + 1)[self.start])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; the last k-1 entries of `words` have none."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _power(_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * _power(_BASE_INVERSE, n)[: n - k + 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start and length, after one another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that a bit filter (64-bit words, two bits a value, a power of two in all) lets through."""
    bits = np.uint64(len(table).bit_length() + 5)
    low = (np.uint64(1) << bits) - np.uint64(1)
    hit = np.arange(len(hashes))
    for x in (hashes & low, (hashes >> bits) & low):
        x = x[hit]
        hit = hit[(table[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1]
    return hit
