"""Exact removal of repeated passages by a De Bruijn graph of words.

The edges of the graph are the k-mers (windows) of k words, its nodes the k-1
words at either end. Edges that start in more than one document are kept, with
their first place. In- and out-degrees of the nodes are counted, and an edge is
joined to the one edge before it where their node has one edge in and one out;
such nonbranching paths are compacted along the coordinates of the source they
first stand in, and end where the node branches or the source changes. A later
document follows a path in spans (document, first word, windows, source, first
word there). The words of each span's source are read again in the source, and
only spans whose own words are the same are removed.

What is shuffled stays small. A text that another document of smaller id has as a
whole (by SHA-256) is one path from end to end and takes no part in the search.
Windows are first grouped by minimiser: of each window's seeds (SEED words) the
one of least hash. A window whose minimiser occurs once cannot repeat, so only
seeds are counted for the whole corpus, about one in seven words, and edges are
made only where a seed is repeated. The joins of edges with paths, of spans with
sources and of results with texts are on hashes or ids whose larger partitions
Spark can split.

Windows are judged on the input; a window that repeats one of its own document is
compared with it word by word. Null and empty texts have no words. Rows of one
doc_id are compared with other ids, not with each other; identical rows are
judged alike. Rows of null doc_id rank after all others, as one document. Extra
columns do not take part. A span that fails the check (hashes collide) stays. k
is 2 at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, checkpointed, gram_hashes, mix, signed, slices

WINDOW, SEED = 20, 8
_LAST = (1 << 63) - 1


class Windows:
    """Window and minimiser hashes of many documents; `at` is each window's first word in the slice."""

    def __init__(self, texts: pa.Array, k: int = WINDOW):
        self.words = Words(texts)
        self.hashes = self.words.hashes()
        self.k = k
        counts = self.words.counts()
        ends = np.repeat(self.words.first[1:], counts)
        self.at = np.flatnonzero(np.arange(len(self.hashes)) + k <= ends)
        self.doc = np.repeat(np.arange(len(counts)), counts)[self.at]

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the hash of its least seed and where that seed (the first of equals) begins."""
        seed = min(SEED, self.k)
        grams = gram_hashes(self.hashes, seed)
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        width = self.k - seed + 1
        # Sliding minimum by doubling; places follow the values.
        least, place, have = grams.copy(), np.arange(len(grams)), 1
        while have < width:
            step = min(have, width - have)
            right = least[step:]
            better = right < least[: len(right)]
            least, place = np.where(better, right, least[: len(right)]), np.where(better, place[step:], place[: len(right)])
            have += step
        return least[self.at], place[self.at]

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the hashes of its first and of its last k-1 words."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        grams = gram_hashes(self.hashes, self.k - 1)
        return grams[self.at], grams[self.at + 1]

    def keys(self) -> np.ndarray:
        begin, end = self.nodes()
        return mix(begin ^ mix(end + np.uint64(1)))


def _seeds(k: int, by_doc: bool):
    """Occurrences of minimisers: a hash and a count per slice, or the distinct hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                w = Windows(batch.column("__text"), k)
                least, place = w.minimisers()
                if by_doc:
                    order = np.lexsort((least, w.doc))
                    d, h = w.doc[order], least[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                    taken = pa.array(d[new], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[new])), batch.column("id").take(taken)], names=["seed", "id"])
                else:
                    _, one = np.unique(place, return_index=True)
                    value, n = np.unique(least[one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n)], names=["seed", "n"])

    return run


def _first_in_document(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which windows are the first of their words in their document."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    first = np.ones(len(keys), dtype=bool)
    first[order[1:]] = (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return first


def _edges(k: int):
    """Windows, each once a document, whose minimiser is repeated: the two nodes, document, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                w = Windows(batch.column("__text"), k)
                least, (begin, end) = signed(w.minimisers()[0]), w.nodes()
                bounds = np.searchsorted(w.doc, np.arange(len(batch) + 1))
                hit = _first_in_document(w.doc, w.keys())
                for i, seeds in enumerate(batch.column("seeds")):
                    hit[bounds[i] : bounds[i + 1]] &= np.isin(least[bounds[i] : bounds[i + 1]], seeds.values.to_numpy())
                hit = np.flatnonzero(hit)
                arrays = [pa.array(signed(begin[hit])), pa.array(signed(end[hit])), batch.column("id").take(pa.array(w.doc[hit], pa.int64())), pa.array(hit - bounds[w.doc[hit]], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["begin", "end", "id", "place"])

    return run


def paths(edges: DataFrame) -> DataFrame:
    """begin, end, src, src_place, path: repeated edges with their first place, and the place in src where their path begins.

    `edges`: begin, end (nodes), id, place, each edge once a document.
    """
    # Far fewer than their occurrences, so they are written once and met three times.
    firsts = checkpointed(edges.groupBy("begin", "end").agg(F.min("id").alias("src"), F.max("id").alias("top"), F.min_by("place", "id").alias("src_place")).where("src < top").drop("top"))
    none = F.lit(None)
    into = firsts.select(F.col("end").alias("node"), F.lit(1).alias("ins"), F.lit(0).alias("outs"), F.col("src").alias("before"), F.col("src_place").alias("before_place"))
    out = firsts.select(F.col("begin").alias("node"), F.lit(0).alias("ins"), F.lit(1).alias("outs"), none.cast("long").alias("before"), none.cast("int").alias("before_place"))
    # The edge before is the only one where there is one, so the largest of its coordinates is its own.
    nodes = into.unionAll(out).groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.max("before").alias("before"), F.max("before_place").alias("before_place"))
    follows = (F.col("ins") == 1) & (F.col("outs") == 1) & F.coalesce((F.col("before") == F.col("src")) & (F.col("before_place") == F.col("src_place") - 1), F.lit(False))
    linked = firsts.join(nodes, F.col("begin") == F.col("node")).withColumn("head", F.when(~follows, F.col("src_place")))
    along = W.partitionBy("src").orderBy("src_place").rowsBetween(W.unboundedPreceding, 0)
    return linked.select("begin", "end", "src", "src_place", F.last("head", ignorenulls=True).over(along).alias("path"))


def _source_words(k: int):
    """Digests of the words of spans in their source document; none where it has no such words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                words = Words(batch.column("__text"))
                rows: list[tuple] = []
                for i, asked in enumerate(batch.column("asked")):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    for at, n in zip(asked.values.field("src_start").to_pylist(), asked.values.field("n").to_pylist(), strict=True):
                        if a + at + n + k - 1 <= b:
                            rows.append((i, at, n, _digest(words, a + at, a + at + n + k - 1)))
                numbers = [pa.array([r[c] for r in rows], pa.int32()) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([r[0] for r in rows], pa.int64())), *numbers, pa.array([r[3] for r in rows], pa.binary())], names=["src", "src_start", "n", "digest"])

    return run


def _digest(words: Words, a: int, b: int) -> bytes:
    """Of the words a..b-1 joined by one space."""
    raw = words.raw[words.start[a] : words.end[b - 1]].tobytes()
    return hashlib.md5(b" ".join(raw.split())).digest()


def _own_repeats(w: Windows) -> Iterator[tuple[int, int]]:
    """First word and number of windows of runs whose words also start earlier in their own document, compared word by word."""
    keys = w.keys()
    order = np.lexsort((np.arange(len(keys)), keys, w.doc))
    again = np.zeros(len(keys), dtype=bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    if not again.any():
        return
    # Where the first window of the same words is.
    group = np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
    first = np.empty(len(keys), dtype=np.int64)
    first[order] = order[group]
    hit = np.flatnonzero(first != np.arange(len(keys)))
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(first[hit]) != 1) | (np.diff(w.doc[hit]) != 0)
    begin = np.flatnonzero(new)
    for j, n in zip(begin.tolist(), np.diff(np.append(begin, len(hit))).tolist(), strict=True):
        a, b = int(w.at[hit[j]]), int(w.at[first[hit[j]]])
        if _digest(w.words, a, a + n + w.k - 1) == _digest(w.words, b, b + n + w.k - 1):
            yield a, n


def _remover(k: int, names: list[str], with_text: bool):
    """Applies verified spans, and the repeats inside the document, to each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                w = Windows(batch.column("__text"), k)
                words = w.words
                change = np.zeros(len(w.hashes) + 1, dtype=np.int64)
                for at, n in _own_repeats(w):
                    change[at] += 1
                    change[at + n + k - 1] -= 1
                counts = words.counts()
                for i, (copied, spans) in enumerate(zip(batch.column("copied").to_pylist(), batch.column("spans"), strict=True)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if copied and counts[i] >= k:
                        change[a] += 1
                        change[b] -= 1
                    elif spans.is_valid:
                        rows = spans.values
                        for at, n, digest in zip(rows.field("start").to_pylist(), rows.field("n").to_pylist(), rows.field("digest").to_pylist(), strict=True):
                            end = a + at + n + k - 1
                            if end <= b and _digest(words, a + at, end) == digest:
                                change[a + at] += 1
                                change[end] -= 1
                gone = np.cumsum(change[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (words.counts() > 0) if len(batch) else np.zeros(0, np.int64)
                shas, texts = [], []
                raw = words.raw.tobytes()
                for i in range(len(batch)):
                    a, b = words.first[i], words.first[i + 1]
                    if removed[i] == 0:
                        kept = b" ".join(raw[words.doc_at[i] : words.doc_at[i + 1]].split())
                    else:
                        stay = np.flatnonzero(~gone[a:b]) + a
                        kept = b" ".join([raw[p:q] for p, q in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept)
                arrays = [batch.column(c) for c in names] + [pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
                fields = [*names, "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    fields.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names=fields)

    return run


def remove_repeats(docs: DataFrame, k: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row of `docs` (doc_id, text).

    Three small tables are written on the way (copies, repeated seeds, repeated edges), and the shuffles behind them let
    go. In the plan after them all joins with the texts are on `id` alone, so their one exchange is reused.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("text").alias("__text"))
    # 0. Whole copies, by id and text.
    sums = texts.select("id", F.xxhash64("__text").alias("th"), F.sha2("__text", 256).alias("sum"))
    origins = sums.groupBy("sum").agg(F.min("id").alias("src"), F.max("id").alias("top")).where("src < top").drop("top")
    copies = checkpointed(sums.join(origins, "sum").where("id > src").groupBy("id").agg(F.collect_set("th").alias("ths")))
    tagged = texts.join(copies, "id", "left").withColumn("copied", F.coalesce(F.array_contains("ths", F.xxhash64("__text")), F.lit(False))).drop("ths")
    single = tagged.where("NOT copied").drop("copied")
    # 1. Seeds that occur more than once.
    repeated = single.select("__text").mapInArrow(_seeds(k, False), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    # 2. Per document, its repeated seeds; then the edges that have one.
    own = checkpointed(single.select("id", "__text").mapInArrow(_seeds(k, True), "seed long, id long").join(repeated, "seed").groupBy("id").agg(F.collect_set("seed").alias("seeds")))
    edges = single.join(own, "id").select("id", "__text", "seeds").mapInArrow(_edges(k), "begin long, end long, id long, place int")
    # 3. Paths of the graph, and the spans in which later documents follow them.
    later = edges.join(paths(edges), ["begin", "end"]).where("id > src").select("id", "src", "path", (F.col("place") - F.col("src_place")).alias("shift"), "place")
    follow = ["id", "src", "path", "shift"]
    run = F.col("place") - F.row_number().over(W.partitionBy(*follow).orderBy("place"))
    spans = later.withColumn("run", run).groupBy(*follow, "run").agg(F.min("place").alias("start"), F.count("*").cast("int").alias("n"))
    spans = spans.select("id", "src", "start", "n", (F.col("start") - F.col("shift")).alias("src_start"))
    # 4. The words at the source's coordinates.
    asked = spans.groupBy(F.col("src").alias("id")).agg(F.collect_set(F.struct("src_start", "n")).alias("asked"))
    words = texts.join(asked, "id").select("id", "__text", "asked").mapInArrow(_source_words(k), "src long, src_start int, n int, digest binary")
    found = spans.join(words, ["src", "src_start", "n"]).groupBy("id").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans"))
    # 5. Removal.
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = tagged.join(found, "id", "left").select("id", "__text", "copied", "spans").mapInArrow(_remover(k, ["id"], with_text), schema)
    return out.select(F.nullif("id", F.lit(_LAST)).alias("doc_id"), *out.columns[1:])
