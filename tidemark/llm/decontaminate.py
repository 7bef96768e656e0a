"""Documents that hold windows of benchmark items, by a prefix-filtered set join.

A window is 10 consecutive words of an item (all of them, where it has fewer). It
is a set of shingles of five words (or of all its words, if fewer), and is held
only by a document that has every one of them: the necessary prefix of the set,
in any one order of shingles, is its first. Shingles are ordered by how often all
documents have them, so each window is looked for by its rarest shingle alone.

Documents are read twice: for the counts of the items' shingles, and for the
places of the chosen ones with the few words around them. What leaves a task is
first tested against a bit filter of a fixed size (FILTER_BITS, so also what the
driver holds, however large the benchmark is); what passes it wrongly finds no
window in the join. A place and the shingle's offset in the window give where the
window would start, which must lie inside the document with the window's length
(positional and length bounds), and the words there must be the window's.

Words: maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are made
small. Null and empty texts have no words. Each row of the documents is a row of
the result; equal rows are searched as one. Rows of one item_id are one item; an
item of null id marks words, but is not counted or listed. Items of the same
words are searched once. Extra columns take no part. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, mix, passes, ragged, signed, slices, text_bytes, tidy

WINDOW, SHINGLE = 10, 5
FILTER_BITS = 24

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 0x20
_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Terms:
    """The words of many texts: byte ranges in `raw`, the first word of each text, and a 64-bit hash of each word."""

    def __init__(self, texts: pa.Array):
        raw, at = text_bytes(texts)
        self.raw = _SMALL[raw]
        solid = _SOLID[self.raw]
        n = len(solid)
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)
        # Each unlike word is hashed once: a text of any length has a small vocabulary.
        offsets = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw[solid])])
        coded = words.dictionary_encode()
        hashes = Words(coded.dictionary).hashes()
        self.hashes = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of all `width` consecutive words of one text."""
        counts = np.diff(self.first)
        at = ragged(self.first[:-1], np.maximum(counts - width + 1, 0))
        h = np.full(len(at), width, dtype=np.uint64)
        for i in range(width):
            h += self.hashes[at + i] * _FACTORS[i]
        return at, mix(h)

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by one space."""
        raw = self.raw
        return b" ".join([raw[p:q].tobytes() for p, q in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every window of each item: item, window, n (words), width, shingle, place (in the window)."""
    for whole in batches:
        for batch in slices(whole, "__text"):
            terms = Terms(batch.column("__text"))
            rows: dict[str, list] = {c: [] for c in ("item_id", "words", "n", "width", "shingle", "place")}
            hashed = {width: dict(zip(*(x.tolist() for x in (at, signed(h))), strict=True)) for width in range(1, SHINGLE + 1) for at, h in [terms.shingles(width)]}
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                a, b = int(terms.first[i]), int(terms.first[i + 1])
                n = min(WINDOW, b - a)
                width = min(SHINGLE, n)
                for at in range(a, b - n + 1) if n else ():
                    words = terms.joined(at, at + n)
                    for place in range(n - width + 1):
                        for c, x in zip(rows, (item, words, n, width, hashed[width][at + place], place), strict=True):
                            rows[c].append(x)
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in zip(rows, kinds, strict=True)], names=list(rows))


def _filter(shingles: DataFrame) -> tuple[list[int], np.ndarray]:
    """The widths that occur, and a bit filter of FILTER_BITS bits (two a shingle) as 64-bit words."""
    bits = [F.col("shingle").bitwiseAND((1 << FILTER_BITS) - 1), F.shiftrightunsigned("shingle", FILTER_BITS).bitwiseAND((1 << FILTER_BITS) - 1)]
    found = shingles.select("width", F.explode(F.array(*bits)).alias("bit"))
    words = found.groupBy("width", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
    rows = words.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    np.bitwise_or.at(table, rows["word"].to_numpy(), rows["bits"].to_numpy().view(np.uint64))
    return sorted(set(rows["width"].to_pylist())), table


def _counter(widths: list[int], table: np.ndarray) -> Callable:
    """Occurrences of shingles that pass the filter: shingle, n in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                terms = Terms(batch.column("__text"))
                hashes = [h[passes(table, h)] for width in widths for _, h in [terms.shingles(width)]]
                value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n, pa.int64())], names=["shingle", "n"])

    return run


def _finder(widths: list[int], table: np.ndarray) -> Callable:
    """One row of each text (id, twin, n_words, without place), and one of each place of a shingle that passes the filter.

    `around` are the words from `from_word` on in which a window with the shingle at `place` must lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                terms = Terms(batch.column("__text"))
                counts = np.diff(terms.first)
                row, place, shingle, begin, around = [np.arange(len(batch))], [], [], [], []
                for width in widths:
                    at, h = terms.shingles(width)
                    hit = passes(table, h)
                    doc = np.searchsorted(terms.first, at[hit], side="right") - 1
                    a = np.maximum(at[hit] - (WINDOW - width if width == SHINGLE else 0), terms.first[doc])
                    b = np.minimum(at[hit] + (WINDOW if width == SHINGLE else width), terms.first[doc + 1])
                    row.append(doc)
                    place.append(at[hit] - terms.first[doc])
                    shingle.append(signed(h[hit]))
                    begin.append(a - terms.first[doc])
                    around += [terms.joined(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                rows = np.concatenate(row)
                none = pa.nulls(len(batch), pa.int64())
                filled = lambda parts: pa.concat_arrays([none, *[pa.array(p, pa.int64()) for p in parts]])
                taken = pa.array(rows)
                arrays = [batch.column("id").take(taken), batch.column("twin").take(taken), pa.array(counts[rows], pa.int64()), filled(place), filled(shingle), filled(begin)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.concat_arrays([pa.nulls(len(batch), pa.binary()), pa.array(around, pa.binary())])], names=["id", "twin", "n_words", "place", "shingle", "from_word", "around"])

    return run


def windows(items: DataFrame) -> DataFrame:
    """item_id (as text), words, n, width, shingle, place: the windows of each item with their shingles."""
    given = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("__text"))
    return given.mapInArrow(_item_windows, "item_id string, words binary, n int, width int, shingle long, place int")


def prefixes(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """words, n, width, shingle, place: each window once, with its shingle that the documents have least often."""
    each = shingles.select("words", "n", "width", "shingle", "place").distinct()
    counted = docs.select(F.col("text").alias("__text")).mapInArrow(tidy(_counter(*_filter(each))), "shingle long, n long")
    counts = counted.groupBy("shingle").agg(F.sum("n").alias("often"))
    rarity = F.struct(F.coalesce("often", F.lit(0)), "shingle", "place")
    return each.join(counts, "shingle", "left").groupBy("words", "n", "width").agg(F.min_by(F.struct("shingle", "place"), rarity).alias("rarest")).select("words", "n", "width", "rarest.*")


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, hits, windows): unlike (id, twin) with n_words and rows; id, twin, start, n, words of each occurrence; windows of items.

    The prefixes and what the documents may hold of them are written to the shared folder, in a few per cent of the texts' size.
    """
    shingles = windows(items)
    chosen = checkpointed(prefixes(docs, shingles))
    given = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("twin"), F.col("text").alias("__text"))
    schema = "id long, twin long, n_words long, place long, shingle long, from_word long, around binary"
    found = checkpointed(given.mapInArrow(tidy(_finder(*_filter(chosen))), schema))
    texts = found.where("place IS NULL").groupBy("id", "twin").agg(F.max("n_words").alias("n_words"), F.count("*").alias("rows"))
    places = found.where("place IS NOT NULL").withColumnRenamed("place", "at")
    start = F.col("at") - F.col("place")
    inside = (start >= F.col("from_word")) & (start + F.col("n") <= F.col("n_words"))
    held = F.array_join(F.slice(F.split(F.col("around").cast("string"), " "), (start - F.col("from_word")).cast("int") + 1, F.col("n")), " ")
    hits = places.join(chosen, "shingle").where(inside).where(held == F.col("words").cast("string"))
    return texts, hits.select("id", "twin", start.alias("start"), "n", "words"), shingles


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted text), contaminated of each row of `docs` (doc_id, text), by `items` (item_id, text)."""
    texts, hits, shingles = occurrences(docs, items)
    both = ["id", "twin"]
    # Covered words: spans of one text in order, each adding what lies past the furthest end so far.
    spans = hits.groupBy(*both).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))

    def cover(so_far, span):
        end = F.greatest(so_far["end"], span["start"] + span["n"])
        return F.struct((so_far["hit"] + end - F.greatest(F.least(span["start"], end), so_far["end"])).alias("hit"), end.alias("end"))

    covered = spans.select(*both, F.aggregate("spans", zero, cover)["hit"].alias("n_hit"))
    # Items of the same words are one class until their ids are listed.
    owners = shingles.where("item_id IS NOT NULL").groupBy("item_id").agg(F.sort_array(F.collect_set("words")).alias("own")).select("item_id", F.explode("own").alias("words"), F.sha2(F.array_join(F.col("own").cast("array<string>"), "\n"), 256).alias("class"))
    classes = hits.select(*both, "words").distinct().join(owners.select("words", "class").distinct(), "words").select(*both, "class").distinct()
    items_of = classes.join(owners.select("class", "item_id").distinct(), "class").groupBy(*both).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = covered.join(items_of, [covered["id"].eqNullSafe(items_of["id"]), covered["twin"] == items_of["twin"]], "left").select(covered["id"], covered["twin"], "n_hit", "items")
    found = found.select(F.col("id").alias("hit_id"), F.col("twin").alias("hit_twin"), "n_hit", "items")
    out = texts.join(found, [F.col("id").eqNullSafe(F.col("hit_id")), F.col("twin") == F.col("hit_twin")], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    result = out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"), "rows")
    return result.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("row", "rows")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS r, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_words AS (SELECT r, item_id, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS p FROM i),
item_tails AS (SELECT r, item_id, size, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS tail FROM item_words),
windows AS (
  SELECT DISTINCT item_id, len(tail) AS n, array_to_string(tail, ' ') AS words FROM item_tails WHERE len(tail) = least(size, 10)),
sizes AS (SELECT DISTINCT n FROM windows),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
tails AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS tail FROM words),
hits AS (
  SELECT t.r, t.p, v.n, v.item_id
  FROM (SELECT r, p, n, array_to_string(tail[1:n], ' ') AS words FROM tails, sizes WHERE len(tail) >= n) t JOIN windows v ON t.n = v.n AND t.words = v.words),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM hits) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
