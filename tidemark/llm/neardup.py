"""Near-duplicate classes by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles; the j-th occurrence of a
shingle is labelled j, so the labelled shingles of a document all differ. Each of
SKETCHES hash orders picks the PICKS least labelled shingles and keeps them in
text order; the hash of that sequence is a bucket key. Documents meet if they
share a key, which becomes likely only if they share shingles in the same order:
at similarity 0.8 a pair meets with probability 0.9999, while texts that share a
passage of a third of their length seldom do. Short documents have fewer picks.

Candidate pairs are verified by alignment of the labelled shingles inside a band
of diagonals: similarity is the longest common subsequence c over n1 + n2 - c,
at least SIMILARITY. Classes are the connected components of verified pairs.

Skew: equal texts collapse first into one representative, by an aggregate that
combines before the shuffle. In a bucket each member is compared with one lead,
so a bucket of m makes m - 1 pairs. Members then lie in components; those outside
the bucket's largest one are its strays. Buckets of more than STRAYS are compared
with a lead of the largest component again (up to LEADS times). Then

* in a bucket of at most STRAYS, each stray is compared with all members of other
  components: at most STRAYS pairs a member;
* texts of buckets with more are compared through their rarest shingles. Two texts
  are similar only if they share one of the first n - 0.8 n + 1 of their n
  shingles, in any order common to all texts; in ascending order of the number of
  texts that hold a shingle these are the rare ones, and what many unlike texts
  have in common (a licence, a menu) comes too late to bring them together. Texts
  that share a rare shingle are compared with one of them first, then those still
  in different components with one another. A bounded sample of the texts says
  first what is common (SAMPLE; any order is right, only the work depends on it);
  components none of whose texts shares a rare shingle with another's are done.
  Texts of which more than CROWD still share a rare shingle in different
  components are done again by exact counts over all of them.

Pairs whose lengths, places of the shared shingle, or parities show that they
can't be similar are left out. Parities of the number of shingles in each of BITS
hash ranges differ in no more ranges than shingles differ, and texts of n1 and n2
shingles at similarity s differ in at most (1 - s) / (1 + s) (n1 + n2). So no link
between two texts of a bucket is lost, and no list of members or candidates is cut.

What meets nothing does not travel: keys are counted by themselves, and a bit filter
of those in several rows, then one of the texts in shared buckets, say which go on.
Filters lose nothing, and the joins after them are exact. Texts themselves are never
shuffled, only the sequences (four bytes a shingle) of those in shared buckets, and
of these only the ones that pairs ask for.

A document of fewer than five words has its words as one shingle. Documents
without words (null, empty, blank) are alone in their class. Repeated rows and
equal texts share a class. The class id is the smallest doc_id in it. Rows of
null doc_id are classed, and give no class its id unless it has no other. Extra
columns do not take part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hashes, mix, passes, signed, slices, tidy
from .common import checkpointed as _checkpointed

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS = 32, 6
#: Documents of fewer shingles than SHORT_BELOW also (below LONG_FROM, only) have SHORT_SKETCHES of SHORT_PICKS: six of few would ask for equality.
SHORT_SKETCHES, SHORT_PICKS, LONG_FROM, SHORT_BELOW = 8, 2, 32, 40
#: How far a diagonal may lie from the main one, as a share of the longer sequence; similar texts need at most 1 - SIMILARITY.
BAND = 0.25
#: Hash ranges whose parities are compared before alignment.
BITS = 1024
#: Up to so many texts outside a bucket's largest component are compared with all its members, after up to so many more leads.
STRAYS, LEADS = 64, 2
#: Texts whose first SAMPLE_ITEMS shingles say what is common, and from how many of them on; texts that share a rare shingle beyond which exact counts decide.
SAMPLE, SAMPLE_ITEMS, COMMON_FROM, CROWD = 2048, 4096, 3, 2048
#: The share of n1 + n2 shingles that two similar texts have in common at least (twice), and may differ in at most.
COMMON, APART = SIMILARITY / (1 + SIMILARITY), (1 - SIMILARITY) / (1 + SIMILARITY)

#: As powers of two: the bits of a filter for each of its values at least, and all bits at most (16 MB). A fuller filter only lets more through.
FILTER_EACH, FILTER_MOST = 4, 27

#: Edges that one task joins at once; more of them are dealt over tasks first, and their stars joined by alternation.
EDGES = 1 << 16
#: A text's entry in the list of a first shingle.
_ENTRY = np.dtype([("shingle", "<u4"), ("n", "<i4"), ("place", "<i4"), ("digest", "<u8", 2), ("root", "<u8", 2)])

_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, SKETCHES, dtype=np.uint64)


def _gathered(df: DataFrame) -> DataFrame:
    """A few parts a core. Of a table that is small against the input: split joins and unions leave many parts of few rows."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame) -> DataFrame:
    return _checkpointed(_gathered(df))


def bit_filter(values: DataFrame) -> np.ndarray:
    """The filter for passes() of the 64-bit hashes `value`, which all differ. The driver sees its bits only, as parts of 4 KB."""
    values = checkpointed(values)
    bits = min(max(values.count().bit_length() + FILTER_EACH, 15), FILTER_MOST)
    low = (1 << bits) - 1
    places = F.array(F.col("value").bitwiseAND(low), F.shiftrightunsigned("value", bits).bitwiseAND(low))
    parts = values.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits")).toArrow()
    table = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for part, held in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        table[part] = np.frombuffer(held, np.uint8)
    return table.reshape(-1).view(np.uint64)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Mixes into each shingle hash which occurrence of it this is."""
    if len(hashes) < 2:
        return mix(hashes.copy())
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    occurrence = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    out = np.empty_like(hashes)
    out[order] = mix(s + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Labelled shingle hashes of one document's word hashes, in text order."""
    return labelled(gram_hashes(words, SHINGLE) if len(words) >= SHINGLE else gram_hashes(words, len(words)) if len(words) else words)


def _keys(items: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    k = min(picks, len(items))
    ranks = items[None, :] ^ seeds[:, None]
    ranks = (ranks ^ (ranks >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    least = np.argpartition(ranks, k - 1, axis=1)[:, :k] if k < len(items) else np.tile(np.arange(k), (len(seeds), 1))
    picked = items[np.sort(least, axis=1)]
    key = seeds + np.uint64(picks)
    for j in range(k):
        key = mix(key ^ picked[:, j])
    return key


def sketches(items: np.ndarray) -> np.ndarray:
    """Bucket keys: one per hash order, of the least items in text order."""
    out = []
    if len(items) < SHORT_BELOW:
        out.append(_keys(items, _SEEDS[:SHORT_SKETCHES], SHORT_PICKS))
    if len(items) >= LONG_FROM:
        out.append(_keys(items, _SEEDS, PICKS))
    return np.concatenate(out)


def parities(items: np.ndarray) -> np.ndarray:
    """Whether each of BITS ranges holds an odd number of the different items (of 32 bits), 64 ranges a number."""
    odd = np.bincount(np.unique(items) // np.uint32(2**32 // BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Banded alignment of two sequences whose items differ within each: c / (n1 + n2 - c)."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < SIMILARITY * max(n, m):
        return 0.0
    _, at, to = np.intersect1d(a, b, return_indices=True)
    if len(at) < COMMON * (n + m) - 1e-9:
        return 0.0
    order = np.argsort(at)
    at, to = at[order], to[order]
    inside = np.abs(at - to) <= max(BAND * max(n, m), 1)
    to = to[inside]
    if len(to) and np.all(to[1:] > to[:-1]):
        c = len(to)
    else:
        # Matches are one to one, so the common subsequence is the longest rising run of places.
        tails: list[int] = []
        for x in to.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        c = len(tails)
    return c / (n + m - c)


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket keys of each text; a text without words has null."""
    for whole in batches:
        for batch in slices(whole, "__text"):
            w = Words(batch.column("__text"))
            hashes = w.hashes()
            keys = [signed(sketches(shingles(hashes[a:b]))) if b > a else None for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"])


def _met_keys(table: np.ndarray):
    """Of each row the keys that pass the filter; rows of none go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat, ends = keys.flatten(), keys.offsets.to_numpy()
            hit = passes(table, flat.to_numpy(zero_copy_only=False).view(np.uint64))
            ends = np.searchsorted(hit, ends - ends[0])
            met = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.take(pa.array(hit)))
            yield batch.select(["doc_id", "digest"]).append_column("keys", met).filter(pa.array(np.diff(ends) > 0))

    return run


def _passing(table: np.ndarray):
    """Rows whose `value` passes the filter, without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(table, batch.column("value").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.take(pa.array(hit)).drop_columns(["value"])

    return run


def _sequencer(table: np.ndarray):
    """Labelled shingles of each text that passes the filter, four bytes each: enough to align two texts; their number and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _passing(table)(batches):
            for batch in slices(whole, "__text"):
                w = Words(batch.column("__text"))
                hashes = w.hashes()
                wide = [shingles(hashes[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                items = [(x >> np.uint64(32)).astype(np.uint32) for x in wide]
                odd = [parities(x) for x in items]
                arrays = [batch.column("digest"), pa.array([x.tobytes() for x in items], pa.binary()), pa.array([len(x) for x in items], pa.int32()), pa.array(odd, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["digest", "items", "n", "odd"])

    return run


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("a_items"), batch.column("b_items")
        ok = [similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) >= SIMILARITY for x, y in zip(left, right, strict=True)]
        yield batch.select(["a_root", "b_root"]).append_column("near", pa.array(ok, pa.bool_()))


def _first_places(n: int) -> int:
    """How many of the first of n shingles, in any common order, a similar text must share one of."""
    return n - int(np.ceil(n * SIMILARITY - 1e-9)) + 1


def _sampled_order(sequences: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample hold, ascending, and how many do."""
    sample = sequences.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select(F.substring("items", 1, 4 * SAMPLE_ITEMS).alias("items")).toArrow().column(0)
    each = [np.unique(np.frombuffer(x.as_py(), np.uint32)) for x in sample]
    value, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return value[n >= COMMON_FROM], n[n >= COMMON_FROM].astype(np.uint16)


def _first_shingles(items: np.ndarray, common: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, int]:
    """A text's first shingles in ascending order of what the sample says, then of a hash; and how many different ones it has."""
    items = np.unique(items)
    rank = np.zeros(len(items), np.uint16)
    if len(common):
        at = np.minimum(np.searchsorted(common, items), len(common) - 1)
        rank = np.where(common[at] == items, texts[at], rank)
    return items[np.lexsort((mix(items.astype(np.uint64)), rank))[: _first_places(len(items))]].astype(np.int64), len(items)


def _first_lists(common: np.ndarray, texts: np.ndarray, parts: int):
    """Entries of each text's first shingles, those of a batch packed into one row for each of `parts` parts of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [_first_shingles(np.frombuffer(x.as_py(), np.uint32), common, texts) for x in batch.column("items")]
            if not firsts:
                continue
            lengths = np.array([len(f) for f, _ in firsts])
            owner = np.repeat(np.arange(len(firsts)), lengths)
            entries = np.zeros(len(owner), _ENTRY)
            entries["shingle"] = np.concatenate([f for f, _ in firsts])
            entries["n"] = np.array([n for _, n in firsts])[owner]
            entries["place"] = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for name in ("digest", "root"):
                entries[name] = np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u8").reshape(-1, 2)[owner]
            part = entries["shingle"] % np.uint32(parts)
            order = np.argsort(part, kind="stable")
            value, begin = np.unique(part[order], return_index=True)
            packed = [x.tobytes() for x in np.split(entries[order], begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "entries"])

    return run


def _open_entries(table: pa.Table) -> pa.Table:
    """Of one part, the entries of shingles that texts of several components have among their first."""
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), _ENTRY)
    entries = entries[np.argsort(entries["shingle"], kind="stable")]
    begin = np.flatnonzero(np.diff(entries["shingle"].astype(np.int64), prepend=-1))
    size = np.diff(np.append(begin, len(entries)))
    other = (entries["root"] != np.repeat(entries["root"][begin], size, axis=0)).any(axis=1)
    entries = entries[np.repeat(np.logical_or.reduceat(other, begin), size)]
    wide = {name: pa.array([x.tobytes() for x in entries[name]], pa.binary()) for name in ("digest", "root")}
    return pa.table({"digest": wide["digest"], "root": wide["root"], "n": entries["n"].copy(), "place": entries["place"].copy(), "shingle": entries["shingle"].astype(np.int64)})


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and how many texts of the batch hold each."""
    for batch in batches:
        each = [np.unique(np.frombuffer(x.as_py(), np.uint32)) for x in batch.column("items")]
        if each:
            value, n = np.unique(np.concatenate(each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], names=["shingle", "texts"])


def _distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different shingles and their number."""
    for batch in batches:
        each = [np.unique(np.frombuffer(x.as_py(), np.uint32)).astype(np.int64) for x in batch.column("items")]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(each, pa.list_(pa.int64()))], names=["digest", "shingles"])


def _rarest(sequences: DataFrame) -> DataFrame:
    """digest, n, shingle, place: of each text (digest, items) the shingles that a similar text must share one of, by rarity.

    Shingles of one text only come first, since they are rarest; they meet nothing and are counted, not kept.
    """
    counts = sequences.mapInArrow(tidy(_shingle_counts), "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts")).where("texts > 1")
    each = sequences.mapInArrow(tidy(_distinct_shingles), "digest binary, shingles array<long>").select("digest", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = each.join(counts, "shingle").groupBy("digest", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("held"))
    alone = F.col("n") - F.size("held")
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1 - alone
    return held.where(first > 0).select("digest", "n", alone.alias("alone"), F.posexplode(F.slice("held", 1, first.cast("int"))).alias("i", "h")).select("digest", "n", (F.col("alone") + F.col("i")).alias("place"), F.col("h.shingle").alias("shingle"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node but the least of what they connect hangs on that one."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        kind = batch.schema.field("a").type
    if hung := [x for x in up if top(x) != x]:
        yield pa.RecordBatch.from_arrays([pa.array(hung, kind), pa.array([top(x) for x in hung], kind)], names=["a", "b"])


def stars(edges: DataFrame) -> DataFrame:
    """a, b for each node a of edges (a, b) but the least of its component, which is b.

    Each task joins a bounded number of edges by itself; where that takes several tasks, alternating large and small
    stars join what they found.
    """
    down = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    tasks = -(-edges.count() // EDGES)
    kind = edges.schema["a"].dataType.simpleString()
    now = checkpointed(edges.select("a", "b").coalesce(max(tasks, 1)).mapInArrow(tidy(_forest), f"a {kind}, b {kind}"))

    def done() -> bool:
        """Edges keep what is connected, so once no node hangs on two, and no root on another, each component is one star."""
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(now.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()

    while tasks > 1 and not done():
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # A node's smaller neighbours and itself hang on the least of them.
        small = large.join(least, "a").select("b", "m").unionAll(least.select(F.col("a").alias("b"), "m"))
        now = checkpointed(down(small.select(F.col("b").alias("a"), F.col("m").alias("b"))))
    return now


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.col("text").alias("__text"))


def _pair(a: str, b: str) -> list[Column]:
    """Columns a, b, a_root, b_root of two structs of digest and root; the larger digest is a."""
    x, y = F.col(a), F.col(b)
    swap = x["digest"] < y["digest"]
    return [F.when(swap, q[f]).otherwise(p[f]).alias(n) for n, f, p, q in (("a", "digest", x, y), ("b", "digest", y, x), ("a_root", "root", x, y), ("b_root", "root", y, x))]


def _may_share(n: str, place: str, b_n: str, b_place: str) -> Column:
    """Lengths, and the places of a shared shingle, allow a similarity of SIMILARITY: what follows it and it are enough."""
    left, right = F.col(n) - F.col(place), F.col(b_n) - F.col(b_place)
    return (F.least(n, b_n) >= SIMILARITY * F.greatest(n, b_n)) & (F.least(left, right) >= COMMON * (F.col(n) + F.col(b_n)) - 1e-6)


def _classes(docs: DataFrame) -> DataFrame:
    """Columns of near_duplicate_classes and root, the least digest of the class; both digests are null without words."""
    given = _keyed(docs)
    sketched = _checkpointed(given.mapInArrow(tidy(_sketcher), "doc_id long, digest binary, keys array<long>"))
    worded = sketched.where("keys IS NOT NULL")
    # Few keys are in several rows. Only these travel with their texts; what a filter lets through besides, the joins leave out.
    often = worded.select(F.explode("keys").alias("value")).groupBy("value").agg(F.count("*").alias("rows")).where("rows > 1")
    met = worded.mapInArrow(tidy(_met_keys(bit_filter(often.select("value")))), "doc_id long, digest binary, keys array<long>")
    # One row per text, however many copies it has; its buckets are those that another text is in too.
    texts = checkpointed(met.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.first("keys").alias("keys")))
    entries = texts.select("digest", "holder", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("digest").alias("first")).where("members > 1")
    # The texts that share a bucket with another, one row each with its buckets and their first texts, and as sequences.
    owned = checkpointed(entries.join(shared, "key").groupBy("digest").agg(F.min("holder").alias("holder"), F.collect_list("key").alias("keys"), F.collect_set("first").alias("firsts")))
    held = given.withColumn("value", F.xxhash64("digest", "doc_id")).mapInArrow(tidy(_sequencer(bit_filter(owned.select(F.xxhash64("digest", "holder").alias("value"))))), "digest binary, items binary, n int, odd array<long>")
    sequences = checkpointed(held.dropDuplicates(["digest"]).join(owned.drop("holder"), "digest"))

    def among(digests: DataFrame) -> DataFrame:
        """digest, items of the sequences of these digests, and of a few more."""
        table = bit_filter(digests.select(F.xxhash64("digest").alias("value")).distinct())
        return sequences.select("digest", "items", F.xxhash64("digest").alias("value")).mapInArrow(tidy(_passing(table)), "digest binary, items binary")

    def near(pairs: DataFrame) -> DataFrame:
        """Of pairs a, b with their roots, the different pairs of roots that a similar pair joins."""
        side = lambda of, c: of.select(F.col("digest").alias(c), F.col("items").alias(f"{c}_items"))
        if "a_items" in pairs.columns:
            met = pairs.join(side(among(pairs.select(F.col("b").alias("digest"))), "b"), "b")
        else:
            pairs = checkpointed(pairs)
            some = among(pairs.select(F.explode(F.array("a", "b")).alias("digest")))
            met = pairs.join(side(some, "a"), "a").join(side(some, "b"), "b")
        met = met.select("a_root", "b_root", "a_items", "b_items")
        return checkpointed(_gathered(met).mapInArrow(tidy(_verifier), "a_root binary, b_root binary, near boolean").where("near").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The texts in buckets after links between roots; `roots` itself without any."""
        if not links.count():
            return roots
        merged = stars(links).select(F.col("a").alias("root"), F.col("b").alias("__root"))
        return checkpointed(roots.join(merged, "root", "left").select("digest", F.coalesce("__root", "root").alias("root"), "n", "odd", "keys"))

    start = sequences.select("digest", F.col("digest").alias("root"), "n", "odd", "keys")
    leads = sequences.select(F.col("digest").alias("a"), F.col("items").alias("a_items"), F.explode("firsts").alias("b")).where("a <> b")
    roots = joined(start, near(leads.select("a", "b", F.col("a").alias("a_root"), F.col("b").alias("b_root"), "a_items")))

    def parts() -> tuple[DataFrame, DataFrame, int, int]:
        """Buckets with their members' roots; of those of several roots the largest, a lead in it, and the number of strays; how many have few, and many."""
        placed = roots.select("digest", "root", "n", "odd", F.explode("keys").alias("key"))
        sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"), F.min_by("digest", F.xxhash64("digest", "key")).alias("lead"))
        most = sizes.groupBy("key").agg(F.max_by(F.struct("root", "lead", "size"), F.struct("size", "root")).alias("main"), F.sum("size").alias("members"))
        parted = checkpointed(most.select("key", F.col("main.root").alias("main"), F.col("main.lead").alias("lead"), (F.col("members") - F.col("main.size")).alias("strays")).where("strays > 0"))
        return placed, parted, *parted.agg(F.count_if(F.col("strays") <= STRAYS), F.count_if(F.col("strays") > STRAYS)).first()

    placed, parted, few_strays, many_strays = parts()
    for _ in range(LEADS):
        if not many_strays:
            break
        astray = placed.join(parted.where(F.col("strays") > STRAYS), "key").where("root <> main").select(F.struct("digest", "root").alias("x"), F.struct(F.col("lead").alias("digest"), F.col("main").alias("root")).alias("y"))
        before, roots = roots, joined(roots, near(astray.select(*_pair("x", "y")).distinct()))
        if roots is before:
            break
        placed, parted, few_strays, many_strays = parts()
    few = placed.join(parted.where(F.col("strays") <= STRAYS).select("key", "main"), "key")
    stray = few.where("root <> main").select(F.col("key").alias("b_key"), F.struct("digest", "root").alias("y"), F.col("n").alias("b_n"), F.col("odd").alias("b_odd"))
    # A stray meets each member of other roots once: other strays only from the smaller digest.
    once = (F.col("root") != F.col("y.root")) & ((F.col("root") == F.col("main")) | (F.col("digest") < F.col("y.digest")))
    listed = _gathered(few.join(stray, (F.col("key") == F.col("b_key")) & once & _alike("n", "odd", "b_n", "b_odd")).withColumn("x", F.struct("digest", "root")).select(*_pair("x", "y"))).distinct()
    if not many_strays:
        roots = joined(roots, near(listed)) if few_strays else roots
    else:
        sized = sequences.select("digest", "odd", "n")
        crowded = checkpointed(placed.join(parted.where(F.col("strays") > STRAYS).select("key"), "key", "left_semi").select("digest").distinct())
        asked = checkpointed(roots.select("digest", "root").join(crowded, "digest", "left_semi").join(among(crowded), "digest"))
        order = _sampled_order(asked)
        lists = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for exact in (False, True):
            # The sample doesn't know which shingles one text only has, so these take places too; exact counts leave them out.
            if exact:
                rarest = checkpointed(_rarest(asked.join(crowded, "digest", "left_semi").select("digest", "items")))
                rare = rarest.join(roots.select("digest", "root"), "digest")
            else:
                rarest = asked.mapInArrow(tidy(_first_lists(*order, lists)), "part int, entries binary").groupBy("part").applyInArrow(_open_entries, "digest binary, root binary, n int, place int, shingle long")
                rare = rarest = checkpointed(rarest)
            rare = rare.select("shingle", F.struct("digest", "root", "n", "place").alias("x"))
            lead = rare.groupBy("shingle").agg(F.min("x").alias("y"), F.max("x.root").alias("high")).where("y.root < high").drop("high")
            star = rare.join(lead, "shingle").where(F.col("x.root") != F.col("y.root")).where(_may_share("x.n", "x.place", "y.n", "y.place"))
            pairs = _plausible(_gathered(star.select(*_pair("x", "y"))).distinct(), sized)
            roots = joined(roots, near(pairs if exact else listed.unionAll(pairs).distinct()))
            # What is left: texts that share a rare shingle and are still apart, met there if their parities allow it too.
            rare = checkpointed(rarest.select("digest", "shingle", "place").join(roots.select("digest", "root", "n", "odd"), "digest"))
            groups = rare.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts")).where("low < high")
            apart = checkpointed(rare.join(groups.select("shingle", "texts"), "shingle"))
            crowd = apart.where(F.col("texts") > (2**62 if exact else CROWD))
            left = apart.where(F.col("texts") <= (2**62 if exact else CROWD)).select("shingle", F.struct("digest", "root").alias("x"), "n", "place", "odd")
            right = left.select("shingle", F.col("x").alias("y"), *(F.col(c).alias(f"b_{c}") for c in ("n", "place", "odd")))
            met = left.join(right, "shingle").where((F.col("x.root") < F.col("y.root")) & _may_share("n", "place", "b_n", "b_place") & _alike("n", "odd", "b_n", "b_odd"))
            roots = joined(roots, near(_gathered(met.select(*_pair("x", "y"))).distinct()))
            if exact or crowd.isEmpty():
                break
            crowded = checkpointed(crowd.select("digest").distinct())
    roots = roots.select("digest", "root")
    placed = worded.select("doc_id", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = sketched.where("keys IS NULL").select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("binary").alias("root"))
    return placed.join(classes, "root").select("doc_id", "digest", "class_id", "class_size", "root").unionAll(alone)


def _alike(n: str, odd: str, b_n: str, b_odd: str) -> Column:
    """Lengths and parities allow a similarity of SIMILARITY."""
    differ = sum((F.bit_count(F.col(odd)[i].bitwiseXOR(F.col(b_odd)[i])) for i in range(BITS // 64)), F.lit(0))
    return (F.least(n, b_n) >= SIMILARITY * F.greatest(n, b_n)) & (differ <= APART * (F.col(n) + F.col(b_n)) + 1e-6)


def _plausible(pairs: DataFrame, sized: DataFrame) -> DataFrame:
    """Of pairs a, b those whose lengths and parities allow a similarity of SIMILARITY."""
    side = lambda c: sized.select(F.col("digest").alias(c), F.col("odd").alias(f"{c}_odd"), F.col("n").alias(f"{c}_n"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("a_n", "a_odd", "b_n", "b_odd")).select("a", "b", "a_root", "b_root")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), class_id, class_size for each row of `docs`; digest is null without words."""
    return _classes(docs).drop("root")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class: the smallest doc_id, of it the smallest digest, once. Documents without words all stay."""
    classes = _classes(docs).where("digest IS NOT NULL")
    # By root: a class id need not be unique, as ids can be null or repeat.
    keeper = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")).select(F.col("least.doc_id").alias("__id"), F.col("least.digest").alias("__digest"))
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.col("text").cast("binary"))))
    stay = keyed.join(keeper, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest"))).drop("__id", "__digest")
    wordless = keyed.where(F.coalesce(F.length(F.regexp_replace("text", "[\\x09-\\x0D\\x20]+", "")), F.lit(0)) == 0)
    return stay.dropDuplicates(["doc_id", "__key"]).unionByName(wordless).select(*docs.columns)
