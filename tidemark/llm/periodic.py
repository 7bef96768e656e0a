"""Runs: maximal stretches of words that repeat with a smallest period, at least four times over.

Words become exact integers, and a document is searched scale by scale. At the
scale of block length B (a power of two) periods lie between (2B-1)/3 and the
next scale's least. A run of such a period q and of length max(6, 4q) or more is
long enough to hold a block of B words that begins at a multiple of B, and its
copy q words later. So the aligned blocks are put into an Aho-Corasick automaton
whose keys are sequences of integers, the document is run through it, and each
aligned block that occurs again at a distance of this scale is a seed, extended
word by word in both directions. Nothing shorter or further away is compared.

Inside a run every word past the first q has its like at most q words before, so
only stretches with that property (and what lies before them by one period) are
searched: the screen loses no run, and prose has few such stretches. An automaton
holds one piece of a stretch, PIECE words or one block, whatever the length of
the document. A seed that lies in a run of a smaller scale repeats that run's
period; a stretch found again has its smallest period already, for scales ascend.

A word is collapsed if a run contains it after that run's first period. Null and
empty texts have no words and no runs. Each row is judged by itself, so rows that
repeat and null ids need no care; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ragged, slices, tidy

#: A run has six words and four periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
PIECE = 1 << 16
_FAR = np.iinfo(np.int64).max


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block length, least and greatest period of each scale that a document of `longest` words can have a run of."""
    block = 2
    while LEAST_PERIODS * (low := (2 * block + 1) // 3) <= longest:
        yield block, low, (4 * block + 1) // 3 - 1
        block *= 2


def coded(words: Words) -> np.ndarray:
    """An integer for each word; the same for the same bytes, and for no others."""
    offsets = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.cumsum(words.end - words.start, out=offsets[1:])
    letters = words.raw[np.repeat(words.start - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
    plain = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return plain.dictionary_encode().indices.to_numpy()


def distances(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words before each word its like is, in the same document (`first`: where each begins)."""
    back = np.full(len(ids), _FAR)
    order = np.argsort(ids, kind="stable")
    here, before = order[1:], order[:-1]
    begins = np.repeat(first[:-1], np.diff(first))
    like = (ids[here] == ids[before]) & (before >= begins[here])
    back[here[like]] = here[like] - before[like]
    return back


def stretches(back: np.ndarray, low: int, high: int, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Document's begin and end, begin and end of each stretch that may hold runs of periods low to high."""
    near = np.zeros(len(back) + 2, dtype=np.int8)
    near[1:-1] = back <= high
    change = np.diff(near)
    a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    least = LEAST_WORDS - 1 if low == 1 else (LEAST_PERIODS - 1) * low
    a, b = a[b - a >= least], b[b - a >= least]
    doc = np.searchsorted(first, a, side="right") - 1
    out: list[tuple[int, int, int, int]] = []
    for begin, end, at, to in zip(first[doc].tolist(), first[doc + 1].tolist(), a.tolist(), b.tolist(), strict=True):
        at = max(at - high, begin)
        if out and out[-1][0] == begin and out[-1][3] >= at:
            at = out.pop()[2]
        out.append((begin, end, at, to))
    return out


def seeds(ids: np.ndarray, begin: int, at: int, to: int, block: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of aligned blocks in at..to that occur again low to high words later, and the distances."""
    step = max(PIECE, block)
    for a in range(at, to, step):
        b = min(a + step + high + block, to)
        aligned = np.arange(begin + -(-(a - begin) // block) * block, min(a + step, to - block + 1), block)
        if not len(aligned):
            continue
        piece = ids[a:b].tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for j in (aligned - a).tolist():
            automaton.add_word(tuple(piece[j : j + block]), j)
        automaton.make_automaton()
        # All keys are of one length: one at most ends at each word.
        found = np.array(list(automaton.iter(tuple(piece))), dtype=np.int64).reshape(-1, 2)
        place, kind = found[:, 0] - block + 1, np.full(len(piece), -1)
        kind[place] = found[:, 1]
        span = len(piece) + high + 1
        keys = np.sort(found[:, 1] * span + place)
        own = aligned - a
        own = own[kind[own] >= 0]
        left = np.searchsorted(keys, kind[own] * span + own + low)
        n = np.searchsorted(keys, kind[own] * span + own + high, side="right") - left
        places = np.repeat(own, n)
        yield places + a, keys[ragged(left, n)] % span - places


def extended(ids: np.ndarray, place: int, d: int, begin: int, end: int) -> tuple[int, int]:
    """The maximal stretch of period d in begin..end around a word that is the same d words later."""
    right, size = place, 64
    while right + d < end:
        size = min(size, end - d - right)
        unlike = ids[right : right + size] != ids[right + d : right + d + size]
        if unlike.any():
            right += int(unlike.argmax())
            break
        right, size = right + size, 2 * size
    left, size = place, 64
    while left > begin:
        size = min(size, left - begin)
        unlike = ids[left - size : left] != ids[left - size + d : left + d]
        if unlike.any():
            left -= int(unlike[::-1].argmax())
            break
        left, size = left - size, 2 * size
    return left, right + d


def runs(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of documents that begin at first[0], first[1], ..., by start, then period."""
    found: dict[tuple[int, int], int] = {}
    back = distances(ids, first)
    longest = int(np.diff(first).max()) if len(first) > 1 else 0
    for block, low, high in scales(longest):
        starts = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(starts[:, 1])
        for begin, end, at, to in stretches(back, low, high, first):
            for place, d in seeds(ids, begin, at, to, block, low, high):
                run = np.searchsorted(starts[:, 0], place, side="right") - 1
                inside = (run >= 0) & (reach[run] >= place + d + block) if len(reach) else np.zeros(len(place), bool)
                place, d = place[~inside], d[~inside]
                # Aligned blocks in a row that repeat at one distance lie in one stretch.
                order = np.lexsort((place, d))
                place, d = place[order], d[order]
                head = np.ones(len(place), dtype=bool)
                head[1:] = (np.diff(d) != 0) | (np.diff(place) != block)
                last = (0, -1, -1)
                for i, q in zip(place[head].tolist(), d[head].tolist(), strict=True):
                    if last[0] == q and i + q < last[2]:
                        continue
                    a, b = extended(ids, i, q, begin, end)
                    last = (q, a, b)
                    if b - a >= max(LEAST_WORDS, LEAST_PERIODS * q):
                        found.setdefault((a, b), q)
    return sorted((a, b, q) for (a, b), q in found.items())


def _searcher(keep: list[str], reading: Callable | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                words = Words(batch.column("__text"))
                order = np.arange(len(words.start))
                if reading is not None:
                    bounds = words.first.tolist()
                    for i, key in enumerate(batch.column(keep[0]).to_pylist()):
                        a, b = bounds[i], bounds[i + 1]
                        read = reading(key, b - a)
                        if read is not None:
                            order[a:b] = a + read
                found = runs(coded(words)[order], words.first)
                gone = np.zeros(len(order) + 1, dtype=np.int64)
                doc = np.searchsorted(words.first, [a for a, _, _ in found], side="right") - 1
                listed: list[list[dict]] = [[] for _ in range(len(batch))]
                for i, (a, b, q) in zip(doc.tolist(), found, strict=True):
                    gone[a + q] += 1
                    gone[b] -= 1
                    listed[i].append({"start": a - int(words.first[i]), "length": b - a, "period": q})
                stay = np.cumsum(gone[:-1]) == 0
                raw, shas, texts = words.raw.tobytes(), [], []
                plain = np.arange(len(order))
                for i in range(len(batch)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if not listed[i] and np.array_equal(order[a:b], plain[a:b]):
                        text = b" ".join(raw[words.doc_at[i] : words.doc_at[i + 1]].split())
                    else:
                        left = order[a:b][stay[a:b]]
                        text = b" ".join([raw[p:q] for p, q in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)])
                    shas.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        texts.append(text)
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                arrays = [batch.column(c) for c in keep] + [pa.array(words.counts(), pa.int64()), pa.array(listed, pa.list_(kind)), pa.array(shas, pa.string())]
                names = [*keep, "n_words", "runs", "collapsed_sha256"]
                if with_text:
                    arrays.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("collapsed_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reading: Callable | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: the columns in `keep`, n_words, runs (start, length, period; by start, then period), collapsed_sha256.

    reading: reading(value of the first column of `keep`, n) gives the word numbers in the order in which a text of n words
    is read, or None. with_text: also collapsed_text, the words that stay joined by one space (empty for a null text).
    """
    given = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    results = ["n_words long", "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed_sha256 string"] + ["collapsed_text string"] * with_text
    return given.mapInArrow(tidy(_searcher(list(keep), reading, with_text)), ", ".join(fields + results))


def longest_run(listed: str = "runs"):
    """The run of greatest length (ties: least start, then period), null where there is none."""
    best = F.array_max(F.transform(listed, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("after"), (-r["period"]).alias("over"))))
    return F.when(best.isNotNull(), F.struct((-best["after"]).alias("start"), best["length"].alias("length"), (-best["over"]).alias("period")))
