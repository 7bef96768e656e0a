"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of a whole text's characters and words. Each
feature is cut into bins at quantiles. Cyclic boosting fits shallow trees to one
feature at a time and adds them to that feature's lookup table; the pairs whose
residuals gain most then get two-dimensional tables the same way. A score is the
sum of one table entry per feature and pair, through the logistic function.

Training takes a bounded sample of labelled rows (TRAIN_ROWS, those of smallest
id hash), so only that many feature rows reach the driver; the model is a few
kilobytes. Scoring is one map over all texts.

Null and empty texts have features of zero and are scored. Without both labels
in the training rows the score is the share of label 1 (one half if there are
none). Repeated rows score alike; a document labelled twice counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hashes, slices, tidy

#: The most labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
#: score >= THRESHOLD predicts label 1.
THRESHOLD = 0.3
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 24, 150, 80, 6, 0.1

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:", b"#$%&*@^~+=<>\\/_", b"|{}[]()", b"'\"-`", b"\n"), 1):
    for _c in _chars:
        _CLASS[_c] = _i
_CLASS[128:] = 10
_CLASSES = 11

FEATURES = (
    "log_words", "word_length", "upper", "lower", "digit", "exclaimed", "stops", "symbols", "brackets", "quotes", "lines", "beyond_ascii",
    "distinct_words", "same_as_before", "distinct_pairs", "distinct_fives", "closed_words", "long_words",
)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(texts)
    w = Words(texts)
    sizes = np.diff(w.doc_at)
    owner = np.repeat(np.arange(n), sizes)
    by_class = np.bincount(owner * _CLASSES + _CLASS[w.raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    words = w.counts()
    of = np.repeat(np.arange(n), words)
    long = w.end - w.start
    hashes = w.hashes()
    chars = np.maximum(sizes, 1)
    some = np.maximum(words, 1)
    out = [np.log1p(words), np.bincount(of, long, minlength=n) / some]
    out += [by_class[:, k] / chars for k in range(1, 11)]
    out.append(_distinct(hashes, of, n) / some)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out.append(np.bincount(of, same, minlength=n) / some)
    for k in (2, 5):
        grams = gram_hashes(hashes, k)
        inside = of[: len(grams)] == of[k - 1 :] if len(grams) else np.zeros(0, bool)
        own = of[: len(grams)][inside]
        out.append(_distinct(grams[inside], own, n) / np.maximum(np.bincount(own, minlength=n), 1))
    kind = _CLASS[w.raw[w.end - 1]] if len(w.end) else np.zeros(0, np.int64)
    out.append(np.bincount(of, (kind >= 3) & (kind <= 8), minlength=n) / some)
    out.append(np.bincount(of, long > 14, minlength=n) / some)
    return np.stack(out, axis=1).astype(np.float64)


def _extractor(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                x = features(batch.column("__text"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [values], names=[*keep, "features"])

    return run


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2, least: float = 4.0) -> np.ndarray:
    """The values that a shallow tree on one feature's bins predicts: greedy splits of the bin line."""
    values = np.zeros(len(grad))
    todo = [(0, len(grad), depth)]
    while todo:
        a, b, left = todo.pop()
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        if left and b - a > 1 and h[-1] > 2 * least:
            gl, hl = g[:-1], h[:-1]
            gain = gl**2 / (hl + 1) + (g[-1] - gl) ** 2 / (h[-1] - hl + 1)
            gain[(hl < least) | (h[-1] - hl < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > g[-1] ** 2 / (h[-1] + 1) + 1e-9:
                todo += [(a, a + k + 1, left - 1), (a + k + 1, b, left - 1)]
                continue
        values[a:b] = g[-1] / (h[-1] + 1)
    return values


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Best split of one axis, then of the other axis in each half; also its gain."""
    best, at = None, -1.0
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
        rows_g, rows_h = cg[-1] - cg, ch[-1] - ch

        def halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return a**2 / (b + 1) + (a[:, -1:] - a) ** 2 / (b[:, -1:] - b + 1)

        upper, lower = halves(cg, ch), halves(rows_g, rows_h)
        gain = upper.max(1) + lower.max(1)
        k = int(np.argmax(gain[:-1])) if len(gain) > 1 else 0
        if gain[k] > at:
            at = float(gain[k])
            v = np.zeros_like(g)
            for rows, a, b, j in ((slice(0, k + 1), cg[k], ch[k], int(np.argmax(upper[k]))), (slice(k + 1, None), rows_g[k], rows_h[k], int(np.argmax(lower[k])))):
                v[rows, : j + 1] = a[j] / (b[j] + 1)
                v[rows, j + 1 :] = (a[-1] - a[j]) / (b[-1] - b[j] + 1)
            best = v if axis == 0 else v.T
    return best, at


@dataclass
class AdditiveModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs with most gain left."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.cuts = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b, margin = model.bins(x), np.full(len(y), model.base)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = rest()
            step = RATE * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            margin += step[b[:, j]]

    def histogram(i: int, j: int, v: np.ndarray) -> np.ndarray:
        wide = len(model.tables[j])
        return np.bincount(b[:, i] * wide + b[:, j], v, len(model.tables[i]) * wide).reshape(-1, wide)

    g, h = rest()
    d = x.shape[1]
    ranked = sorted(((_pair_tree(histogram(i, j, g), histogram(i, j, h))[1], i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = rest()
            step = RATE * _pair_tree(histogram(i, j, g), histogram(i, j, h))[0]
            t += step
            margin += step[b[:, i], b[:, j]]
    return model


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits on at most `most` labelled rows that are not held out, those whose id hashes least."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("double").alias("__y"))
        .where(F.col("doc_id").isNotNull() & F.col("__y").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__y")
        .limit(most)
    )
    # `chosen` has at most `most` rows of two numbers, so sending it to all tasks is bounded.
    texts = docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(chosen), "doc_id").select("__y", "__text")
    got = texts.mapInArrow(tidy(_extractor(["__y"])), "__y double, features array<double>").toArrow()
    y = got.column("__y").to_numpy()
    x = got.column("features").combine_chunks()
    x = (x.flatten() if isinstance(x, pa.Array) else pa.chunked_array(x).combine_chunks().flatten()).to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T[::-1], y))  # the fit doesn't depend on the order rows arrive in
    return fit(x[order], y[order])


def _scorer(model: AdditiveModel, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                score = model.score(features(batch.column("__text")))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(score)], names=[*keep, "score"])

    return run


def quality_scores(docs: DataFrame, model: AdditiveModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, score (0 to 1) and predicted (score >= THRESHOLD), for each row of `docs`."""
    given = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + ["score double"])
    return given.mapInArrow(tidy(_scorer(model, list(keep))), schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
