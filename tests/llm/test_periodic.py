"""Runs of words against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, periodic, queries

DOCS = "doc_id long, text string, runs string, n_words long, start long, best string"


def plain_runs(w):
    """(start, length, period) by the definition."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1) if j == i else j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(w):
    ids = np.unique(np.array(w, dtype=str), return_inverse=True)[1] if w else np.zeros(0, int)
    return [(a, b - a, q) for a, b, q in periodic.runs(ids, np.array([0, len(w)]))]


def hard_words():
    rng = random.Random(3)
    out = [["a"] * n for n in (0, 1, 5, 6, 7, 64, 401)]
    for letters, n, times in (("ab", 60, 60), ("abc", 120, 40), ("ab", 400, 4)):
        out += [[rng.choice(letters) for _ in range(n)] for _ in range(times)]
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    out.append(list(b))
    for _ in range(150):  # loops of loops
        w = []
        while len(w) < 300:
            root = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 40))]
            w += (root * rng.randint(1, 9))[: rng.randint(1, 200)]
            if rng.random() < 0.3:
                w = w[: rng.randint(1, len(w))] * rng.randint(1, 5)
        out.append(w[:420])
    for m in range(2, 12):
        out.append((["a"] * m + ["b"]) * 9 + ["a"] * m)
    return out


def test_runs_are_those_of_the_definition():
    some = 0
    for w in hard_words():
        assert found(w) == plain_runs(w)
        some += bool(plain_runs(w))
    assert some > 100


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_lose_no_run(monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    for w in hard_words()[::3]:
        assert found(w) == plain_runs(w)


def test_documents_of_a_slice_are_apart():
    words = hard_words()[40:90]
    first = np.cumsum([0, *map(len, words)])
    ids = np.unique(np.array([x for w in words for x in w]), return_inverse=True)[1]
    want = sorted((a + int(first[i]), a + n + int(first[i]), q) for i, w in enumerate(words) for a, n, q in plain_runs(w))
    assert periodic.runs(ids, first) == want


def test_every_period_is_at_one_scale_with_room_for_its_block():
    seen = [q for _, low, high in periodic.scales(1 << 12) for q in range(low, high + 1)]
    assert seen == list(range(1, len(seen) + 1)) and len(seen) >= 1 << 10
    for block, low, high in periodic.scales(1 << 12):
        assert all(2 * block - 1 + q <= max(6, 4 * q) for q in range(low, high + 1))


def test_word_numbers_are_exact():
    words = common.Words(pa.array(["a b ab", None, "b\ta  é", "ab"]))
    assert periodic.coded(words).tolist() == [0, 1, 2, 1, 0, 3, 2]


def test_query_is_the_definition_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["x", "y", "zé", "w"]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randint(1, 700)))) for i in range(200, 260)]
    rows += [(300, None), (301, ""), (302, " \n\t\x0b"), (302, "a " * 9), (302, "a " * 9), (None, "b c " * 9), (None, None), (305, "long tail " + "ab cd ef\n" * 30_000), (304, "x\x00 " * 8)]
    spark.createDataFrame([(i, t, "r", 1, 2, "b") for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = [(2, 90_000, 3)] if i == 305 else plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *four, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed(w, runs))))
    assert zlib.crc32(b"305") % 10 and got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 15


def test_collapsed_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "go  on on on on on on\nnow", "r", 1, 2, "b"), (2, None, "r", 1, 2, "b")], DOCS)
    rows = periodic.periodic_runs(docs, with_text=True).orderBy("doc_id").collect()
    assert [r.collapsed_text for r in rows] == ["go on now", ""] and [tuple(x) for x in rows[0].runs] == [(1, 6, 1)]
    assert periodic.periodic_runs(docs.where("doc_id > 5")).select(F.size("runs")).count() == 0
