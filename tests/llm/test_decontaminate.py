"""Benchmark decontamination against a search of every window in every document."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dc

DOCS = "doc_id long, text string, id long, twin long, n_words long, place long, shingle long, rows long"
ITEMS = "item_id long, text string, words string, width int, id long"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def plain(docs, items):
    windows = [(i, w[a : a + 10]) for i, t in items for w in [words(t)] if w for a in range(max(len(w) - 9, 1))]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for i, v in windows:
            for a in range(len(w) - len(v) + 1):
                if w[a : a + len(v)] == v:
                    hit |= set(range(a, a + len(v)))
                    found |= {str(i)} - {"None"}
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in items], ITEMS)
    rows = dc.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def odd_cases():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)] + ["É", "straße", "数据", "x1"]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(11, 40)))) for i in range(12)]
    items += [(20, items[0][1]), (20, "Other words, of the same ID: " + " ".join(make(9))), (21, " ".join(make(10))), (22, "one two three"), (23, "rare-word"), (24, "Solo"), (25, None), (26, ""), (27, " !? "), (None, " ".join(make(12)))]
    items += [(30, "a " * 30), (31, "a b " * 12), (32, items[3][1].upper())]
    docs = []
    for i in range(40):
        t = make(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(items)[1] or ""
            v = v.split()
            a = rng.randint(0, max(len(v) - 12, 0))
            at = rng.randint(0, len(t))
            t[at:at] = v[a : a + rng.randint(8, 30)]
        docs.append((i, rng.choice([" ", ", ", "\x00", "-"]).join(t)))
    docs += [(50, None), (51, ""), (52, "..."), (53, "SOLO"), (53, "SOLO"), (53, "one two three"), (54, "a " * 200), (55, "b a " * 9), (None, items[2][1]), (None, items[2][1]), (None, None), (56, (items[4][1] + " zz ") * 400)]
    return docs, items


def test_contamination_is_the_search_of_every_window(spark):
    docs, items = odd_cases()
    got = found(spark, docs, items)
    assert got == plain(docs, items)
    assert sum(r[5] for r in got) > 15 and not all(r[5] for r in got)


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(dc, "FILTER_BITS", 7)
    docs, items = odd_cases()
    assert found(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b c")]), ([(1, "a b c"), (2, None)], []), ([], []), ([(1, "a b c")], [(1, None), (2, " ")])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == plain(docs, items)


def test_contamination_sql_on_odd_rows():
    docs, items = odd_cases()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, contaminated FROM ({dc.SQL})").fetchall()
    assert sorted(got, key=repr) == sorted(((*r[:4], r[5]) for r in plain(docs, items)), key=repr)


def test_each_window_goes_by_its_rarest_shingle(spark):
    docs = spark.createDataFrame([(i, "a b c d e f") for i in range(5)] + [(9, "b c d e f g h i j k")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    (row,) = dc.prefixes(docs, dc.windows(items)).collect()
    terms = dc.Terms(pa.array(["a b c d e f g h i j"]))
    at, h = terms.shingles(5)
    counts = [5, 6, 1, 1, 1, 1]  # of the shingles from a, b, c, ... on
    assert counts[row.place] == 1 and row.shingle == int(h.view(np.int64)[row.place]) and bytes(row.words) == b"a b c d e f g h i j" and row.n == 10


def test_hits_are_the_occurrences(spark):
    docs = spark.createDataFrame([(1, "x y. One, two; THREE x one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    _, hits, _ = dc.occurrences(docs, items)
    assert sorted(tuple(r) for r in hits.select("id", "start", "n", F.col("words").cast("string")).collect()) == [(1, 2, 3, "one two three"), (1, 6, 3, "one two three")]
