"""The filter interaction audit against a walk through all 120 orders in plain Python."""

import re
from itertools import permutations

import duckdb

from tidemark.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, digest string, n long"
LABELS = "doc_id long, quality int, toxic int, good boolean, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "p", 3, "d", 9) for i, t, s in rows], DOCS)


def marks(spark, rows):
    return spark.createDataFrame([(i, q, t, True, "p") for i, q, t in rows], LABELS)


def plain(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if any(j is not None and i is not None and j < i and (u or "") == text for j, u, _ in rows):
            fails.add("E")
        docs.append((source or "", i, fails))
    out = {}
    for part in {p for p, _, _ in docs}:
        mine = [(i, f) for p, i, f in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                before = len([1 for _, f in mine if x in f]) - len(gone)
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                unique = sum(f == {x} for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), before, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                key = part, "".join(order), step
                out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (3, LONG, "a"), (1, LONG, "a"), (None, LONG, "a"), (None, LONG, None), (4, "short Text #1", "a"), (9, "short Text #1", None), (5, None, ""), (6, "", None),
    (7, " \t\n\x0b\x0c\r ", "b"), (8, "same " * 80, "b"), (10, "Ünï code | \x1c x", "b"), (11, "A" * 30 + " b", "c"), (12, LONG * 3000, "c"), (None, None, None), (13, "x\x00y " * 60, "c"), (14, LONG + " A B C", "c"),
]
MARKS = [(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, 0, 0), (8, 1, None), (None, 1, 1), (9, None, 1), (99, 1, 1), (6, 1, 0)]


def test_audit_is_the_walk_through_all_orders(spark):
    assert found(audit.filter_audit(documents(spark, ROWS), marks(spark, MARKS))) == plain(ROWS, MARKS)


def test_audit_sql_agrees_on_odd_rows(spark):
    con = duckdb.connect()
    rows = [(i, t, s) for i, t, s in ROWS if not t or len(t) < 10_000]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", MARKS)
    got = con.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({audit.SQL})").fetchall()
    assert {r[:3]: r[3:] for r in got} == plain(rows, MARKS)


def test_audit_of_nothing(spark):
    assert audit.filter_audit(documents(spark, []), marks(spark, MARKS)).count() == 0
    assert found(audit.filter_audit(documents(spark, ROWS), marks(spark, []))) == plain(ROWS, [])


def test_parity_sums_invert_to_the_masks(spark):
    counted = spark.createDataFrame([("p", False, True, m, 7 * m + 1) for m in range(32)], "part string, good boolean, toxic boolean, mask int, n long")
    (row,) = audit.cells(audit.parity_sums(counted)).collect()
    assert row.all_cells == row.toxic_cells == [7 * m + 1 for m in range(32)] and row.good_cells == [0] * 32
