"""How five filters overlap and what each is worth, from Walsh-Hadamard sums.

A document's failures are a mask of five bits. For each part (source) and label
class the 32 signed parity sums of the masks are aggregated, sum over documents
of (-1)^popcount(s & mask), and the transform is inverted exactly to the number
of documents of each mask. All orders of the filters follow from those 32 cells:
a step removes the masks that hold its bit and none of the earlier bits, and the
sum of a filter's removals over all 120 orders is 120 / popcount(mask) for each
document that fails it.

Documents are narrowed to (doc_id, part, digest, mask) before anything is
shuffled, and equal rows are counted before each join or window, so neither a
hot part nor a group of copies is one task's. A to D follow from the text alone;
E needs the least doc_id of each text, found from one row per text, part and
label class.

Null text is empty text, and identical to it. Null and empty sources are one
part. A null doc_id has no label, is not smaller than another and never fails E.
Rows that repeat count as often as they stand; the same doc_id is not smaller
than itself. A doc_id labelled several times has a mark that any of its rows
gives. Empty tables have no parts; extra columns take no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
#: Bounds of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failed(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), mask: bits 0 to 3 are filters A to D failed."""
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select("*", F.split(F.btrim("text", F.lit(_SPACES)), r"[\x20\x09-\x0D]+").alias("words"))
    size = F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words"))
    counted = words.select("doc_id", "part", "text", size.alias("n"), F.when(size == 0, 0).otherwise(F.size(F.array_distinct("words"))).alias("unlike"))
    points = F.length("text")
    capitals = points - F.length(F.translate("text", _CAPITALS, ""))
    fails = [F.col("n") < LEAST_WORDS, 100 * F.col("unlike") < LEAST_DISTINCT * F.col("n"), 100 * capitals > MOST_CAPITALS * points, F.col("text").rlike(MARKS)]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return counted.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask (all five bits), n: documents counted by what they fail."""
    rows = failed(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("marked")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows of null doc_id would meet in one task of an outer join: they go by their text and match nothing.
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest")))
    known = keyed.join(marks, (F.col("key") == F.col("marked")) & F.col("doc_id").isNotNull(), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    # A doc_id stands once in each of these groups, so the least one's own count is at hand.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    grouped = known.select("doc_id", "digest", "part", flag("good"), flag("toxic"), "mask", "n").groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), least)
    first = F.min("least.doc_id").over(W.partitionBy("digest"))
    copies = grouped.withColumn("again", F.col("named") - F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("again")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("again").alias("n")))).alias("cell")
    return copies.select("part", "good", "toxic", both).select("part", "good", "toxic", "cell.mask", "cell.n").where("n > 0")


def _sign(s: Column | int, mask: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(s)) % 2)


def parity_sums(counted: DataFrame) -> DataFrame:
    """part, label (all, good, toxic), sums: the 32 signed parity sums of each."""
    label = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))))).alias("label")
    rows = counted.select("part", "mask", "n", label)
    sums = [F.sum(F.col("n") * _sign(s, F.col("mask"))).alias(f"s{s}") for s in range(CELLS)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[F.col(f"s{s}") for s in range(CELLS)]).alias("sums"))


def _over_cells(term) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda total, m: total + term(m))


def cells(sums: DataFrame) -> DataFrame:
    """part, all_cells, good_cells, toxic_cells: the number of documents of each mask, by the inverse transform."""
    inverse = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.shiftright(_over_cells(lambda s: F.get("sums", s) * _sign(s, m)), 5))
    one = sums.select("part", "label", inverse.alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    return one.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == label, F.col("cells"))), none).alias(f"{label}_cells") for label in ("all", "good", "toxic")])


def orders(parts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, evaluated on the cells."""
    bit_of = lambda order, i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring(order, i, F.lit(1))) - 1)
    every = F.sequence(F.lit(1), F.lit(len(FILTERS)))

    def steps(order: Column) -> Column:
        """Of each step: its number, its filter's bit, the bits of the filters before it."""
        before = lambda i: F.aggregate(every, F.lit(0), lambda x, j: x + F.when(j < i, bit_of(order, j)).otherwise(0))
        return F.transform(every, lambda i: F.struct(i.alias("step"), bit_of(order, i).alias("bit"), before(i).alias("before")))

    rows = parts.select("*", F.explode(F.array(*map(F.lit, _ORDERS))).alias("filter_order"))
    rows = rows.select("*", F.inline(steps(F.col("filter_order"))))

    def total(label: str, chosen, weight=lambda m: F.lit(1)) -> Column:
        return _over_cells(lambda m: F.when(chosen(m), F.get(f"{label}_cells", m) * weight(m)).otherwise(0))

    has = lambda m: m.bitwiseAND(F.col("bit")) != 0
    spared = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: has(m) & spared(m)
    # 120 orders, in 1/popcount of which the filter comes first among those that a document fails.
    share = lambda m: F.get(F.array(*[F.lit(x) for x in (0, 120, 60, 40, 30, 24)]), F.bit_count(m))
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: ~has(m) & spared(m)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: has(m) & ~spared(m)).alias("redundant"),
        total("all", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", has, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over `docs` (doc_id, text, source), with `labels` (doc_id, quality, toxic)."""
    return orders(cells(parity_sums(masks(docs, labels))))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT t.part, coalesce(m.good, FALSE) AS good, coalesce(m.toxic, FALSE) AS toxic,
    len(t.words) < 50 AS a, 100 * len(list_distinct(t.words)) < 65 * len(t.words) AS b,
    100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) AS c, regexp_matches(t.text, '[#$%&*|]') AS d,
    coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t.text), FALSE) AS e
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY ALL),
steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
    list_sum([1 << (instr('ABCDE', filter_order[i]) - 1) FOR i IN range(1, step)]) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
placed AS (
  SELECT m.part, s.filter_order, s.step, m.n, m.good, m.toxic, m.mask, s.bit, (m.mask & s.bit) <> 0 AS fails, (m.mask & coalesce(s.before, 0)::INT) = 0 AS here
  FROM masks m, steps s),
walked AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, coalesce(sum(n) FILTER (NOT fails AND here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND here), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND here), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM walked
"""
