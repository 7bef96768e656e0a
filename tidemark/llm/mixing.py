"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the mixture over its share of
the input. Each document draws its number of copies from a Poisson distribution
of that mean by inverting the distribution function at a uniform number hashed
from seed and id; it is then exploded by that count and the copies are dealt to
partitions by a hash and sorted by it inside, a global shuffle. Rates over
DRAW_MEAN are the sum of several independent draws, as Poisson variables add up,
so the table that is inverted stays short.

Size is counted in code points. A null source is a source of its own; a null
text has size 0 and is drawn like any other. Repeated rows draw alike, each for
itself. A source of little text has a high rate: from PART draws on, a row's draws
are dealt over tasks in parts of PART, whose copies are numbered from part x PART x
TERMS + 1 (so with gaps between parts). A source whose documents are all empty, and every source of an empty
input, has rate 0. Columns of the input are kept; `copy` (from 1), `rate` and
`mix_key` are added, replacing columns of those names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Largest mean that is drawn at once; terms beyond TERMS weigh less than 2**-52 there.
DRAW_MEAN, TERMS = 8.0, 60
#: Up to so many sources, the rates (two numbers and an array of TERMS each) go to all tasks.
BROADCAST_SOURCES = 20_000
#: Parts that each source is dealt over where rates are joined by a shuffle.
SALTS = 64
#: Draws of a row that one task makes at once.
PART = 1024


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of md5 over seed and parts, in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def distribution(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable: terms by recurrence, summed in order."""
    state = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        state,
        lambda s, k: F.struct((s["term"] * mean / k).alias("term"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["term"] * mean / k)).alias("sums")),
        lambda s: s["sums"],
    )


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0) -> DataFrame:
    """source, rate, draws, sums. Weights by source (others: default_weight) are scaled to the size of the input."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    weight = F.lit(float(default_weight))
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    weighed = sizes.where("size > 0").withColumn("weight", weight)
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    mean = F.col("rate") / F.col("draws")
    return (
        weighed.crossJoin(F.broadcast(total))  # one row
        .select("source", (F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).alias("rate"))
        .withColumn("draws", F.greatest(F.ceil(F.col("rate") / DRAW_MEAN), F.lit(1)))
        .withColumn("sums", distribution(mean))
    )


def copies_of(key: Column, seed: int, first: Column | None = None, last: Column | None = None) -> Column:
    """The number drawn for a row that has draws and sums, by the draws from first to last."""
    return F.aggregate(
        F.sequence(F.lit(1).cast("long") if first is None else first, F.col("draws") if last is None else last),
        F.lit(0),
        lambda n, k: n + F.size(F.filter("sums", lambda p: p <= uniform(seed, key, k))),
    )


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, seed: int = 17) -> DataFrame:
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("copy", "rate", "mix_key")]
    given = docs.select(*names)
    # A table of one row per source, written once; its size and its highest rate choose the joins.
    table = checkpointed(rates(given, weights, default_weight).withColumnRenamed("source", "__source"))
    sources, most = table.agg(F.count("*"), F.coalesce(F.max("draws"), F.lit(1))).first()

    def meet(rows: DataFrame, some: DataFrame) -> DataFrame:
        if sources <= BROADCAST_SOURCES:
            return rows.join(F.broadcast(some), F.col("source").eqNullSafe(F.col("__source")))
        # Each source is dealt over SALTS keys, and its one row of rates is repeated for each.
        left = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        right = some.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return left.join(right, F.col("source").eqNullSafe(F.col("__source")) & (left["__salt"] == right["__salt"]))

    shown = [*names, "rate", "__n", "__before"]
    zero = F.lit(0).cast("long")
    copied = meet(given, table.where(F.col("draws") <= PART)).withColumn("__n", copies_of(F.col("doc_id"), seed)).withColumn("__before", zero).select(*shown)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if most > PART:
        many = meet(given, table.where(F.col("draws") > PART)).withColumn("__part", F.explode(F.sequence(zero, F.expr(f"(draws - 1) div {PART}"))))
        many = many.repartition(parts, F.xxhash64("doc_id", "__part"))
        first = F.col("__part") * PART + 1
        drawn = copies_of(F.col("doc_id"), seed, first, F.least(first + (PART - 1), F.col("draws")))
        copied = copied.unionByName(many.withColumn("__n", drawn).withColumn("__before", F.col("__part") * (PART * TERMS)).select(*shown))
    copied = copied.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__n"))))
    keyed = copied.select(*names, "copy", "rate", F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "copy").cast("binary")).alias("mix_key"))
    return keyed.repartition(parts, "mix_key").sortWithinPartitions("mix_key")


#: The same for DuckDB, with equal weights.
SQL = """
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source HAVING sum(coalesce(length(text), 0)) > 0
), means AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), drawn AS (
  SELECT *, greatest(ceil(rate / 8.0), 1)::INTEGER AS draws FROM means
), terms AS (
  SELECT source, rate, draws, list_transform(range(0, 61), lambda j: exp(-rate / draws) * list_product(list_prepend(1.0::DOUBLE, list_transform(range(1, j + 1), lambda i: (rate / draws) / i)))) AS term FROM drawn
), sums AS (
  SELECT source, rate, draws, list_transform(range(1, 62), lambda j: list_sum(term[1:j])) AS sums FROM terms
), counted AS (
  SELECT d.*, s.rate, list_sum(list_transform(range(1, draws + 1), lambda k:
    len(list_filter(sums, lambda p: p <= ('0x' || md5('17|' || coalesce(d.doc_id::VARCHAR, '~') || '|' || k)[1:13])::BIGINT::DOUBLE / 4503599627370496.0)))) AS n
  FROM documents d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, round(rate, 9) AS rate,
  md5('mix17|' || coalesce(doc_id::VARCHAR, '~') || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy FROM counted WHERE n > 0)
"""
