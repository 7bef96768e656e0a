"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions.

A chat log often stores a conversation again each time it grows. The turns of
each conversation are put in order, and a rolling hash (128 bits over the turns so
far, each with its place) is kept for every prefix. A conversation whose last hash is the
hash of a proper prefix of another is a snapshot of it: an anti-join removes it.
Of conversations with all turns equal the smallest id stays. What stays is
rendered as one text.

Order of turns: turn, role, text, nulls first. Repeated (turn, role, text) rows
of one conversation count once. A null role or text differs from an empty one in
the hashes; it is rendered as `unknown` and as nothing. Rows of null conv_id are
one conversation. Extra columns do not take part. A conversation is one output
row, so its turns meet in one task; only hashes, never texts, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _part(c: Column) -> Column:
    """Length and value, so that no two turns read alike; nulls have a mark of their own."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array in order): one row each."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list(turn)), _before).alias("turns"))


def prefix_hashes(convs: DataFrame) -> DataFrame:
    """conv_id, n, i, a, b: for each of a conversation's n turns the hashes (128 bits) of its first i.

    Each turn is hashed with its place, and a running exclusive or takes up one turn after the other, so a
    conversation costs its length.
    """
    placed = convs.select("conv_id", F.size("turns").alias("n"), F.posexplode("turns").alias("i", "t"))
    of = lambda seed: F.xxhash64(F.lit(seed), "i", _part(F.col("t.role")), _part(F.col("t.text")))
    rows = placed.select("conv_id", "n", (F.col("i") + 1).alias("i"), of("a").alias("a"), of("b").alias("b"))
    w = W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("conv_id", "n", "i", F.bit_xor("a").over(w).alias("a"), F.bit_xor("b").over(w).alias("b"))


def _before(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by turn, role and text, nulls first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.eqNullSafe(y), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)
    return out


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that are neither a proper prefix nor a later copy of another."""
    convs = conversations(turns)
    hashes = prefix_hashes(convs)
    key = ["i", "a", "b"]
    # Partial aggregation leaves one row per hash and map task, however many copies there are.
    prefixes = hashes.where("i < n").groupBy(*key).agg(F.lit(1).alias("one"))
    first = hashes.where("i = n").groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id")).alias("first"))
    kept = first.join(prefixes.select(*key), key, "left_anti").select(F.col("first.conv_id").alias("__conv"), F.lit(True).alias("__keep"))
    return convs.join(kept, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv", "__keep")


def render(turns: Column) -> Column:
    """<|role|>, a line end, the text, a line end, for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of each maximal conversation."""
    return maximal(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("text"))


#: The same for DuckDB, comparing whole prefixes instead of hashes.
SQL = """
WITH d AS (
  SELECT DISTINCT conv_id, turn::BIGINT AS turn, role, text FROM conversations
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM d GROUP BY conv_id
), p AS (
  SELECT DISTINCT turns[1:k] AS head FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)
), w AS (
  SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns
)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
  list_aggregate(list_transform(turns, lambda t: '<|' || coalesce(t.r, 'unknown') || '|>' || chr(10) || coalesce(t.t, '') || chr(10)), 'string_agg', '') AS text
FROM w WHERE turns NOT IN (SELECT head FROM p)
"""
