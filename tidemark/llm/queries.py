"""The operators of this subpackage applied to whole tables."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, decontaminate, html, mixing, neardup, packing, periodic, quality, repeats, secrets, topk
from .common import small_batches
from .common import table as _table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).withColumn("held_out", quality.held_out()).select("doc_id", "held_out", "score", "predicted")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), remembered=1_000_000)


def _looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """One document in ten (by the CRC-32 of its id; none of null id) ends in a loop of its own words."""
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    read = np.arange(n)
    read[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return read


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), reading=_looped)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = found.withColumn("best", periodic.longest_run())
    exponent = F.expr("1000 * best.length DIV best.period").alias("exponent_milli")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", exponent, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_chat, op2_substring, op3_quality, op4_topk, op5_html, op6_mixing, op7_minhash, op8_ann, op9_secrets, op10_packing, op11_periodic, op12_audit, op13_decontaminate)}

ORACLE_SQL = {"op1_chat": chat.SQL, "op4_topk": topk.SQL, "op6_mixing": mixing.SQL, "op12_audit": audit.SQL, "op13_decontaminate": decontaminate.SQL}
