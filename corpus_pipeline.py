"""A corpus pipeline of five stages, each a written table that the next reads.

quality (rejected documents go), near duplicates (one document of each class
stays), secrets (replaced in the text), mixing (sources to equal weights, by
copies), packing (sequences of tokens). Each stage but the last returns the
columns of `documents`; copies that mixing makes are rows that repeat.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, packing, quality, secrets
from tidemark.llm.common import shared_folder, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of label 1. The model learns from the labels of the input given."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rest = tuple(c for c in COLUMNS if c != "text")
    scored = quality.quality_scores(docs.withColumn("__copy", F.col("text")), model, keep=(*rest, "__copy"))
    return scored.where("predicted = 1").withColumnRenamed("__copy", "text").select(*COLUMNS)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs.select(*COLUMNS))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs.select(*COLUMNS))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers live through all stages beside an executor's full heap, and what the tokenizer remembers lives with them.
    return packing.pack(docs.select(*COLUMNS), with_ids=True, remembered=50_000, encoded_bytes=1 << 19)


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("secrets", _secrets), ("mixing", _mixing), ("packing", _packing)]

#: The classifier, the sketches and the tokenizer have no SQL form: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; tables between them are written under spark.checkpoint.dir."""
    small_batches(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
