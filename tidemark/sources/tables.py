"""Sources and sinks: Parquet tables, bar rows, the partitioned feature table and JSON lines."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def instant(df: DataFrame, c: str) -> Column:
    """The column as an instant: times without zone are UTC, whatever the session's zone is."""
    if isinstance(df.schema[c].dataType, T.TimestampNTZType):
        return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`))")
    return F.col(c)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-lines scan of a declared schema; lines that don't parse become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def bars_between(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Bars that open in the closed range; the filter reaches the scan."""
    return bars.where(F.col("ts").between(start, end))


def newest_bars(bars: DataFrame, symbol: str, n: int) -> DataFrame:
    return bars.where(F.col("symbol") == symbol).orderBy(F.desc("ts")).limit(n)


def bars_from_rows(rows: DataFrame, step_ms: int) -> DataFrame:
    """Rows (symbol, row: array of open ms, open, high, low, close, volume) to typed bars; malformed ones are left out."""
    at = lambda i: F.try_element_at("row", F.lit(i)).cast("double")
    typed = rows.select("symbol", at(1).cast("long").alias("open_ms"), *[at(i + 2).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))])
    return typed.where((F.col("open_ms") > 0) & (F.col("close") > 0)).select(
        "symbol", F.timestamp_millis("open_ms").alias("ts"), "open", "high", "low", "close", "volume", F.timestamp_millis(F.col("open_ms") + (step_ms - 1)).alias("close_ts")
    )


def append_features(features: DataFrame, path: str) -> None:
    """Feature rows (symbol, tf, ts, ...) appended to a table that is partitioned, so scans prune."""
    features.write.mode("append").partitionBy("symbol", "tf").parquet(path)


def read_features(spark: SparkSession, path: str, symbol: str, tf: str, start: Column, end: Column) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).where((F.col("symbol") == symbol) & (F.col("tf") == tf) & F.col("ts").between(start, end))


def last_features(spark: SparkSession, path: str, symbol: str, tf: str, n: int) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).where((F.col("symbol") == symbol) & (F.col("tf") == tf)).orderBy(F.desc("ts")).limit(n)


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("symbol", "tf").agg(F.count("*").alias("rows"))


def with_all_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union over the columns of both."""
    return a.unionByName(b, allowMissingColumns=True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to spark.checkpoint.dir: what follows starts from there. A local session without one gets a folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = context.getConf().get("spark.checkpoint.dir")
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
