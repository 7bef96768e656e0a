"""History that grows: rotated JSON-lines files read once each, and tables that resume where they end.

A log is appended to as NAME and rotated to NAME.1, NAME.2, ... so a path says
nothing about what was read of it. Its first line does: it never changes and goes
with the file. `RotatedLines` is a data source whose offsets are bytes read by
first line, so a batch of the stream is what was appended since the last one,
wherever it now lies. Files are split at line ends for parallel reading; lines are
parsed in the JVM.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.tables import cut

LINES = "line string, log string, at long"
#: Bytes of one task, and of the part of a file in which its first line must end.
TASK_BYTES, HEAD_BYTES = 64 << 20, 1 << 20
_BLOCK = 4 << 20


class Piece(InputPartition):
    """Bytes begin to end of the log whose first line has this digest; lines that begin there are its own."""

    def __init__(self, log: str, begin: int, end: int):
        self.log, self.begin, self.end = log, begin, end


class _Logs:
    """The files of a log and of its rotations, by the digest of their first line."""

    def __init__(self, options: dict[str, str]):
        self.where, self.at = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.task = int(options.get("taskbytes", TASK_BYTES))

    def found(self) -> dict[str, tuple[str, int]]:
        """Digest to (path, bytes up to the last line end). A file without a whole first line is not there yet."""
        folder, _, name = self.at.rpartition("/")
        out: dict[str, tuple[str, int]] = {}
        for info in self.where.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)):
            rest = info.base_name.removeprefix(name)
            if info.type != fs.FileType.File or not info.base_name.startswith(name) or rest and not (rest[0] == "." and rest[1:].isdigit()):
                continue
            with self.where.open_input_file(info.path) as f:
                head, line_end = f.read(HEAD_BYTES).partition(b"\n")[:2]
                if line_end:
                    log = hashlib.sha256(head).hexdigest()[:32]
                    size = self._whole(f, f.size())
                    if log not in out or size > out[log][1]:
                        out[log] = (info.path, size)
        return out

    @staticmethod
    def _whole(f: pa.NativeFile, size: int) -> int:
        """Where the last whole line ends."""
        while size:
            begin = max(0, size - _BLOCK)
            f.seek(begin)
            last = f.read(size - begin).rfind(b"\n")
            if last >= 0:
                return begin + last + 1
            size = begin
        return 0

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        out = []
        for log, to in sorted(end.items()):
            a = start.get(log, 0)
            out += [Piece(log, x, min(x + self.task, to)) for x in range(a, to, self.task)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        path = self.found()[piece.log][0]  # a rotation may have moved it since it was planned
        with self.where.open_input_file(path) as f:
            at = piece.begin
            if at:  # a line that begins before is the piece's before
                f.seek(at - 1)
                at += self._skip(f)
            f.seek(at)
            left = b""
            while at < piece.end:
                block = f.read(_BLOCK)
                if not block:
                    break
                rows, begins = [], []
                *whole, left = (left + block).split(b"\n")
                for line in whole:
                    if at >= piece.end:
                        break
                    rows.append(line.decode("utf-8", "replace"))
                    begins.append(at)
                    at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([piece.log] * len(rows), pa.string()), pa.array(begins, pa.int64())], names=["line", "log", "at"])

    @staticmethod
    def _skip(f: pa.NativeFile) -> int:
        """Bytes from the present place less one to the next line's begin."""
        n = 0
        while block := f.read(_BLOCK):
            k = block.find(b"\n")
            if k >= 0:
                return n + k
            n += len(block)
        return n


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Piece]:
        logs = _Logs(self.options)
        return logs.pieces({}, {log: size for log, (_, size) in logs.found().items()}) or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return _Logs(self.options).read(piece) if piece.end > piece.begin else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"logs": "{}"}

    def latestOffset(self) -> dict:
        return {"logs": json.dumps({log: size for log, (_, size) in sorted(_Logs(self.options).found().items())})}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _Logs(self.options).pieces(json.loads(start["logs"]), json.loads(end["logs"]))

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return _Logs(self.options).read(piece)

    def commit(self, end: dict) -> None:
        pass


class RotatedLines(DataSource):
    """Format rotated_lines: option path, the live file; columns line, log (digest of the file's first line), at (byte).

    Two files with the same first line are one log, of which the longer counts. Lines that have not ended yet wait.
    A log that was read and has since been deleted is no loss; one that is deleted before it was read is.
    """

    @classmethod
    def name(cls) -> str:
        return "rotated_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def rotated_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    spark.dataSource.register(RotatedLines)
    reader = spark.readStream if stream else spark.read
    return reader.format("rotated_lines").option("path", path).load()


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema` from JSON lines; a line that doesn't parse is a row of NULLs."""
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def newer(rows: DataFrame, stored: DataFrame, by: str = "symbol", on: str = "ts") -> DataFrame:
    """Rows of each key after the last one stored; of keys not stored yet all, each time once. Rows without key or time are left out."""
    marks = stored.groupBy(by).agg(F.max(on).alias("__last"))
    fresh = rows.where(F.col(by).isNotNull() & F.col(on).isNotNull()).dropDuplicates([by, on])
    return fresh.join(marks, by, "left").where(F.col("__last").isNull() | (F.col(on) > F.col("__last"))).drop("__last")


def resume(rows: DataFrame, path: str, by: str = "symbol", on: str = "ts") -> DataFrame:
    """Appends what is newer than the stored table (Parquet) to it; what was appended."""
    spark = rows.sparkSession
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except Exception as e:
        if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], rows.schema)
    fresh = cut(newer(rows, stored, by, on))  # what is stored changes under it
    fresh.write.mode("append").parquet(path)
    return fresh


def coverage(bars: DataFrame, width_s: int, at: Column | None = None) -> DataFrame:
    """symbol, bars, first_s, last_s, repeats, gaps, coverage_pct of a history of even bars, up to its last one."""
    t = F.unix_seconds("ts") if at is None else at
    counted = bars.select("symbol", t.alias("t")).where("symbol IS NOT NULL AND t IS NOT NULL").groupBy("symbol", "t").agg(F.count("*").alias("n"))
    step = F.col("t") - F.lag("t").over(W.partitionBy("symbol").orderBy("t"))
    out = counted.withColumn("wide", step > width_s * 1.5).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if("wide").alias("gaps"))
    expected = F.greatest(F.lit(1), F.floor((F.col("last_s") - F.col("first_s")) / width_s))
    return out.withColumn("coverage_pct", F.least(F.lit(100.0), 100 * F.col("bars") / expected))
