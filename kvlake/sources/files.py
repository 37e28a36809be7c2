"""Foreign log, write-ahead-log and segment files as change logs.

Framing can't be split, so a file is one task; ``binaryFile`` brings it from whatever store Spark reads.  Roll files to
get parallelism.  ``register`` also offers the formats as ``spark.read.format("kvlog" | "kvwal")`` for local files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from kvlake.functions import codec
from kvlake.functions.runtime import ship
from kvlake.schema import BATCH_END, DELETE

#: Records that a task holds as rows at a time.
ROWS = 10_000
FILE_SCHEMA = "file string, seq long, offset long, size int, op tinyint, key binary, value binary"


def _decoded(kind: str, data: bytes, on_corrupt: str):
    if kind == "kvsst":
        for op, key, value in codec.decode_segment(data):
            yield None, None, op, key, value
    else:
        yield from (codec.decode_log if kind == "kvlog" else codec.decode_wal)(data, on_corrupt)


def decode_files(files: DataFrame, kind: str = "kvlog", on_corrupt: str = "stop") -> DataFrame:
    """files: path and content.  Records of each up to its first bad one; see FILE_SCHEMA."""
    ship(files.sparkSession)

    def run(batches):
        import itertools

        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.int8(), pa.binary(), pa.binary())
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seq = _decoded(kind, data, on_corrupt), 0
                while chunk := list(itertools.islice(rows, ROWS)):
                    arrays = [pa.array([name] * len(chunk), pa.string()), pa.array(range(seq + 1, seq + len(chunk) + 1), pa.int64())]
                    arrays += [pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["file", "seq", "offset", "size", "op", "key", "value"])
                    seq += len(chunk)

    return files.select("path", "content").mapInArrow(run, FILE_SCHEMA)


def read_files(spark: SparkSession, path: str, kind: str = "kvlog", on_corrupt: str = "stop") -> DataFrame:
    """Records of all files under ``path``."""
    return decode_files(spark.read.format("binaryFile").load(path), kind, on_corrupt)


def encode_files(log: DataFrame, records: int = 4096, kind: str = "kvlog") -> DataFrame:
    """path and content of files that hold ``records`` LSNs each, encoded where the records are.

    Write-ahead logs end with the mark of a closed batch.
    """
    ship(log.sparkSession)

    def run(table):
        import pyarrow as pa

        rows = table.sort_by("lsn").to_pylist()
        if kind == "kvwal":
            data = b"".join(codec.encode_wal(r["op"], r["key"], r["value"] or b"") for r in rows) + codec.encode_wal(BATCH_END)
        else:
            data = b"".join(codec.encode_log(r["key"], None if r["op"] == DELETE else r["value"]) for r in rows)
        return pa.table({"path": pa.array([f"{rows[0]['file']:012d}.{kind[2:]}"]), "content": pa.array([data], pa.binary())})

    framed = log.select("lsn", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.expr(f"lsn div {records}").alias("file"))
    return framed.groupBy("file").applyInArrow(run, "path string, content binary")


def encode_segments(state: DataFrame, group: str) -> DataFrame:
    """path and content of segment files, one for each value of column ``group``; state: op, key (unique) and value."""
    ship(state.sparkSession)

    def run(table):
        import pyarrow as pa

        rows = table.sort_by("key").to_pylist()
        data = codec.encode_segment([(r["key"], None if r["op"] == DELETE else r["value"]) for r in rows], expected=max(len(rows), 1))
        return pa.table({"path": pa.array([f"{rows[0]['file']}.sst"]), "content": pa.array([data], pa.binary())})

    framed = state.select("op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col(group).cast("string").alias("file"))
    return framed.groupBy("file").applyInArrow(run, "path string, content binary")


def get_in_segments(files: DataFrame, key: bytes) -> DataFrame:
    """path, op and value of a key in segment files (path, content): by filter, index and one block of each."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(name, got) for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (got := codec.segment_get(data, key))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([g[0] for _, g in found], pa.int8()), pa.array([g[1] for _, g in found], pa.binary())], names=["path", "op", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, op tinyint, value binary")


def closed(records: DataFrame) -> DataFrame:
    """Records of batches that were closed: those before the last mark of their file, without the marks."""
    marks = records.where(F.col("op") == BATCH_END).groupBy("file").agg(F.max("seq").alias("_until"))
    return records.where(F.col("op") != BATCH_END).join(marks, "file").where(F.col("seq") < F.col("_until")).drop("_until")


def with_lsn(records: DataFrame) -> DataFrame:
    """Change log of records of several files: LSNs rise by file name, then by position.

    Only one row a file goes through the ordered window.
    """
    counts = records.groupBy("file").agg(F.max("seq").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return records.join(bases, "file").select((F.col("_base") + F.col("seq")).alias("lsn"), "op", "key", "value")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path, self.on_corrupt = kind, options["path"], options.get("oncorrupt", options.get("on_corrupt", "stop"))

    def partitions(self):
        import pathlib

        top = pathlib.Path(self.path.removeprefix("file://"))
        return [_File(str(p)) for p in (sorted(x for x in top.iterdir() if x.is_file() and x.name[0] not in "._") if top.is_dir() else [top])]

    def read(self, partition):
        import pathlib

        rows = _decoded(self.kind, pathlib.Path(partition.path).read_bytes(), self.on_corrupt)
        for seq, (offset, size, op, key, value) in enumerate(rows, 1):
            yield partition.path, seq, offset, size, op, key, value


class KvLog(DataSource):
    """Append-only logs; options path and onCorrupt (stop or fail)."""

    @classmethod
    def name(cls):
        return "kvlog"

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema):
        return _Reader(self.name(), self.options)


class KvWal(KvLog):
    """Write-ahead logs."""

    @classmethod
    def name(cls):
        return "kvwal"


class KvSst(KvLog):
    """Sorted segments."""

    @classmethod
    def name(cls):
        return "kvsst"


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (KvLog, KvWal, KvSst):
        spark.dataSource.register(source)
