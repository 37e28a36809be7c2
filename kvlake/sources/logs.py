"""Durable logs that can be appended to: batches of a change log, and a framed log with an index of its newest records.

A batch is written beside its place and moved there under the numbers of its first and last record, so it is there as a
whole or not at all, and a name says what it holds.  One writer at a time; a second one fails when it takes a number that
is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.expressions import log_frame, read_log_frame
from kvlake.operators.stats import record_size, running_offset
from kvlake.schema import CHANGELOG, DELETE, PUT
from kvlake.sources.segments import Changed, KVTable

FRAMES = "lsn long, offset long, size int, frame binary"


class _Batches:
    """Folders ``<first>-<last>`` under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def spans(self) -> list[tuple[int, int]]:
        """First and last number of every batch, oldest first."""
        place, fs = self._fs("")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(tuple(map(int, n.split("-"))) for n in names if not n.startswith("_"))

    def add(self, rows: DataFrame, first: int, last: int) -> None:
        pending, name = f"_pending-{uuid.uuid4().hex}", f"{first:020d}-{last:020d}"
        rows.write.parquet(f"{self.path}/{pending}")
        if [s for s in self.spans() if s[1] >= first]:
            raise Changed(f"{first} was taken by another writer")
        place, fs = self._fs(pending)
        if not fs.rename(place, self._fs(name)[0]):
            raise Changed(f"{name} was taken by another writer")

    def rows(self, schema, spans: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/{a:020d}-{b:020d}" for a, b in spans]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def drop(self, below: int) -> int:
        """Delete batches that end below a number, and what crashes have left; returns how many batches."""
        old = [s for s in self.spans() if s[1] < below]
        place, fs = self._fs("")
        left = [s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("_pending-")] if fs.exists(place) else []
        for name in [f"{a:020d}-{b:020d}" for a, b in old] + left:
            fs.delete(self._fs(name)[0], True)
        return len(old)


class ChangeLog:
    """A write-ahead log: batches of CHANGELOG rows with gapless LSNs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.batches = spark, _Batches(spark, path)

    def append(self, rows: DataFrame, order: str = "seq", limit: int | None = None) -> tuple[int, int] | None:
        """Append op, key and value in the order of a unique column; returns the first and last LSN once they are durable.

        With ``limit``, batches hold at most so many records.  Null where there are no rows.
        """
        ranked = running_offset(rows.withColumn("lsn", F.col(order).cast("long")), F.lit(1))
        base = max((b for _, b in self.batches.spans()), default=0)
        numbered = ranked.select((F.col("offset") + 1 + base).cast("long").alias("lsn"), F.col("op").cast("tinyint").alias("op"), F.col("key").cast("binary").alias("key"), F.when(F.col("op") == PUT, F.coalesce("value", F.lit(""))).cast("binary").alias("value"))
        count = rows.count()
        step = limit or max(count, 1)
        for at in range(0, count, step):
            low, high = base + at + 1, base + min(at + step, count)
            self.batches.add(numbered.where(F.col("lsn").between(low, high)), low, high)
        return (base + 1, base + count) if count else None

    def put(self, key: bytes, value: bytes) -> int:
        """One durable put; returns its LSN."""
        return self._one(PUT, key, value)

    def delete(self, key: bytes) -> int:
        """One durable deletion, also of a key that isn't there; returns its LSN."""
        return self._one(DELETE, key, None)

    def _one(self, op: int, key: bytes, value: bytes | None) -> int:
        row = self.spark.createDataFrame([(0, op, key, value)], "seq long, op tinyint, key binary, value binary")
        return self.append(row)[1]

    def read(self, after: int = 0) -> DataFrame:
        """All records with an LSN above ``after``; batches that end before it are not opened."""
        return self.batches.rows(CHANGELOG, [s for s in self.batches.spans() if s[1] > after]).where(F.col("lsn") > after)

    def truncate_before(self, lsn: int) -> int:
        """Drop the records below ``lsn``: whole batches are deleted, a batch that spans it is written again first."""
        spans = self.batches.spans()
        for low, high in spans:
            if low < lsn <= high:
                rest = self.batches.rows(CHANGELOG, [(low, high)]).where(F.col("lsn") >= lsn)
                pending = f"_pending-{uuid.uuid4().hex}"
                rest.write.parquet(f"{self.batches.path}/{pending}")
                source, fs = self.batches._fs(pending)
                # Both are there for a moment; a reader sees the same records twice, under the same LSNs.
                fs.rename(source, self.batches._fs(f"{lsn:020d}-{high:020d}")[0])
                fs.delete(self.batches._fs(f"{low:020d}-{high:020d}")[0], True)
        last = max((b for _, b in self.batches.spans()), default=0)
        dropped = self.batches.drop(lsn)
        if last and not self.batches.spans():
            # An empty batch keeps the number of the last record, from which LSNs go on.
            self.batches.add(self.spark.createDataFrame([], CHANGELOG), last, last)
        return dropped

    def flush_to(self, table: KVTable, threshold: int = 0) -> int | None:
        """Freeze, flush and truncate: once the log holds ``threshold`` bytes of newest rows, write them as a segment and
        drop the log up to them; returns the table's version, null below the threshold."""
        from kvlake.operators.stats import memtable_size

        log = self.read()
        last = max((b for _, b in self.batches.spans()), default=0)
        if not last or memtable_size(log).first()["byte_size"] < threshold:
            return None
        version = table.flush(log.where(F.col("lsn") <= last))
        self.truncate_before(last + 1)
        return version


class IndexedLog:
    """An append-only log of framed records with an index from each key to its newest record.

    The index is a segment table whose values are ``offset:size``.  An append adds the batch's newest keys as a segment and
    rewrites nothing; a lookup reads the index by bounds and Bloom filter, then the one frame at that offset.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.batches, self.index = spark, _Batches(spark, f"{path.rstrip('/')}/log"), KVTable(spark, f"{path.rstrip('/')}/index")

    def append(self, log: DataFrame, partitions: int | None = None) -> int:
        """Append a change log; returns the log's bytes.  The index follows the records, so none points beyond them."""
        end = max((b + 1 for _, b in self.batches.spans()), default=0)
        placed = running_offset(log, record_size())
        frames = placed.select("lsn", (F.col("offset") + F.lit(end)).cast("long").alias("offset"), F.col("size").cast("int").alias("size"), log_frame(F.col("op"), F.col("key"), F.col("value")).alias("frame"))
        size = log.agg(F.sum(record_size())).first()[0] or 0
        if size:
            self.batches.add(frames.repartitionByRange("offset").sortWithinPartitions("offset"), end, end + size - 1)
            self._index(self.batches.rows(FRAMES, [(end, end + size - 1)]), partitions)
        return end + size

    def _index(self, frames: DataFrame, partitions: int | None) -> None:
        read = frames.select("lsn", "offset", "size", read_log_frame(F.col("frame")).alias("_read")).where(F.col("_read.crc") == F.col("_read.computed"))
        entry = F.when(F.col("_read.op") == PUT, F.concat_ws(":", "offset", "size")).cast("binary")
        self.index.flush(read.select(F.col("_read.key").alias("key"), "lsn", F.col("_read.op").cast("tinyint").alias("op"), entry.alias("value")), partitions)

    def recover(self, partitions: int | None = None) -> None:
        """Index the records that a crash between log and index has left out; damaged ones are skipped."""
        known = self.index.manifest().agg(F.max("max_lsn")).first()[0] or 0
        missing = self.frames().where(F.col("lsn") > known)
        if not missing.isEmpty():
            self._index(missing, partitions)

    def frames(self) -> DataFrame:
        return self.batches.rows(FRAMES, self.batches.spans())

    def get(self, key) -> DataFrame:
        """key, state (FOUND, DELETED, ABSENT or CORRUPTED) and value of one key; the frame's checksum is verified."""
        entry = self.index.get(key.encode() if isinstance(key, str) else key).first()
        probe = self.spark.range(1).select(F.lit(key).alias("key"))
        if entry["state"] != "FOUND":
            return probe.select("key", F.lit(entry["state"]).alias("state"), F.lit(None).cast("binary").alias("value"))
        at = int(bytes(entry["value"]).split(b":")[0])
        spans = [s for s in self.batches.spans() if s[0] <= at <= s[1]]
        frame = self.batches.rows(FRAMES, spans).where(F.col("offset") == at).select(F.lit(key).alias("key"), read_log_frame(F.col("frame")).alias("_read"))
        good = sound(F.col("_read"), F.col("key"))
        return probe.join(frame.limit(1), "key", "left").select("key", F.when(good, "FOUND").otherwise("CORRUPTED").alias("state"), F.when(good, F.col("_read.value")).alias("value"))


def sound(read: Column, key: Column) -> Column:
    """Whether a frame read by read_log_frame is whole, of this key and equal to its checksum."""
    return F.coalesce((read["crc"] == read["computed"]) & (read["key"] == key.cast("binary")), F.lit(False))
