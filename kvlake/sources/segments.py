"""Tables of immutable sorted segments: flush, pruned reads and lookups, compaction, truncation and clean-up.

A table is a folder: ``segments/<id>`` holds Parquet files range-partitioned and sorted by key (zstd, Bloom filter on the
key), ``manifest/<version>`` a SEGMENT_META table.  A manifest is written beside its place and then moved there; it counts
once its ``_SUCCESS`` file exists.  So a change of many files is atomic, readers keep the version that they started with,
and what a crash leaves behind is never read and never in the way.  ``vacuum`` removes it.

Files are pruned by the bounds in the manifest.  Up to LISTED of them are named one by one; beyond that the whole folder
is read and cut to the manifest's files by a join, so no list that grows with the data reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators.resolve import latest_per_key, state_of
from kvlake.operators.stats import sorted_violations
from kvlake.schema import DELETE, PUT, SEGMENT_META

#: Files that the driver names one by one.
LISTED = 10_000
ROWS = "key binary, lsn long, op tinyint, value binary"


class Changed(RuntimeError):
    """Another writer has committed since this change began."""


class KVTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> list[str]:
        place, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()] if fs.exists(place) else []

    def _committed(self, name: str) -> bool:
        place, fs = self._fs(f"{self.path}/manifest/{name}/_SUCCESS")
        return fs.exists(place)

    def versions(self) -> list[int]:
        """Committed manifest versions, oldest first."""
        return sorted(int(n) for n in self._folders(f"{self.path}/manifest") if n.isdigit() and self._committed(n))

    def manifest(self, version: int | None = None) -> DataFrame:
        """SEGMENT_META of a version, by default the newest."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], SEGMENT_META)
        return self.spark.read.schema(SEGMENT_META).parquet(f"{self.path}/manifest/{known[-1] if version is None else version}")

    def _commit(self, meta: DataFrame, base: int | None) -> int:
        """Make ``meta``, a change of version ``base``, the newest version.  Numbers that a crash has left are skipped."""
        pending = f"{self.path}/manifest/_pending-{uuid.uuid4().hex}"
        meta.coalesce(1).write.parquet(pending)
        if (self.versions() or [None])[-1] != base:
            raise Changed(f"version {base} isn't the newest any more")
        version = max((int(n) for n in self._folders(f"{self.path}/manifest") if n.isdigit()), default=0) + 1
        source, fs = self._fs(pending)
        target, _ = self._fs(f"{self.path}/manifest/{version}")
        if not fs.rename(source, target) or not self._committed(str(version)):
            raise Changed(f"version {version} was taken")
        return version

    def _newest(self) -> int | None:
        return (self.versions() or [None])[-1]

    def _write(self, rows: DataFrame, level: int, partitions: int | None) -> DataFrame:
        """Write rows as one segment and describe it; one metadata row for each file is the pruning unit."""
        spread = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
        return self._store(spread.sortWithinPartitions("key"), level)

    def _store(self, ordered: DataFrame, level: int) -> DataFrame:
        segment = uuid.uuid4().hex
        target = f"{self.path}/segments/{segment}"
        ordered.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").parquet(target)
        written = self.spark.read.schema(ordered.schema).parquet(target).withColumn("path", F.col("_metadata.file_path"))
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        return written.groupBy("path").agg(
            F.lit(segment).alias("segment_id"), F.lit(level).alias("level"), F.min("key").cast("binary").alias("min_key"), F.max("key").cast("binary").alias("max_key"), F.count(F.lit(1)).alias("n_entries"),
            F.count(F.when(F.col("op") == DELETE, 1)).alias("n_tombstones"), F.sum(size).cast("long").alias("bytes"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"),
        ).select(*SEGMENT_META.names)

    def flush(self, memtable: DataFrame, partitions: int | None = None) -> int:
        """Write the newest rows of ``memtable`` (tombstones included) as a level-0 segment; returns the version."""
        base = self._newest()
        meta = self._write(latest_per_key(memtable), 0, partitions)
        return self._commit(self.manifest(base).unionByName(meta), base)

    def append_sorted(self, rows: DataFrame, partitions: int | None = None) -> int:
        """Write rows whose keys rise strictly with their LSN as a segment; ValueError, and no segment, if they don't."""
        if violations := sorted_violations(rows).first()[0]:
            raise ValueError(f"{violations} keys don't rise")
        base = self._newest()
        return self._commit(self.manifest(base).unionByName(self._write(rows, 0, partitions)), base)

    def _files(self, meta: DataFrame) -> DataFrame:
        """The rows of the files of ``meta``."""
        paths = meta.select("path").distinct()
        named = [r["path"] for r in paths.limit(LISTED + 1).collect()]
        if not named:
            return self.spark.createDataFrame([], ROWS)
        if len(named) <= LISTED:
            return self.spark.read.parquet(*named)
        rows = self.spark.read.parquet(f"{self.path}/segments/*")
        return rows.withColumn("_path", F.col("_metadata.file_path")).join(paths.withColumnRenamed("path", "_path"), "_path", "left_semi").drop("_path")

    def read(self, start=None, end=None, version: int | None = None) -> DataFrame:
        """All versions in the segments whose bounds meet [start, end); other files are never opened."""
        meta = self.manifest(version)
        if start is not None:
            meta = meta.where(F.col("max_key") >= F.lit(start).cast("binary"))
        if end is not None:
            meta = meta.where(F.col("min_key") < F.lit(end).cast("binary"))
        rows = self._files(meta)
        if start is not None:
            rows = rows.where(F.col("key") >= F.lit(start))
        return rows.where(F.col("key") < F.lit(end)) if end is not None else rows

    def get(self, key, version: int | None = None) -> DataFrame:
        """key, state (FOUND, DELETED or ABSENT) and value of one key: one row.

        Bounds choose at most one file a segment; in it, statistics and the Bloom filter of Parquet skip row groups.
        """
        there = F.lit(key).cast("binary")
        rows = self._files(self.manifest(version).where((F.col("min_key") <= there) & (F.col("max_key") >= there)))
        newest = latest_per_key(rows.where(F.col("key") == F.lit(key)))
        probe = self.spark.range(1).select(F.lit(key).alias("key"))
        found = probe.join(newest.select("key", "op", "value"), "key", "left")
        return found.select("key", state_of(F.col("op")).alias("state"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))

    def seek(self, target, version: int | None = None) -> DataFrame:
        """The newest row of the first key >= target, deleted or not; no row beyond the last key.

        In each segment only the first file that reaches up to the target is opened: it holds a key from there on.
        """
        reaching = self.manifest(version).where(F.col("max_key") >= F.lit(target).cast("binary"))
        first = reaching.groupBy("segment_id").agg(F.min_by("path", F.struct("max_key", "path")).alias("path"))
        rows = self._files(first).where(F.col("key") >= F.lit(target))
        return latest_per_key(rows).orderBy("key").limit(1)

    def compact(self, partitions: int | None = None) -> int:
        """Merge all segments into one of level 1.  It is a full compaction, so deletions may be dropped; a partial one
        would let older versions of other segments return."""
        base = self._newest()
        merged = latest_per_key(self.read(version=base)).where(F.col("op") == PUT)
        return self._commit(self._write(merged, 1, partitions), base)

    def compact_level(self, level: int, partitions: int | None = None) -> int:
        """Merge the segments of one level into one of the next.  Other levels may hold older versions, so deletions stay."""
        base = self._newest()
        meta = self.manifest(base)
        own = meta.where(F.col("level") == level)
        if own.isEmpty():
            return base or 0
        merged = self._write(latest_per_key(self._files(own)), level + 1, partitions)
        return self._commit(meta.where(F.col("level") != level).unionByName(merged), base)

    def tiers(self, fan_in: int = 4) -> DataFrame:
        """Size-tiered policy: levels with ``fan_in`` segments or more, with their number and bytes."""
        segments = self.manifest().groupBy("level", "segment_id").agg(F.sum("bytes").alias("bytes"))
        return segments.groupBy("level").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes")).where(F.col("segments") >= fan_in)

    def truncate_before(self, lsn: int, partitions: int | None = None) -> int:
        """A new version without the records below ``lsn``; files that lie above it are kept as they are."""
        base = self._newest()
        meta = self.manifest(base)
        whole, cut = meta.where(F.col("min_lsn") >= lsn), meta.where((F.col("min_lsn") < lsn) & (F.col("max_lsn") >= lsn))
        if not cut.isEmpty():
            whole = whole.unionByName(self._write(self._files(cut).where(F.col("lsn") >= lsn), 0, partitions))
        return self._commit(whole, base)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` versions, segments that none of these names, and what crashes have left.

        Returns the number of deleted folders.  No writer may be at work, and readers of older versions lose their files.
        """
        known = self.versions()
        kept = known[-keep:] if keep else []
        named = {r["segment_id"] for v in kept for r in self.manifest(v).select("segment_id").distinct().collect()}
        old = [f"manifest/{n}" for n in self._folders(f"{self.path}/manifest") if not (n.isdigit() and int(n) in kept)]
        old += [f"segments/{n}" for n in self._folders(f"{self.path}/segments") if n not in named]
        for name in old:
            place, fs = self._fs(f"{self.path}/{name}")
            fs.delete(place, True)
        return len(old)


def prefix_compression(keys: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Bytes that front coding of sorted distinct keys saves and keeps: shared_bytes and suffix_bytes.

    The order runs over all keys in two passes: inside key ranges, then from the last key of a range to the first of the next.
    """
    from pyspark.sql.window import Window

    from kvlake.functions.expressions import shared_prefix
    from kvlake.operators.stats import key_ranges

    ranged = key_ranges(keys.select("key").distinct(), chunk)
    inside = ranged.withColumn("_before", F.lag("key").over(Window.partitionBy("_chunk").orderBy("key")))
    edges = ranged.groupBy("_chunk").agg(F.max("key").alias("_last")).select("_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_edge"))
    before = F.coalesce("_before", "_edge")
    joined = inside.join(edges, "_chunk").withColumn("_shared", F.when(before.isNull(), F.lit(0)).otherwise(shared_prefix(before, F.col("key"))))
    return joined.agg(F.sum("_shared").cast("long").alias("shared_bytes"), F.sum(F.length("key") - F.col("_shared")).cast("long").alias("suffix_bytes"))
