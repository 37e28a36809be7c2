"""Storage statistics, record sizes and offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvlake.operators.resolve import latest_per_key
from kvlake.schema import DELETE, PUT

#: Bytes of a log record before key and value, and of the value that marks a deletion in files.
HEADER, MARK = 12, 11
#: Rows that share an offset base; more rows make more bases, not a longer task.
CHUNK = 1 << 20


def _bytes(column: str) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def record_size() -> Column:
    """Bytes of a record on disk; a deletion stores its mark as the value."""
    return F.lit(HEADER) + _bytes("key") + F.when(F.col("op") == DELETE, F.lit(MARK)).otherwise(_bytes("value"))


def running_offset(log: DataFrame, size: Column, chunk: int = CHUNK) -> DataFrame:
    """Add ``size`` and ``offset``, the sum of the sizes before a record in LSN order, in two passes.

    Ranges of ``chunk`` LSNs are summed, a window over one row a range gives their bases, and offsets are completed
    inside each range; so no task orders the whole log.
    """
    return _running(log.withColumn("_chunk", F.expr(f"lsn div {chunk}")), size, "lsn")


def running_offset_by_key(rows: DataFrame, size: Column, chunk: int = CHUNK) -> DataFrame:
    """The same in the order of distinct keys, over key ranges of about ``chunk`` rows."""
    return _running(key_ranges(rows, chunk), size, "key")


def _running(chunked: DataFrame, size: Column, order: str) -> DataFrame:
    sized = chunked.withColumn("size", size)
    sums = sized.groupBy("_chunk").agg(F.sum("size").alias("_sum"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = sized.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(bases, "_chunk").withColumn("offset", F.col("_base") + F.col("_within")).drop("_chunk", "_base", "_within")


def key_ranges(rows: DataFrame, chunk: int = CHUNK, most: int = 4096) -> DataFrame:
    """rows of distinct keys with ``_chunk``, which rises with the key: ranges of about ``chunk`` rows, at most ``most``.

    The bounds come from the keys of the lowest hashes, 32 for each range; only those reach the driver.
    """
    parts = max(1, min(most, -(-rows.count() // chunk)))
    cuts = []
    if parts > 1:
        lowest = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(32 * parts).select("key")
        drawn = sorted(r["key"].encode() if isinstance(r["key"], str) else bytes(r["key"]) for r in lowest.collect())
        cuts = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)})
    if not cuts:
        return rows.withColumn("_chunk", F.lit(0))
    # Two steps of at most 64 comparisons each find the range.
    key = F.col("key").cast("binary")
    steps = [F.array(*map(F.lit, cuts[i : i + 64])) for i in range(0, len(cuts), 64)]
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
    step = below(F.array(*map(F.lit, cuts[::64]))) - 1
    stepped = rows.withColumn("_step", step)
    return stepped.withColumn("_chunk", F.when(F.col("_step") < 0, F.lit(0)).otherwise(F.col("_step") * 64 + below(F.get(F.array(*steps), F.col("_step"))))).drop("_step")


def record_offsets(log: DataFrame) -> DataFrame:
    return running_offset(log, record_size())


def build_index(log: DataFrame) -> DataFrame:
    """key, offset and size of every live key's newest record."""
    return latest_per_key(record_offsets(log)).where(F.col("op") == PUT).select("key", "offset", "size")


def stats(log: DataFrame) -> DataFrame:
    """live_keys, total_bytes, live_bytes, space_amplification (null without live bytes) and garbage_records.

    Sizes per key come from one aggregation; no join back to the log.
    """
    sized = log.withColumn("size", record_size())
    per_key = sized.groupBy("key").agg(F.sum("size").alias("_all"), F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("op", "size"), "lsn").alias("_last"))
    alive = F.col("_last.op") == PUT
    out = per_key.agg(
        F.count(F.when(alive, 1)).alias("live_keys"),
        F.coalesce(F.sum("_all"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(alive, F.col("_last.size"))), F.lit(0)).alias("live_bytes"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_records"),
    )
    return out.select("live_keys", "total_bytes", "live_bytes", F.expr("try_divide(double(total_bytes), double(live_bytes))").alias("space_amplification"), (F.col("_records") - F.col("live_keys")).alias("garbage_records"))


def needs_compaction(amplification: Column, threshold: float = 3.0) -> Column:
    return F.coalesce(amplification > threshold, F.lit(False))


def memtable_size(log: DataFrame) -> DataFrame:
    """length (keys, deleted ones count) and byte_size (key bytes plus current value bytes)."""
    return latest_per_key(log).agg(F.count(F.lit(1)).alias("length"), F.coalesce(F.sum(_bytes("key") + _bytes("value")), F.lit(0)).alias("byte_size"))


def lsn_high_water(log: DataFrame) -> DataFrame:
    return log.agg(F.max("lsn").alias("max_lsn"))


def sorted_violations(segment: DataFrame, order: str = "lsn", chunk: int = CHUNK) -> DataFrame:
    """Rows whose key isn't above that of the row before, in ``order``; ranges of rows are checked apart, then their edges."""
    ranged = segment.select(F.col(order).alias("_at"), "key").withColumn("_chunk", F.expr(f"_at div {chunk}"))
    inside = ranged.withColumn("_before", F.lag("key").over(Window.partitionBy("_chunk").orderBy("_at")))
    edges = ranged.groupBy("_chunk").agg(F.min_by("key", "_at").alias("key"), F.max_by("key", "_at").alias("_last"))
    edges = edges.withColumn("_before", F.lag("_last").over(Window.orderBy("_chunk")))
    return inside.select("key", "_before").unionByName(edges.select("key", "_before")).agg(F.count(F.when(F.col("key") <= F.col("_before"), 1)).alias("violations"))


def bloom_sizing(items: int, rate: float) -> dict[str, int]:
    """Bits, hash functions and serialized bytes of a filter for ``items`` keys at a false-positive ``rate``."""
    n = max(items, 1)
    bits = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    return {"bits": bits, "hashes": max(1, math.ceil(bits / n * math.log(2))), "bytes": 16 + 8 * ((bits + 63) // 64)}
