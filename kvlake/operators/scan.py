"""Lookups and ordered scans; keys compare bytewise and ranges are half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.operators.resolve import latest_per_key, live


def _state(log: DataFrame, include_deleted: bool) -> DataFrame:
    return latest_per_key(log) if include_deleted else live(log)


def get(log: DataFrame, key) -> DataFrame:
    """The live value of one key, or no row.  The predicate reaches the scan, so only that key is resolved."""
    return live(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Live rows of the probed keys, one join whatever their number."""
    return live(log.join(probes.select("key").distinct(), "key", "left_semi"))


def multi_get_missing(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes without a live value (absent or deleted)."""
    return probes.select("key").join(multi_get(log, probes).select("key"), "key", "left_anti")


def range_scan(log: DataFrame, start, end=None, include_deleted: bool = False) -> DataFrame:
    """Keys in [start, end), sorted; without ``end`` unbounded.  Both bounds are pushed below the resolution."""
    within = F.col("key") >= F.lit(start)
    if end is not None:
        within &= F.col("key") < F.lit(end)
    return _state(log.where(within), include_deleted).orderBy("key")


def prefix_scan(log: DataFrame, prefix, include_deleted: bool = False) -> DataFrame:
    """Keys that begin with ``prefix``, as the range [prefix, successor)."""
    return range_scan(log, prefix, successor(prefix), include_deleted)


def successor(prefix):
    """The least key above all keys with this prefix; None if there is none."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    raw = raw.rstrip(b"\xff")
    if not raw:
        return None
    above = raw[:-1] + bytes([raw[-1] + 1])
    if isinstance(prefix, str):
        # The step must stay valid text: next code point instead of next byte.
        return prefix[:-1] + chr(ord(prefix[-1]) + (0x801 if prefix[-1] == "퟿" else 1)) if ord(prefix[-1]) < 0x10FFFF else successor(prefix[:-1])
    return above


def seek(log: DataFrame, target, include_deleted: bool = True) -> DataFrame:
    """The first key >= target (a top-1, not a sort)."""
    return _state(log.where(F.col("key") >= F.lit(target)), include_deleted).orderBy("key").limit(1)


def first_k(log: DataFrame, k: int, include_deleted: bool = False) -> DataFrame:
    return _state(log, include_deleted).orderBy("key").limit(k)


def bounds(log: DataFrame) -> DataFrame:
    """min_key and max_key over all records."""
    return log.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
