"""Column expressions of the record formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvlake.functions.codec import MARK
from kvlake.schema import DELETE, PUT


def le32(n: Column) -> Column:
    """Four little-endian bytes of a number."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))


def log_crc(key: Column, value: Column) -> Column:
    """CRC-32 of a framed log record, all in the JVM."""
    key, value = key.cast("binary"), value.cast("binary")
    return F.crc32(F.concat(le32(F.octet_length(key)), le32(F.octet_length(value)), key, value))


def log_frame(op: Column, key: Column, value: Column) -> Column:
    """A framed log record as codec.encode_log writes it; a deletion has the mark as its value."""
    key = key.cast("binary")
    value = F.when(op == DELETE, F.lit(MARK)).otherwise(F.coalesce(value.cast("binary"), F.lit(b"")))
    return F.concat(le32(log_crc(key, value)), le32(F.octet_length(key)), le32(F.octet_length(value)), key, value)


def read_log_frame(frame: Column) -> Column:
    """struct<crc, computed, op, key, value> of a framed record: its checksum as stored and as computed; null if it is cut or too long."""
    part = lambda at, n: F.substring(frame, F.lit(at) if isinstance(at, int) else at, n)
    u32 = lambda at: F.conv(F.regexp_replace(F.hex(part(at, F.lit(4))), "(..)(..)(..)(..)", "$4$3$2$1"), 16, 10).cast("long")
    n_key, n_value, size = u32(5), u32(9), F.octet_length(frame)
    key, value = part(13, n_key.cast("int")), part((n_key + 13).cast("int"), n_value.cast("int"))
    gone = value == F.lit(MARK)
    read = F.struct(
        u32(1).alias("crc"), F.crc32(part(5, size - 4)).alias("computed"), F.when(gone, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        key.alias("key"), F.when(~gone, value).alias("value"),
    )
    return F.when((size >= 12) & (n_key + n_value + 12 == size), read)


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share at their start: the least position at which they differ."""
    n = F.least(F.length(a), F.length(b))
    positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(positions, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, n)
