"""Latest version of every key.  All functions are lazy and take change logs with columns key, lsn, op and value.

The key is the only shuffle key.  A predicate on it reaches the scan; one on ``op`` must come after resolution, since an
older version would otherwise come back to life.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvlake.schema import DELETE, PUT


def latest_per_key(log: DataFrame) -> DataFrame:
    """The newest row of every key, tombstones included.

    ``max_by`` combines before the shuffle, so a hot key sends one row a task, whatever its number of versions.
    """
    rest = [c for c in log.columns if c != "key"]
    newest = log.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct(*rest), "lsn").alias("_row"))
    return newest.select("key", *[F.col(f"_row.{c}").alias(c) for c in rest])


def ranked_versions(log: DataFrame) -> DataFrame:
    """All versions with ``version_rank``, 1 for the newest."""
    return log.withColumn("version_rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lsn"))))


def live(log: DataFrame) -> DataFrame:
    """Resolved state without deleted keys."""
    return latest_per_key(log).where(F.col("op") == PUT)


def as_of(log: DataFrame, lsn: int) -> DataFrame:
    """The live state after record ``lsn``."""
    return live(log.where(F.col("lsn") <= lsn))


def layered_raw(layers: list[DataFrame]) -> DataFrame:
    """Newest rows over layers (memtable, segments) in any order: records carry their LSN, so one aggregation resolves all."""
    union = layers[0]
    for layer in layers[1:]:
        union = union.unionByName(layer)
    return latest_per_key(union)


def layered(layers: list[DataFrame]) -> DataFrame:
    """Live state over layers."""
    return layered_raw(layers).where(F.col("op") == PUT)


def state_of(op: Column) -> Column:
    """FOUND, DELETED or ABSENT from the op of a probe's newest row."""
    return F.when(op == PUT, "FOUND").when(op == DELETE, "DELETED").otherwise("ABSENT")


def three_state_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (column key) with state and, where found, value.

    The log is cut to the probed keys before it is resolved; Spark broadcasts the probes where they are small.
    """
    newest = latest_per_key(log.join(probes.select("key").distinct(), "key", "left_semi")).select("key", "op", "value")
    return probes.join(newest, "key", "left").select("key", state_of(F.col("op")).alias("state"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def resurrected(log: DataFrame) -> DataFrame:
    """Keys with a PUT somewhere after a DELETE: two aggregates, no sort."""
    seen = log.groupBy("key").agg(F.min(F.when(F.col("op") == DELETE, F.col("lsn"))).alias("_gone"), F.max(F.when(F.col("op") == PUT, F.col("lsn"))).alias("_back"))
    return seen.where("_back > _gone").select("key")


def overwrite_delta(log: DataFrame) -> DataFrame:
    """Change of the value's bytes against the key's version before; a first version counts in full."""
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    before = F.lag(size).over(Window.partitionBy("key").orderBy("lsn"))
    return log.select("key", "lsn", (size - F.coalesce(before, F.lit(0))).alias("byte_delta"))
