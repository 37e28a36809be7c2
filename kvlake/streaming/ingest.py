"""Streaming ingest of change logs and state that follows it.

Durability is the micro-batch: a batch is written under its number, so a batch that runs again after a crash replaces
itself.  Records carry their LSN, hence late or repeated ones resolve alike and no watermark is needed.

The limit of a batch is the source's: ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` on ``readStream`` (see ``source``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvlake.operators.resolve import latest_per_key


def source(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the change-log files under ``path``, at most ``files`` of them in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def ingest(log: DataFrame, target: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a streaming change log to ``target``/batch=<n>; without an interval, what is there now."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def follow_latest(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of every key in the state store and append each batch's changed keys to ``target``.

    ``current`` reads the state back; a batch written twice changes nothing, as the LSN decides.
    """
    rest = [c for c in log.columns if c != "key"]
    newest = log.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct(*rest), "lsn").alias("_row")).select("key", "_row.*")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, target: str) -> DataFrame:
    return latest_per_key(spark.read.parquet(target).drop("batch"))


def commit_batches(log: DataFrame, batch: int = 1024) -> DataFrame:
    """Group commit as relation: batch_id, records, first_lsn and last_lsn of every ``batch`` LSNs."""
    numbered = log.withColumn("batch_id", F.expr(f"(lsn - 1) div {batch}"))
    return numbered.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))
