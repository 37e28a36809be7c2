"""Change logs of the test tables; keys and values are strings, so SQL engines compare them alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.schema import DELETE, PUT


def events_of(events: DataFrame) -> DataFrame:
    gone = F.col("event_type") == "error"
    return events.select(
        F.format_string("user:%05d", "user_id").alias("key"),
        (F.col("event_id") + 1).alias("lsn"),
        F.when(gone, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        F.when(~gone, F.col("props")).alias("value"),
    )


def events_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes are the error events, all others put their properties under the user."""
    return events_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def orders_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put an order; the LSN is the order key, which is unique and rising."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.format_string("order:%08d", "o_orderkey").alias("key"), F.col("o_orderkey").alias("lsn"), F.lit(PUT).alias("op"), F.col("o_orderstatus").alias("value"))


def conversations_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.format_string("conv:%08d/%05d", "conv_id", "turn").alias("key"), F.col("turn").alias("lsn"), F.lit(PUT).alias("op"), F.col("text").alias("value"))
