"""Schemas and operation codes shared by the whole engine."""

from pyspark.sql import types as T

PUT, DELETE, BATCH_END = 1, 2, 3

#: One row for each mutation.  ``lsn`` is stored and unique; ``value`` is null unless ``op`` is PUT.
CHANGELOG = T.StructType(
    [
        T.StructField("lsn", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)

#: Resolved state: one row for each live key.
KV = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False), T.StructField("lsn", T.LongType())])

#: One row for each immutable segment.
SEGMENT_META = T.StructType(
    [
        T.StructField("segment_id", T.StringType(), False),
        T.StructField("level", T.IntegerType()),
        T.StructField("min_key", T.BinaryType()),
        T.StructField("max_key", T.BinaryType()),
        T.StructField("n_entries", T.LongType()),
        T.StructField("n_tombstones", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("min_lsn", T.LongType()),
        T.StructField("max_lsn", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)
