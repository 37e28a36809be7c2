"""Shared plumbing of the training-data operators: durable cuts of lineage, table access, exact ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kvlake.functions.runtime import ship as ship_package

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Rows of a group that are ordered together.
CELL_ROWS = 1 << 18


def ship(spark: SparkSession) -> None:
    """Put this package on the Python path of the executors; they need no installation of it.

    Also bounds Arrow batches by bytes: texts differ in length by orders of magnitude, so rows say little about memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task and counts against its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package at hand; the worker's memory is released at the end of a task."""
    ship(df.sparkSession)

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(trimmed, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` (or a directory set on the context) wins.  Only where neither exists and all runs
    on one machine, as in tests, a temporary folder is made and removed again at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kvlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def forget_at_exit() -> None:
    """Delete what is left of all tables when the process ends."""
    spark = SparkSession.getActiveSession()
    if _WRITTEN and spark is not None:
        try:
            forget(spark)
        except Exception:  # noqa: BLE001  the session may be gone by then
            _WRITTEN.clear()


def forget(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote so far; results that read them must have been used."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    With ``by``, the last column, its values have folders of their own and a filter on it reads only some.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    # Parquet makes every column nullable; reading by schema spares the footer pass.
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def rank_in_groups(df: DataFrame, keys: list[str], order: list[Column], out: str, spread: Column, buckets: int) -> DataFrame:
    """Add ``out``: a gapless rank from 0 inside each ``keys`` group, without one task per group.

    Each group is cut into cells by ``spread`` (a long column that is the same for every evaluation): ``buckets`` of them,
    more if ``df`` has more than CELL_ROWS rows for each.  Rows are numbered inside their cell, cells get their base from a
    window over the cell counts, so a task sees about CELL_ROWS rows of any group, even if it holds all.
    """
    buckets = max(buckets, -(-df.count() // CELL_ROWS))
    cells = df.withColumn("_cell", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_kc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = cells.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_cell") == F.col("_kc")]
    joined = numbered.join(bases, on, "inner")
    return joined.withColumn(out, F.col("_base") + F.col("_r") - 1).select(*df.columns, out)
