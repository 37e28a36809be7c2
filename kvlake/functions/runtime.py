"""Code for executors."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once a session."""
    context = spark.sparkContext
    if getattr(context, "_kvlake_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parents[2]
    held = tempfile.mkdtemp(prefix="kvlake-code-")
    atexit.register(shutil.rmtree, held, ignore_errors=True)
    with zipfile.ZipFile(path := f"{held}/kvlake-code.zip", "w") as out:
        for file in sorted(root.glob("kvlake/**/*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(path)
    context._kvlake_shipped = True
