"""Giving executors this package, so that they need not have it installed."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each SparkContext."""
    context = spark.sparkContext
    if not getattr(context, "_fjordframe_shipped", False):
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="fjordframe-package-")  # the driver serves the archive from here for as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(archive := f"{folder}/fjordframe.zip", "w") as z:
            for source in (root / "fjordframe").rglob("*.py"):
                z.write(source, source.relative_to(root))
        context.addPyFile(archive)
        context._fjordframe_shipped = True


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by executors that are given this package; a worker hands freed memory back when its task ends."""
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give this process's free memory back to the system, which workers that wait for tasks would else hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
