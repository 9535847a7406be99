"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.keep import lookup
from tablewright.session import scratch_dir

#: Bytes of an Arrow batch between Spark and a Python worker. Spark's own bound, 64 MB, is held several times over by each task, in the
#: executor outside its heap and in the worker, and the C library keeps much of that afterwards.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting that removes the shuffle files of a query at its end instead of when the driver's garbage is collected.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this library from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES``, unless the session has a bound of its own. What is read does not depend on it."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Tables written within the block leave no shuffle files behind, unless the session has a setting of its own."""
    if CLEANUP_CONF in spark.conf.getAll:
        yield
        return
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read again: lineage is cut, and a lost executor costs only its own tasks."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame) -> DataFrame:
    """A stored look-up table, broadcast if its counted rows allow it; otherwise Spark joins by shuffle."""
    return lookup(table, table.count())


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def doc_bucket(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column of an Arrow batch; nulls become empty."""
    column = batch.column(name)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    return column.fill_null("")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and the offsets of its rows in them."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def release() -> None:
    """Give memory that Arrow and the C library hold in reserve back to the system; a worker process lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` bytes of text, or one row if that is longer."""
    for batch in batches:
        _, offsets = byte_view(text_column(batch, text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    release()
