"""Rows kept for the several passes of one fit or one job."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import remove_folder, scratch_dir

#: Rows of a look-up table of a few numbers each that is sent to every task (some 30 MB).
BROADCAST_ROWS = 500_000
#: Estimated bytes per core up to which a table may have come as too few tasks and is worth a shuffle of all its columns.
SPREAD_BYTES = 32 << 20


def lookup(table: DataFrame, rows: int) -> DataFrame:
    """A look-up table for a join, broadcast when its counted size allows it.

    Spark cannot foresee the size of an aggregate, and would shuffle the large side of the
    join before it finds out.
    """
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read again: computed once, and nothing is kept on an executor."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_while(df: DataFrame, label: str):
    """A table written to the shared scratch folder, and removed from it at the end of the block."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """Small inputs on as many partitions as there are cores; anything larger is left as it is.

    Spark's own estimate of the size decides, so nothing is run to find out. What is shuffled is bounded by ``SPREAD_BYTES`` a core,
    whatever the size of the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate <= cores * SPREAD_BYTES else df


def keep(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist, on at least as many partitions as there are cores.

    A large input already has more partitions than that and is not shuffled; a small file
    that scans as one task is spread first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.persist(level)
    if held.rdd.getNumPartitions() < cores:
        held.unpersist()
        held = df.repartition(cores).persist(level)
    return held


def widened(df: DataFrame) -> DataFrame:
    """On at least as many partitions as there are cores, like ``keep``, but not kept."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@contextmanager
def persisted(df: DataFrame):
    held = keep(df)
    try:
        yield held
    finally:
        held.unpersist()


@contextmanager
def cached(df: DataFrame):
    """A small grouped result that several look-ups share, as it is partitioned."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()
