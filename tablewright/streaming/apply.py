"""Fitted feature steps on streams.

A fitted step is a projection of literals, so the function that prepares a batch table
prepares a stream as well, without state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.fitted import Fitted


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def apply_to_stream(stream: DataFrame, steps: Sequence[Fitted]) -> DataFrame:
    for step in steps:
        stream = step.transform(stream)
    return stream


def write_available(
    stream: DataFrame, path: str, checkpoint: str | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Process what is there, exactly once, and stop; run again for what arrives later.

    The checkpoint holds which files are done. By default it lies below the output, so that the next call goes on from it.
    """
    checkpoint = checkpoint or f"{path.rstrip('/')}/_checkpoint"
    return (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
