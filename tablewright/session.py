"""Session settings and the scratch folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Settings every job here relies on; anything the cluster already sets wins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "").startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    root = spark.conf.get(CHECKPOINT_CONF, "") or ""
    if root:
        return root
    if not _is_local(spark):
        raise ValueError(
            f"set {CHECKPOINT_CONF} to a folder that every executor can reach; "
            "a machine-local folder does not survive the loss of an executor"
        )
    root = tempfile.mkdtemp(prefix="tablewright-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give MLlib's iterative trainers a place to cut their lineage."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this library from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_dir`` named, in whatever file system it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
