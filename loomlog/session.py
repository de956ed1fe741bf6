"""A session with the settings that the engine is tuned for; any existing session works as well."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "loomlog", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, and Parquet written for pruning. ``conf`` overrides any of it.

    On a cluster leave ``master`` to the submitter; shuffle partitions start high and adaptive execution merges them.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for files that a query writes and reads again: in the folder of ``spark.checkpoint.dir``, on this machine only where all tasks run on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomlog-")
    return f"{root.rstrip('/')}/loomlog/{label}-{uuid.uuid4().hex}"
