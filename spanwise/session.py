"""Session defaults and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Row-level joins against a unique side must still split a hot key when an
    # aggregation follows; the extra exchange is cheaper than one giant task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "spanwise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, a local master gets a fresh local folder; on a cluster that is an error, because
    every executor would write to its own disk and the readers would see a part of the data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            configured = context_dir.get()
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder no other run uses, below the shared one."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    For results that several consumers need (one row per trace, say): each of them would otherwise
    recompute the whole plan behind it. The table outlives executors and lets the readers prune.
    """
    spark = frame.sparkSession
    path = run_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
