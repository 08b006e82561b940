"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does the runtime work (coalescing, skew splits, join switching).  Session
# windows merge inside each map task first so that one busy key does not send
# every raw row to one reducer.
# Generated methods above 8000 bytes are never compiled by the JVM, so wide rule
# projections run faster outside whole-stage code.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "fleetlens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without one: executors elsewhere would each write
    to a disk of their own, and rows would be missed when they are read again.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_and_read(df: DataFrame) -> DataFrame:
    """Cut lineage through a written table, which outlives any executor."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
