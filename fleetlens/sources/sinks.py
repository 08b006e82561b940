"""Report output and snapshot history, with or without committed runs (SNK1, SNK2)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a report, partitioned by controller where the rows carry one."""
    keyed = "controller_id" in df.columns
    writer = (df.hint("rebalance", "controller_id") if keyed else df).write.format(fmt).mode(mode)
    if keyed:
        writer = writer.partitionBy("controller_id")
    writer.save(path)


def append_snapshot(df: DataFrame, path: str, at: str = "snapshot_ts") -> None:
    """Append one collection run; readers prune by ``snapshot_date``.

    Rows are rebalanced by date first, so a date gets few files, and a date that
    holds most rows is split over several tasks.
    """
    (df.withColumn("snapshot_date", F.to_date(at)).hint("rebalance", "snapshot_date")
     .write.mode("append").partitionBy("snapshot_date").parquet(path))


def append_run(df: DataFrame, path: str, run_id: str, at: str = "snapshot_ts") -> None:
    """Append one collection run so that a retry adds nothing and half a run is never read.

    Rows go below a fresh attempt first; one line that names run and attempt
    commits them.  ``read_runs`` follows these lines, so an attempt that broke
    off, or that repeats a committed run, stays out of sight.
    """
    attempt = uuid.uuid4().hex
    (df.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt), "snapshot_date": F.to_date(at)})
     .hint("rebalance", "snapshot_date").write.mode("append").partitionBy("attempt", "snapshot_date").parquet(f"{path}/rows"))
    (df.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"),
                                     F.current_timestamp().alias("committed_at"))
     .write.mode("append").parquet(f"{path}/runs"))


def read_runs(spark: SparkSession, path: str, until: Column | None = None) -> DataFrame:
    """Rows of every committed run, of its first attempt; ``until`` leaves out runs committed later."""
    runs = spark.read.schema("run_id string, attempt string, committed_at timestamp").parquet(f"{path}/runs")
    if until is not None:
        runs = runs.filter(F.col("committed_at") <= until)
    first = runs.groupBy("run_id").agg(F.min(F.struct("committed_at", "attempt"))["attempt"].alias("attempt"))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(first, ["run_id", "attempt"], "left_semi").drop("attempt")
