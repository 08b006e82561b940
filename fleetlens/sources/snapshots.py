"""Deployment logs, manifests, inventory, host facts and file listings (SRC5-SRC10)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.schemas import INVENTORY
from fleetlens.sources.documents import folder_of
from fleetlens.sources.listing import follow_files, list_tree

LOG_SCHEMA = "cluster_name STRING, file STRING, line_no BIGINT, text STRING"


def read_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of plain log files.  A text scan gives no position within the file."""
    return spark.read.text(glob).select(
        folder_of(F.col("_metadata.file_path")).alias("cluster_name"),
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_logs_in_order(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of plain log files with their number, from 1.

    Spark reads a large file in blocks.  Lines are numbered within each block,
    and the lines of the blocks before it are added, so no file has to be in one task.
    """
    meta = F.col("_metadata.file_path")
    lines = spark.read.text(glob).select(
        folder_of(meta).alias("cluster_name"), meta.alias("file"), F.col("value").alias("text"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    here = Window.partitionBy("file", "_block").orderBy("_seq")
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_lines"))
    above = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "_block", F.coalesce(F.sum("_lines").over(above), F.lit(0)).alias("_base"))
    return (lines.withColumn("_n", F.row_number().over(here)).join(base, ["file", "_block"])
            .select("cluster_name", "file", (F.col("_n") + F.col("_base")).cast("bigint").alias("line_no"), "text"))


def read_numbered_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Lines collected as JSON with their line number, for ordered operators."""
    return spark.read.schema(LOG_SCHEMA).json(glob)


def stream_logs(spark: SparkSession, directory: str, *, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").load(directory)
            .select(folder_of(F.col("_metadata.file_path")).alias("cluster_name"),
                    F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def follow_logs(spark: SparkSession, root: str) -> DataFrame:
    """Lines below ``<root>/<cluster>/`` as they are appended; ``at`` orders those of a file."""
    return follow_files(spark, root).select(folder_of(F.col("file")).alias("cluster_name"), "file", "at", "text")


def parse_manifests(lines: DataFrame, text: str = "line") -> DataFrame:
    """``<hash> ... <name>``: first field is the hash, last field the name.

    Lines with fewer than two fields name nothing and are left out.
    """
    fields = F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), r"\s+")
    return (lines.withColumn("_f", fields).filter(F.size("_f") >= 2)
            .withColumns({"hash": F.get("_f", F.lit(0)), "name": F.element_at("_f", -1)}).drop("_f"))


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """One row per named file; the first line that names it wins.

    A manifest is one small file, so it is split by position inside one row.
    """
    lines = (spark.read.text(glob, wholetext=True)
             .select(folder_of(F.col("_metadata.file_path")).alias("cluster_name"),
                     F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
    first = parse_manifests(lines).groupBy("cluster_name", "name").agg(F.min_by("hash", "line_no").alias("hash"))
    return first.select("cluster_name", "name", "hash")


def read_inventory(spark: SparkSession, kind: str, glob: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromDDL(INVENTORY[kind])).json(glob)


def parse_sockets(lines: DataFrame, text: str = "value") -> DataFrame:
    """Socket listing lines: state, queues, local ``address:port``, peer, process."""
    cut = lines.withColumn("_p", F.split(F.trim(F.col(text)), r"\s+")).withColumn("_l", F.get("_p", F.lit(3)))
    port = F.substring_index("_l", ":", -1)
    return (cut.withColumns({
        "local_addr": F.left("_l", F.length("_l") - F.length(port) - 1),
        "port": port.try_cast("int"),
        "process": F.coalesce(F.array_join(F.slice("_p", 6, F.size("_p")), " "), F.lit(""))})
        .filter(F.col("port").isNotNull()).drop("_p", "_l"))


def parse_addresses(lines: DataFrame, text: str = "value") -> DataFrame:
    """Interface listing in one-line form: ``2: eth0    inet 10.0.0.1/24 ...``."""
    return (lines.withColumns({
        "iface": F.regexp_extract(text, r"^\d+:\s+(\S+?)(?:@\S+)?\s+inet6?\s", 1),
        "ip": F.regexp_extract(text, r"\sinet6?\s+([^/\s]+)/", 1),
        "prefix": F.regexp_extract(text, r"\sinet6?\s+[^/\s]+/(\d+)", 1).try_cast("int")})
        .filter(F.col("ip") != ""))


def parse_disk(lines: DataFrame, text: str = "value") -> DataFrame:
    """``<mount> <available>K``; null when the figure is unreadable."""
    figure = F.regexp_extract(text, r"(\d+)K?\s*$", 1)
    return lines.withColumns({"mount": F.regexp_extract(text, r"^\s*(\S+)", 1),
                              "avail_kb": figure.try_cast("bigint")})


def parse_ping(lines: DataFrame, text: str = "value") -> DataFrame:
    """``<ip> <exit code>``: code 0 means the address answered."""
    return lines.withColumns({"ip": F.regexp_extract(text, r"^\s*(\S+)", 1),
                              "alive": F.regexp_extract(text, r"\s(\d+)\s*$", 1) == "0"})


_HOST = {"sockets": parse_sockets, "addrs": parse_addresses, "disk": parse_disk, "ping": parse_ping}


def read_host(spark: SparkSession, kind: str, glob: str) -> DataFrame:
    """Host fact files below ``<root>/<controller>/``; unknown kinds stay plain lines."""
    lines = spark.read.text(glob).select(
        folder_of(F.col("_metadata.file_path")).alias("controller_id"), "value")
    return _HOST[kind](lines) if kind in _HOST else lines.withColumnRenamed("value", "line")


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """Listing only: no file body is read.

    A folder is listed in tasks.  A pattern, a file and a store that only Spark
    opens are listed by Spark, whose driver holds all names; the content column is pruned.
    """
    path = re.sub(r"^file:/+", "/", glob)
    if path.startswith("/") and not re.search(r"[*?\[\]{}\\]", path) and os.path.isdir(path):
        listed = list_tree(spark, path.rstrip("/") or "/").filter("length > 0")  # Spark's scan has no empty files
        return listed.select(F.concat(F.lit("file:"), "path").alias("path"), "length", "mtime")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
            .select("path", "length", F.col("modificationTime").alias("mtime")))
