"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_dir, write_and_read

#: Rows of one Arrow batch.  Texts may be very long, so batches are short.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a lambda's variable is not written out again."""
    return F.get(F.transform(F.array(value), body), 0)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where a column (in any case) is already called so."""
    taken = {c.lower() for c in df.columns}
    return wanted if wanted.lower() not in taken else f"{wanted}_{uuid.uuid4().hex[:8]}"


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One 64-bit hash of a whole row, nulls told apart by their place."""
    names = list(columns or df.columns)
    return F.xxhash64(*[part for c in names for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def hook_and_jump(edges: DataFrame) -> DataFrame:
    """One pass over edges (u, v), u > v: each node and its neighbours below hook on the smallest, then jump a step on."""
    low = write_and_read(edges.groupBy("u").agg(F.min("v").alias("m")))
    hooked = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v")))
    onward = low.select(F.col("u").alias("v"), F.col("m").alias("next"))
    return write_and_read(hooked.join(onward, "v", "left").select("u", F.coalesce("next", "v").alias("v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node of an edge.

    Hooks nodes on smaller ones and shortens their ways until nothing changes.
    Each pass works on written tables, so that joins on a busy node can be split
    and a lost executor costs one pass.  ``root`` is the smallest node.
    """
    now = write_and_read(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"),
                       F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            break
        seen, now = mark, hook_and_jump(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


__all__ = ["BATCH_ROWS", "components", "free_name", "let", "read", "row_hash", "scratch_dir", "small_batches", "text_of",
           "write_and_read"]
