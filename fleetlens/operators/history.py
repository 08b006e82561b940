"""Keyed histories, change detection and head/tail samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.collections import listed
from fleetlens.operators.ordered import ordered


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key (W3).  A grouped maximum, reduced before the shuffle."""
    return _keep(df, key, order, F.max_by)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, key, order, F.min_by)


def _keep(df, key, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def as_of(snapshots: DataFrame, key: Sequence[str], moment: Column, at: str = "snapshot_ts") -> DataFrame:
    """The facts of one moment: all rows of each key's newest snapshot not after ``moment``.

    ``key`` names what one snapshot covers (a controller, a system), so a fact
    that a newer snapshot no longer lists is gone.  Rows without a time take no part.
    """
    seen = snapshots.filter(F.col(at) <= moment)
    newest = seen.groupBy(*key).agg(F.max(at).alias(at))
    return seen.join(newest, [*key, at], "left_semi").select(*snapshots.columns)


def latest_with_attempts(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest run per key, with the number of runs as ``attempts``."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"),
                                F.count(F.lit(1)).alias("attempts"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], "attempts")


def head_tail(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int = 10) -> DataFrame:
    """First and last ``k`` rows per group, everything up to ``2k`` rows.

    ``position`` counts from 1, ``omitted`` is the number of rows left out
    between head and tail.  Both ends are ranked limits, so each map task sends
    at most ``k`` rows per group into the shuffle.
    """
    up = Window.partitionBy(*group).orderBy(*order)
    down = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    head = df.withColumn("_n", F.row_number().over(up)).filter(F.col("_n") <= k).withColumn("part", F.lit("head"))
    tail = df.withColumn("_n", F.row_number().over(down)).filter(F.col("_n") <= k).withColumn("part", F.lit("tail"))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    both = head.unionByName(tail).join(sizes, list(group))
    position = F.when(F.col("part") == "head", F.col("_n")).otherwise(F.col("_rows") - F.col("_n") + 1)
    return (both.withColumns({"position": position, "omitted": F.greatest(F.lit(0), F.col("_rows") - 2 * k)})
            .filter((F.col("part") == "head") | (F.col("position") > k)).drop("_n", "_rows"))


def config_changes(configs: DataFrame, key: Sequence[str], order: Sequence[str], raw: str = "raw",
                   slices: int | None = None) -> DataFrame:
    """Snapshots whose bytes differ from the one before (W5); comment edits count."""
    hashed = configs.withColumn("content_hash", F.sha2(F.col(raw), 256)).drop(raw)
    seen = ordered(hashed, key, order, previous={"previous_hash": "content_hash"}, slices=slices)
    return seen.filter(F.col("previous_hash").isNotNull() & (F.col("previous_hash") != F.col("content_hash")))


def command_deltas(commands: DataFrame, key: Sequence[str], order: Sequence[str],
                   slices: int | None = None) -> DataFrame:
    """Phases each command added, and resumes so far.

    A create command resumes when it started from an unfinished deployment
    (``resumes`` true).
    """
    marked = commands.withColumns({
        "added": F.array_except(listed(F.col("phases_after")), listed(F.col("phases_before"))),
        "_r": F.coalesce(F.col("resumes"), F.lit(False)).cast("int")})
    return ordered(marked, key, order, running={"resume_count": "_r"}, slices=slices).drop("_r")


def latest_backup(files: DataFrame, key: Sequence[str], prefix: str = "state.json.backup-") -> DataFrame:
    """The backup with the largest name stamp (T2); stamps sort as text."""
    name = F.substring_index("path", "/", -1)
    return (files.withColumn("_name", name).filter(F.col("_name").startswith(prefix))
            .groupBy(*key).agg(F.max_by("path", "_name").alias("path"), F.max("_name").alias("name")))
