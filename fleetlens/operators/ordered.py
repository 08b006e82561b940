"""Ordered scans (lag, lead, running sum, row number) that survive a hot group.

A plain window sends a whole group to one task.  Here all rows are cut into
slices that follow (group, order), so that a large group is spread over many of
them and small ones mostly share one.  Each slice is scanned on its own, and what
one slice hands to the next (last row, sums so far) is carried through a table
of one row for each slice of a group that a cut goes through.  There are fewer
cuts than slices, so that table is bounded by the number of slices.

The cuts come from a sample that a hash of the row picks, worked out by a
subquery when the plan runs: building it starts no job, and a second run cuts at
the same places.  The path does not depend on the size of any group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each slice.
SAMPLE = 8


def _cuts(keys: DataFrame, slices: int) -> DataFrame:
    """One row with an ascending array of ``slices - 1`` keys at most."""
    picked = keys.orderBy(F.xxhash64("_scan_key")).limit(SAMPLE * slices)
    whole = picked.agg(F.array_sort(F.collect_list("_scan_key")).alias("_keys"))
    step = F.size("_keys") / F.lit(slices)
    cut = F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("_keys", F.floor(i * step).cast("int")))
    return whole.select(F.filter(cut, lambda k: k.isNotNull()))


def _placed(keyed: DataFrame, steps: int) -> DataFrame:
    """Add how many cuts are at or below each row's key, by halving, and whether a cut next to it is in its group.

    One projection a step keeps the search in generated code.  The row number is
    there to be asked for by the filter on cut groups: the optimiser would else
    move it below the search and write the search out again.
    """
    at = F.lit(0)
    for step in (1 << i for i in reversed(range(steps))):
        below = F.coalesce(F.get("_scan_cuts", at + (step - 1)) <= F.col("_scan_key"), F.lit(False))
        keyed = keyed.withColumn("_scan_slice", at + F.when(below, step).otherwise(0))
        at = F.col("_scan_slice")
    near = [F.coalesce(F.get("_scan_cuts", i)["_scan_g"] == F.col("_scan_g"), F.lit(False)) for i in (at - 1, at)]
    return keyed.withColumns({"_scan_cut": near[0] | near[1], "_scan_no": F.monotonically_increasing_id()})


def ordered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    rank: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ordered columns; ``order`` must be total within each group.

    ``previous`` and ``following`` map a new column to the column whose
    neighbouring value it takes, ``running`` maps a new column to the column
    summed up to and including the row, ``rank`` names a row number from 1.
    ``slices`` is the number of shuffle partitions unless given, rounded up to a
    power of two.  Missing values come first and form a group of their own.
    """
    previous, following, running = dict(previous or {}), dict(following or {}), dict(running or {})
    wanted = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = max(1, (wanted - 1).bit_length())
    columns = df.columns
    keyed = df.withColumns({"_scan_g": F.struct(*group), "_scan_o": F.struct(*order)}).withColumn(
        "_scan_key", F.struct("_scan_g", "_scan_o"))
    cuts = _cuts(keyed.select("_scan_key"), 1 << steps).scalar()
    placed = _placed(keyed.withColumn("_scan_cuts", cuts), steps).drop("_scan_cuts", "_scan_key")

    last = F.struct(*[F.col(src).alias(name) for name, src in previous.items()], F.lit(1).alias("_one"))
    first = F.struct(*[F.col(src).alias(name) for name, src in following.items()], F.lit(1).alias("_one"))
    edge = placed.filter("_scan_cut and _scan_no >= 0").groupBy(F.col("_scan_g").alias("_scan_eg"), F.col("_scan_slice").alias("_scan_es")).agg(
        F.count(F.lit(1)).alias("_scan_e_rows"), F.max_by(last, "_scan_o").alias("_scan_e_last"), F.min_by(first, "_scan_o").alias("_scan_e_first"),
        *[F.sum(src).alias(f"_scan_e_sum_{name}") for name, src in running.items()])
    across = Window.partitionBy("_scan_eg").orderBy("_scan_es")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        "_scan_eg", "_scan_es", "_scan_e_rows", F.coalesce(F.sum("_scan_e_rows").over(before), F.lit(0)).alias("_scan_e_base"),
        F.lag("_scan_e_last").over(across).alias("_scan_e_prev"), F.lead("_scan_e_first").over(across).alias("_scan_e_next"),
        *[F.sum(f"_scan_e_sum_{name}").over(before).alias(f"_scan_e_sum_{name}") for name in running])

    local = Window.partitionBy(*group, "_scan_slice").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = {"_scan_n": F.row_number().over(local)}
    values |= {f"_scan_l_{name}": F.lag(src).over(local) for name, src in previous.items()}
    values |= {f"_scan_l_{name}": F.lead(src).over(local) for name, src in following.items()}
    values |= {f"_scan_l_{name}": F.sum(src).over(upto) for name, src in running.items()}
    # two rows for each cut at most
    joined = placed.withColumns(values).join(F.broadcast(edge), (F.col("_scan_g") == F.col("_scan_eg")) & (F.col("_scan_slice") == F.col("_scan_es")), "left")

    out = {name: F.when((F.col("_scan_n") == 1) & F.col("_scan_e_rows").isNotNull(), F.col(f"_scan_e_prev.{name}")).otherwise(F.col(f"_scan_l_{name}"))
           for name in previous}
    out |= {name: F.when(F.col("_scan_n") == F.col("_scan_e_rows"), F.col(f"_scan_e_next.{name}")).otherwise(F.col(f"_scan_l_{name}"))
            for name in following}
    for name in running:
        base, mine = F.col(f"_scan_e_sum_{name}"), F.col(f"_scan_l_{name}")
        out[name] = F.when(base.isNull(), mine).when(mine.isNull(), base).otherwise(base + mine)
    if rank:
        out[rank] = (F.col("_scan_n") + F.coalesce("_scan_e_base", F.lit(0))).cast("bigint")
    return joined.select(*columns, *[value.alias(name) for name, value in out.items()])
