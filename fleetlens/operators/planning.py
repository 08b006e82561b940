"""State repair and the set differences behind resume, boot and cleanup (U1-U7, FL1-FL5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.collections import contains, listed, without
from fleetlens.functions.text import blank

# The phases of a deployment in order, and the current state version.
PHASE_ORDER = ("discovery", "downloads", "services", "ignition", "boot", "wait")
STATE_VERSION = 2
_CLUSTER = ("controller_id", "cluster_name")


def visible(markers: DataFrame) -> DataFrame:
    """Clusters shown in lists (FL1)."""
    return markers.filter(~F.col("deleted"))


def prunable(markers: DataFrame) -> DataFrame:
    """Workspaces that may be removed (FL3)."""
    return markers.filter(F.col("deleted"))


def repaired_status() -> Column:
    """The status a state has once loaded: an empty one is filled from the end time."""
    status = blank(F.col("status"))
    return F.when(status != "", status).when(blank(F.col("end_time")) != "", F.lit("completed")).otherwise(
        F.lit("in_progress"))


def is_resumable(states: DataFrame) -> Column:
    """An unfinished deployment with at least one completed phase (FL4), judged on the state as loaded.

    A state marked ``corrupt`` cannot be loaded and never resumes.
    """
    readable = ~F.coalesce(F.col("corrupt"), F.lit(False)) if "corrupt" in states.columns else F.lit(True)
    return readable & repaired_status().isin("in_progress", "failed") & (F.size(listed(F.col("completed_phases"))) > 0)


def resumable(states: DataFrame) -> DataFrame:
    return states.filter(is_resumable(states)).withColumn("status", repaired_status())


def create_gate(markers: DataFrame) -> DataFrame:
    """May a new deployment start (FL5)?  Both forms of the test as columns.

    ``decision`` follows the marker form, ``directory_decision`` the stricter
    form that also refuses any existing folder.
    """
    gate = (F.when(F.col("deleted"), "fresh").when(F.col("failed"), "resume")
            .when(F.col("managed"), "refuse").otherwise("start"))
    strict = F.when(F.col("deleted"), "fresh").when(F.col("locked"), "locked").otherwise("exists")
    return markers.withColumns({"decision": gate, "directory_decision": strict})


def dedupe_events(states: DataFrame, column: str = "completed_events") -> DataFrame:
    """Completed events in first-seen order, with the number of repeats removed."""
    kept = F.array_distinct(listed(F.col(column)))
    return states.withColumns({column: kept, "events_removed": F.size(listed(F.col(column))) - F.size(kept)})


def repair(states: DataFrame) -> DataFrame:
    """Fill what a damaged state lacks.

    Only an empty status is repaired; an invalid one stays and is reported again.
    The version is filled on loading, so a loaded state never lacks one.
    Running it twice changes nothing more.
    """
    version = F.coalesce(F.nullif(F.col("state_version"), F.lit(0)), F.lit(STATE_VERSION))
    maps = {m: F.coalesce(F.col(m), F.create_map().cast(states.schema[m].dataType))
            for m in ("download_progress", "node_boot_status") if m in states.columns}
    lists = {"failed_events": listed(F.col("failed_events"))} if "failed_events" in states.columns else {}
    return states.withColumns({
        "state_version": version, "status": repaired_status(),
        "completed_events": F.array_distinct(listed(F.col("completed_events"))), **maps, **lists})


def resume_plan(states: DataFrame, files: DataFrame | None = None, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Phases still to run, in order.

    Phases are tested one by one.  A finished ``downloads`` or ``ignition`` runs
    again when its result is missing (``files``: has_installer, has_install_dir).
    A deployment that cannot resume runs everything.
    """
    done = listed(F.col("completed_phases"))
    df = states
    if files is not None:
        df = df.join(files.select(*key, "has_installer", "has_install_dir"), list(key), "left")
        gone = F.filter(F.array(
            F.when(~F.coalesce("has_installer", F.lit(False)), F.lit("downloads")),
            F.when(~F.coalesce("has_install_dir", F.lit(False)), F.lit("ignition"))), lambda p: p.isNotNull())
        done = without(done, gone)
    # Whether a run resumes is judged on the phases as recorded.
    phases = F.array(*map(F.lit, PHASE_ORDER))
    left = F.filter(phases, lambda p: ~contains(done, p))
    return df.select(*key, F.when(is_resumable(states), left).otherwise(phases).alias("plan"))


def boot_plan(nodes: DataFrame, states: DataFrame, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Nodes without a boot marker."""
    marks = (states.select(*key, F.explode("completed_phases").alias("_m")).filter(F.col("_m").startswith("booted_"))
             .select(*key, F.substring("_m", 8, 1 << 30).alias("hostname")))
    return nodes.join(marks, [*key, "hostname"], "left_anti")


def drop_markers(states: DataFrame, removed: Column) -> DataFrame:
    """Forget the boot and ready markers of removed hosts (U4); other markers keep their order."""
    gone = F.flatten(F.transform(removed, lambda h: F.array(
        F.concat(F.lit("booted_"), h), F.concat(F.lit("ready_"), h))))
    return states.withColumn("completed_phases", without(listed(F.col("completed_phases")), gone))


# Cleanup step and the state list that records it.
CLEANUP_LISTS = {"power_off": "power_off_completed", "unmap_media": "iso_unmapped",
                 "unmount": "nfs_unmounted", "remove_service": "services_removed"}


def cleanup_remaining(states: DataFrame, wanted: DataFrame, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Cleanup steps not yet recorded as done.

    ``wanted`` has one row per step and item; done items are the state's lists,
    and the shared address's own flag.
    """
    done = F.array(*[F.struct(F.lit(step).alias("step"), listed(F.col(f"cleanup_progress.{name}")).alias("items"))
                     for step, name in CLEANUP_LISTS.items()])
    each = states.select(*key, F.inline(done)).select(*key, "step", F.explode("items").alias("item"))
    vip = states.filter(F.coalesce("cleanup_progress.vip_removed", F.lit(False))).select(
        *key, F.lit("remove_vip").alias("step"), F.lit("vip").alias("item"))
    left = wanted.select(*key, "step", "item").join(each.union(vip), [*key, "step", "item"], "left_anti")
    # a text as aggregate is met in the join's own order, so repeats leave without a table of all rows in memory
    return left.groupBy(*key, "step", "item").agg(F.max("item").alias("_item")).select(*key, "step", F.col("_item").alias("item"))
