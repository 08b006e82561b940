"""Followed logs, pending requests, bursts, waits with a deadline, state changes (ST1-ST7).

Where a query keeps state per cluster, each micro-batch is reduced with an
ordinary grouped aggregation (partial sums in map tasks) and merged into a
versioned table.  No cluster's rows ever have to pass through one task, and a
repeated batch rewrites the same version.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fleetlens.operators.desired import reconcile
from fleetlens.operators.history import keep_last
from fleetlens.operators.logs import classify, redact

# Limits in seconds.
BOOTSTRAP_LIMIT = 1800
INSTALL_LIMIT = 5400
JOIN_LIMIT = 2700


def follow(lines: DataFrame, text: str = "text", source: str = "mirror", tokens: Sequence[str] = (),
           tag: str = "X-API-Session") -> DataFrame:
    """Classify, then redact; stateless, so it runs the same in batch and stream (ST1)."""
    return redact(classify(lines, text, source), text, tokens, tag)


def pending_requests(requests: DataFrame, delay: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Certificate requests without status, each once within the delay (ST2).

    The engine's own deduplication; use ``collect_pending`` where one request
    may be reported very many times within a batch.
    """
    return (requests.filter(~F.coalesce("has_status", F.lit(False))).withWatermark(at, delay)
            .dropDuplicatesWithinWatermark(["cluster_name", "name"]))


def collect_pending(requests: DataFrame, out: str, state: str, checkpoint: str, delay_seconds: int = 600,
                    at: str = "ts") -> StreamingQuery:
    """Pending requests as they first appear, again only after the delay without reports (ST2).

    Repeats are reduced in map tasks before they are compared with what was told.
    """
    spark = requests.sparkSession
    key = ["cluster_name", "name"]
    shape = requests.select(*key).schema.add("last_seen", "timestamp")
    table = StateTable(spark, state, shape)

    def step(batch: DataFrame, batch_id: int) -> None:
        # runs without a longer pause, so that the answer does not hang on how rows fall into batches
        run = F.session_window(at, f"{delay_seconds} seconds 1 microsecond")
        seen = (batch.filter(~F.coalesce("has_status", F.lit(False))).groupBy(*key, run)
                .agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen")).drop("session_window").persist())
        told = table.before(batch_id)
        joined = seen.join(told.withColumnRenamed("last_seen", "_told"), key, "left")
        quiet = F.unix_micros("first_seen") - F.unix_micros("_told") > delay_seconds * 1_000_000
        fresh = joined.filter(F.col("_told").isNull() | quiet)
        fresh.select(*key, "first_seen").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        merged = told.unionByName(seen.select(*key, "last_seen")).groupBy(*key).agg(F.max("last_seen").alias("last_seen"))
        table.write(batch_id, merged)
        seen.unpersist()

    return (requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def bursts(lines: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", at: str = "ts",
           key: Sequence[str] = ("cluster_name",)) -> DataFrame:
    """Runs of log activity per cluster (ST7).

    Sessions merge inside map tasks first, so a busy cluster sends few rows.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (lines.withWatermark(at, delay).groupBy(*key, F.session_window(at, gap))
            .agg(F.count(F.lit(1)).alias("lines"))
            .select(*key, F.col("session_window.start").alias("burst_start"),
                    F.col("session_window.end").alias("burst_end"), "lines"))


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over everything available now and append to files, exactly once."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


@dataclass(frozen=True)
class StateTable:
    """A keyed table with one version per micro-batch, below a shared folder."""

    spark: SparkSession
    path: str
    schema: StructType

    def before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={batch_id - 1}")

    def write(self, batch_id: int, df: DataFrame) -> DataFrame:
        at = f"{self.path}/version={batch_id}"
        df.select(*self.schema.names).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(self.schema).parquet(at)


def waits(targets: DataFrame, first_ready: DataFrame, clock, limit_seconds: int,
          key: Sequence[str] = ("cluster_name",)) -> DataFrame:
    """Verdict per wait: ready when all targets were ready by the deadline, else timed out.

    ``targets``: key, hostname, started_at.  ``clock`` is the latest event time seen.
    """
    joined = targets.join(first_ready, [*key, "hostname"], "left")
    deadline = F.timestamp_seconds(F.unix_micros("started_at") / 1_000_000 + limit_seconds)
    per = joined.groupBy(*key).agg(
        F.count(F.lit(1)).alias("targets"), F.min(deadline).alias("deadline"),
        F.count_if(F.col("ready_at") <= deadline).alias("ready"), F.max("ready_at").alias("_last"))
    done = F.col("ready") == F.col("targets")
    late = F.lit(clock).cast("timestamp") >= F.col("deadline")
    return (per.withColumns({
        "verdict": F.when(done, "ready").when(late, "timed_out"),
        "resolved_at": F.when(done, F.col("_last")).when(late, F.col("deadline"))})
        .filter(F.col("verdict").isNotNull()).drop("_last"))


def wait_for_ready(events: DataFrame, targets: DataFrame, limit_seconds: int, out: str, state: str,
                   checkpoint: str, key: Sequence[str] = ("cluster_name",), at: str = "ts",
                   lateness_seconds: int = 0) -> StreamingQuery:
    """Follow readiness events and write each wait's verdict once (ST3, ST4).

    ``events``: key, hostname, ready, event time.  A wait times out only once
    the newest event is ``lateness_seconds`` past its deadline, so events that
    arrive out of order by less still count.
    """
    spark = targets.sparkSession
    shape = targets.select(*key, "hostname").schema.add("ready_at", "timestamp")
    table = StateTable(spark, f"{state}/ready", shape)
    clock_table = StateTable(spark, f"{state}/clock", StructType().add("clock", "timestamp"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        seen = batch.filter(F.trim("ready") == "True").select(*key, "hostname", F.col(at).alias("ready_at"))
        merged = (table.before(batch_id).unionByName(seen).groupBy(*key, "hostname")
                  .agg(F.min("ready_at").alias("ready_at")))
        now = table.write(batch_id, merged)
        tick = batch.select(F.col(at).alias("clock")).unionByName(clock_table.before(batch_id))
        clock = clock_table.write(batch_id, tick.agg(F.max("clock").alias("clock"))).first()["clock"]
        if clock is not None:
            clock -= datetime.timedelta(seconds=lateness_seconds)
        open_ = targets
        if batch_id > 0:  # waits that were told are not worked out again
            told = spark.read.parquet(out).filter(F.col("batch") < batch_id).select(*key)
            open_ = targets.join(told, list(key), "left_anti")
        verdicts = waits(open_, now, clock, limit_seconds, key)
        verdicts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return (events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def keyed_waits(events: DataFrame, targets: DataFrame, limit_seconds: int, key: str = "cluster_name", at: str = "ts",
                lateness_seconds: int = 0) -> DataFrame:
    """The verdict of each wait as a stream, from state that the engine keeps for open waits alone (ST3, ST4).

    Both are streams: ``events`` with key, hostname, ready and event time,
    ``targets`` with key, hostname and started_at, known before their events.  A
    timer set at the deadline (of the earliest target) ends a wait that is not
    ready by then; a wait that
    was told leaves no state, and later events of it are passed over.  Events
    older than the watermark do not count.
    """
    seen = (events.withWatermark(at, f"{lateness_seconds} seconds").filter(F.trim("ready") == "True")
            .select(F.col(key).cast("string").alias("_key"), "hostname", F.col(at).alias("_at"), F.lit(False).alias("_asked")))
    asked = targets.select(F.col(key).cast("string").alias("_key"), "hostname", F.col("started_at").alias("_at"), F.lit(True).alias("_asked"))

    def told(name: str, hosts: dict, verdict: str, deadline: int, resolved: int) -> pd.DataFrame:
        on_time = sum(t is not None and t <= deadline for t in hosts.values())
        moments = [pd.Timestamp(x, unit="us") for x in (deadline, resolved)]
        return pd.DataFrame({"_key": [name], "targets": [len(hosts)], "ready": [on_time], "deadline": [moments[0]],
                             "verdict": [verdict], "resolved_at": [moments[1]]})

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"hosts": {}, "deadline": None}
        hosts, deadline = kept["hosts"], kept["deadline"]
        if state.hasTimedOut:
            state.remove()
            yield told(group[0], hosts, "timed_out", deadline, deadline)
            return
        first: dict[str, int] = {}
        for b in batches:
            micros = b["_at"].astype("datetime64[us]").astype("int64")
            for host, moment, is_target in zip(b["hostname"], micros.tolist(), b["_asked"]):
                if is_target:
                    hosts.setdefault(host, None)
                    ends = moment + limit_seconds * 1_000_000
                    deadline = ends if deadline is None else min(deadline, ends)
                else:
                    first[host] = min(moment, first.get(host, moment))
        for host, moment in first.items():
            if host in hosts:
                hosts[host] = moment if hosts[host] is None else min(moment, hosts[host])
        if not hosts:  # told before, or never asked for
            if state.exists:
                state.remove()
            return
        if all(t is not None and t <= deadline for t in hosts.values()):
            if state.exists:
                state.remove()
            yield told(group[0], hosts, "ready", deadline, max(hosts.values()))
            return
        timer = -(-deadline // 1000)
        if timer <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield told(group[0], hosts, "timed_out", deadline, deadline)
            return
        state.update((json.dumps({"hosts": hosts, "deadline": deadline}),))
        state.setTimeoutTimestamp(timer)

    shape = "_key string, targets bigint, ready bigint, deadline timestamp, verdict string, resolved_at timestamp"
    out = seen.unionByName(asked).groupBy("_key").applyInPandasWithState(
        step, shape, "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    kind = events.schema[key].dataType
    return out.select(F.col("_key").cast(kind).alias(key), "targets", "ready", "deadline", "verdict", "resolved_at")


def state_changes(snapshots: DataFrame, out: str, state: str, checkpoint: str,
                  key: Sequence[str] = ("cluster_name",), order: Sequence[str] = ("snapshot_ts",)) -> StreamingQuery:
    """Newest snapshot per cluster in each batch against the stored one (ST6).

    Rows are written with action add or change; unchanged clusters write nothing.
    """
    spark = snapshots.sparkSession
    table = StateTable(spark, state, snapshots.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch, stored = batch.persist(), table.before(batch_id)
        touched = stored.join(keep_last(batch, list(key), list(order)).select(*key), list(key), "left_semi")
        # A snapshot that arrives late must not replace a newer stored one.
        newest = keep_last(batch.unionByName(touched), list(key), list(order))
        facts = [c for c in newest.columns if c not in order]
        changes = reconcile(newest.select(*facts), touched.select(*facts), list(key)).filter(F.col("action") != "same")
        changes.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        kept = stored.join(newest.select(*key), list(key), "left_anti")
        table.write(batch_id, kept.unionByName(newest))
        batch.unpersist()

    return (snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
