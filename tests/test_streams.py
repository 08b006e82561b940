"""Streams over split files give what one batch gives."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.sources import snapshots
from fleetlens.streaming import feeds
from tests.conftest import rows


def _files(spark, df, path, pieces, order):
    """Write rows as ``pieces`` files one after the other, each holding a run of ``order``."""
    ranked = df.withColumn("_p", F.ntile(pieces).over(Window.orderBy(order))).cache()
    for piece in range(1, pieces + 1):
        ranked.filter(F.col("_p") == piece).drop("_p").coalesce(1).write.mode("append").parquet(path)


def _follow(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(spark):
    return spark.range(200).select(
        (F.col("id") % 4).cast("string").alias("cluster_name"), F.concat(F.lit("h"), (F.col("id") % 12).cast("string")).alias("hostname"),
        F.when((F.col("id") % 4 != 3) & (F.col("id") > 20), "True").otherwise("False").alias("ready"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.col("id").alias("seq"))


def test_waits_over_many_batches(spark, tmp_path):
    events = _events(spark)
    _files(spark, events, f"{tmp_path}/in", 5, "seq")
    targets = events.select("cluster_name", "hostname").distinct().withColumn(
        "started_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    feeds.wait_for_ready(_follow(spark, f"{tmp_path}/in", events.schema), targets, 3600, f"{tmp_path}/out", f"{tmp_path}/st",
                         f"{tmp_path}/cp").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "cluster_name", "verdict", "resolved_at")
    ready = events.filter("ready = 'True'").groupBy("cluster_name", "hostname").agg(F.min("ts").alias("ready_at"))
    last = events.agg(F.max("ts")).first()[0]
    want = rows(feeds.waits(targets, ready, last, 3600), "cluster_name", "verdict", "resolved_at")
    assert got == want and {v for _, v, _ in got} == {"ready", "timed_out"}


def test_late_reports_count_within_the_lateness(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    events = spark.range(2).select(
        F.lit("k").alias("cluster_name"), F.lit("h").alias("hostname"),
        F.when(F.col("id") == 1, "True").otherwise("False").alias("ready"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") == 0, 200).otherwise(50)).alias("ts"), F.col("id").alias("seq"))
    _files(spark, events, f"{tmp_path}/in", 2, "seq")
    targets = spark.range(1).select(F.lit("k").alias("cluster_name"), F.lit("h").alias("hostname"), at.alias("started_at"))
    for lateness, verdict in ((0, "timed_out"), (300, "ready")):
        base = f"{tmp_path}/{lateness}"
        feeds.wait_for_ready(_follow(spark, f"{tmp_path}/in", events.schema), targets, 100, f"{base}/out", f"{base}/st", f"{base}/cp",
                             lateness_seconds=lateness).awaitTermination()
        assert rows(spark.read.parquet(f"{base}/out"), "verdict") == [(verdict,)]


def test_state_changes_over_many_batches(spark, tmp_path):
    snaps = _events(spark).select("cluster_name", F.when(F.col("seq") < 100, "in_progress").otherwise("completed").alias("status"),
                                  F.col("ts").alias("snapshot_ts"))
    _files(spark, snaps, f"{tmp_path}/in", 4, "snapshot_ts")
    feeds.state_changes(_follow(spark, f"{tmp_path}/in", snaps.schema), f"{tmp_path}/out", f"{tmp_path}/st",
                        f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    counts = {(r["action"], r["want"]["status"]): r["count"] for r in out.groupBy("action", "want").count().collect()}
    assert counts == {("add", "in_progress"): 4, ("change", "completed"): 4}


def test_followed_logs_equal_batch(spark, tmp_path):
    lines = spark.range(40).select(F.col("id"), F.concat(
        F.lit("<X-API-Session>tok"), F.col("id").cast("string"), F.lit("</X-API-Session> "),
        F.when(F.col("id") % 3 == 0, "unauthorized").otherwise("ok")).alias("text"))
    _files(spark, lines, f"{tmp_path}/in", 3, "id")
    feeds.append_files(feeds.follow(_follow(spark, f"{tmp_path}/in", lines.schema)), f"{tmp_path}/out",
                       f"{tmp_path}/cp").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "id", "text", "error_class")
    assert got == rows(feeds.follow(lines), "id", "text", "error_class")
    assert not any("tok" in t for _, t, _ in got)


def test_pending_requests_once(spark, tmp_path):
    reqs = _events(spark).select("cluster_name", F.col("hostname").alias("name"), (F.col("seq") % 2 == 0).alias("has_status"), "ts")
    _files(spark, reqs, f"{tmp_path}/in", 3, "ts")
    stream = feeds.pending_requests(_follow(spark, f"{tmp_path}/in", reqs.schema), "10 hours")
    feeds.append_files(stream.select("cluster_name", "name"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = rows(reqs.filter("not has_status").select("cluster_name", "name").distinct())
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == want
    feeds.collect_pending(_follow(spark, f"{tmp_path}/in", reqs.schema), f"{tmp_path}/out2", f"{tmp_path}/st2", f"{tmp_path}/cp2",
                          36000).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out2"), "cluster_name", "name") == want


def test_log_files_are_followed(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "logs" / name).mkdir(parents=True)
        (tmp_path / "logs" / name / "deployment.log").write_text("one\n=== two ===\n")
    batch = snapshots.read_logs(spark, f"{tmp_path}/logs/*/deployment.log")
    feeds.append_files(snapshots.stream_logs(spark, f"{tmp_path}/logs"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "cluster_name", "text")
    assert got == rows(batch, "cluster_name", "text") and len(got) == 4


def test_pending_requests_do_not_hang_on_batches(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    at = [day + datetime.timedelta(seconds=s) for s in (0, 600, 1200, 1801, 9000)]
    reports = [("c", "n", False, t) for t in at]
    kind = "cluster_name string, name string, has_status boolean, ts timestamp"

    def told(name, cuts):
        place = tmp_path / name
        for part in cuts:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{place}/in")
            feeds.collect_pending(_follow(spark, f"{place}/in", spark.createDataFrame([], kind).schema), f"{place}/out",
                                  f"{place}/st", f"{place}/cp").awaitTermination()
        return [r["first_seen"] for r in spark.read.parquet(f"{place}/out").orderBy("first_seen").collect()]

    assert told("one", [reports]) == told("two", [reports[:2], reports[2:4], reports[4:]]) == [at[0], at[3], at[4]]


def test_keyed_waits_keep_state_of_open_waits_alone(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    at = lambda seconds: start + datetime.timedelta(seconds=seconds)
    spark.createDataFrame([("a", "x", start), ("a", "y", start), ("b", "x", start), ("c", "x", at(5000))],
                          "cluster_name string, hostname string, started_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/t")
    batches = [[("a", "x", "True", at(10)), ("b", "x", "False", at(20)), ("z", "x", "True", at(20))],
               [("a", "y", "True ", at(30)), ("a", "y", "True", at(31))],
               [("b", "x", "True", at(2000)), ("d", "x", "True", at(5100))]]
    for rows_ in batches:
        spark.createDataFrame(rows_, "cluster_name string, hostname string, ready string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/e")
    events = (spark.readStream.schema("cluster_name string, hostname string, ready string, ts timestamp")
              .option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e"))
    targets = spark.readStream.schema("cluster_name string, hostname string, started_at timestamp").parquet(f"{tmp_path}/t")
    query = feeds.append_files(feeds.keyed_waits(events, targets, 1000), f"{tmp_path}/out", f"{tmp_path}/mark")
    query.awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "cluster_name", "targets", "ready", "verdict")
    assert got == [("a", 2, 2, "ready"), ("b", 1, 0, "timed_out")]
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1  # c alone is still open
