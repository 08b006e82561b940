"""Listed folders, numbered lines of files cut into blocks, and followed files that grow between batches."""

import random

from pyspark.sql import functions as F

from fleetlens.sources import documents, listing, sinks, snapshots
from tests.conftest import rows


def _log(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{x}\n" for x in lines))


def test_folders_with_dot_files_alone_and_without_files(spark, tmp_path):
    for name, files in {"a": [".failed"], "b": ["config.yaml", ".managed", ".lock"], "c": []}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text("Locked at: 2024-01-02T03:04:05Z\nPID: 9\n" if f == ".lock" else "")
    (tmp_path / "stray.txt").write_text("no folder")
    got = rows(documents.read_markers(spark, f"file:{tmp_path}"), "cluster_name", "managed", "failed", "deleted", "locked")
    assert got == [("a", False, True, False, False), ("b", True, False, False, True), ("c", False, False, False, False)]
    assert rows(documents.read_locks(spark, str(tmp_path)), "cluster_name", "lock_pid") == [("b", 9)]
    assert listing.list_folders(spark, f"{tmp_path}/none").count() == 0
    assert listing.list_folders(spark, str(tmp_path), folders_per_task=1).rdd.getNumPartitions() == 3


def test_tree_is_listed_as_spark_lists_it(spark, tmp_path):
    root = tmp_path / "r"
    for f in ("a/config.yaml", "a/.lock", "a/_x", "a/_x=1", "a/_metadata", "a/b/c/deep ä.txt", "a/.h/in", "_s/in", "_p=1/in", "stray", ".dot", "x._COPYING_",
              "a/empty", "a/p%20q", "a/_spark_metadata/0", "a/_metadata_of/x"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("" if f == "a/empty" else f"body of {f}\n")
    (root / "none").mkdir()
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file:{root}").select(
        "path", "length", F.col("modificationTime").alias("mtime"))
    for at in (f"file:{root}", f"file://{root}/", str(root)):
        got = snapshots.read_files(spark, at)
        assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)
    assert rows(listing.list_tree(spark, str(root), 1).select(F.concat(F.lit("file:"), "path").alias("path"), "length", "mtime").filter("length > 0")) == rows(want)
    assert listing.list_tree(spark, str(root), 1).rdd.getNumPartitions() > 3  # names are dealt to tasks
    assert snapshots.read_files(spark, f"{tmp_path}/r/none").count() == 0
    assert rows(snapshots.read_files(spark, f"{root}/a/*.yaml"), "length") == [(len("body of a/config.yaml\n"),)]


def test_numbers_of_files_in_several_blocks(spark, tmp_path):
    rng = random.Random(1)
    whole = {name: [f"{i} " + "x" * rng.randrange(200) for i in range(n)] for name, n in (("a", 3000), ("b", 1), ("c", 700))}
    for name, lines in whole.items():
        _log(tmp_path / name / "run.log", lines)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = snapshots.read_logs_in_order(spark, f"{tmp_path}/*/*.log")
        assert spark.read.text(f"{tmp_path}/*/*.log").select("_metadata.file_block_start").distinct().count() > 10
        got = rows(df, "cluster_name", "line_no", "text")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == sorted(((n, i + 1, x) for n, lines in whole.items() for i, x in enumerate(lines)), key=repr)


def _drain(spark, root, out, mark, span):
    stream = listing.follow_files(spark, str(root), span)
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark)).trigger(
        availableNow=True).start().awaitTermination()
    return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["text"]) for r in spark.read.parquet(str(out)).collect())


def test_appended_lines_arrive_once(spark, tmp_path):
    root, out, mark = tmp_path / "logs", tmp_path / "out", tmp_path / "mark"
    _log(root / "c" / "a.log", ["one", "", "three äö"])
    with open(root / "c" / "a.log", "a") as f:
        f.write("half a li")
    first = _drain(spark, root, out, mark, 7)
    assert first == [("a.log", 0, "one"), ("a.log", 4, ""), ("a.log", 5, "three äö")]
    with open(root / "c" / "a.log", "a") as f:  # the rest of the line, and a new file, after a restart
        f.write("ne\n" + "".join(f"more {i}\r\n" for i in range(50)))
    _log(root / "d" / "b.log", ["x" * 200_000, "end"])
    second = _drain(spark, root, out, mark, 40_000)
    texts = [t for f, _, t in second if f == "a.log"]
    assert texts == ["one", "", "three äö", "half a line", *[f"more {i}" for i in range(50)]]
    assert [(a, t) for f, a, t in second if f == "b.log"] == [(0, "x" * 200_000), (200_001, "end")]
    assert _drain(spark, root, out, mark, 1 << 20) == second


def test_followed_logs_name_their_cluster(spark, tmp_path):
    _log(tmp_path / "logs" / "c7" / "a.log", ["x"])
    stream = snapshots.follow_logs(spark, str(tmp_path / "logs"))
    query = stream.select("cluster_name", "text", F.col("at")).writeStream.format("memory").queryName("seen_lines").trigger(
        availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("seen_lines")) == [("c7", "x", 0)]


def test_committed_runs(spark, tmp_path):
    """A repeated run adds nothing, one that broke off is not read, and earlier moments see earlier runs."""
    path = str(tmp_path / "runs")
    made = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, None)], "k int, t string")
    df = made.select("k", F.to_timestamp("t").alias("snapshot_ts"))
    sinks.append_run(df, path, "one")
    sinks.append_run(df, path, "one")
    seen = spark.sql("select current_timestamp() as t").first()["t"]
    sinks.append_run(df.filter("k = 1"), path, "two")
    df.withColumns({"run_id": F.lit("broken"), "attempt": F.lit("x"), "snapshot_date": F.to_date("snapshot_ts")}).write.mode(
        "append").partitionBy("attempt", "snapshot_date").parquet(f"{path}/rows")
    got = sorted((r["run_id"], r["k"]) for r in sinks.read_runs(spark, path).collect())
    assert got == [("one", 1), ("one", 2), ("one", 3), ("two", 1)]
    assert {r["run_id"] for r in sinks.read_runs(spark, path, F.lit(seen)).collect()} == {"one"}
