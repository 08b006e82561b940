"""Inputs laid out as large ones are, and steps whose work must not gather in one task."""

from pyspark.sql import functions as F

from fleetlens.operators import matching, planning
from fleetlens.plans import bindings, queries
from fleetlens.plans.queries import QUERIES
from tests.conftest import rows


def _folder(spark, small, tmp_path, *names):
    """The named tables as folders of three files, as larger tables are."""
    for name in names:
        bindings.table(spark, small, name).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_streams_read_tables_that_are_folders(spark, small, tmp_path):
    where = _folder(spark, small, tmp_path, "documents", "events")
    for name in ("st1_follow_logs", "st4_phase_deadline", "st7_bursts"):
        got = rows(QUERIES[name](spark, where))
        assert got and got == rows(QUERIES[name](spark, small)), name


def test_leases_by_pieces_of_distinct_runs(spark):
    """Every form of containment against brute force; words that stand in every line do not reach the join."""
    lines = ["1700 aa:bb:cc:00:11:22 10.0.0.10 h *", "1700 0aa:bb:cc:00:11:22f 10.0.0.2 h *", "x-abc 1.2.3.4.5.6 h *", "abc h *",
             "1700 aa:bb 210.0.0.1:7 h *", "h 1..2.34 *", "1.2.3.4:aa:bb:cc:00:11:22 *", "10.0.0.", "", "deadbeef10.0.0.13", None]
    sought = [("AA-BB-CC-00-11-22", "10.0.0.1"), (None, "abc"), ("", "2.3.4.5"), ("zz", "1..2.3"), (None, None)]
    leases = spark.createDataFrame([("c", x) for x in lines], "controller_id string, line string")
    nodes = spark.createDataFrame([("c", *x) for x in sought], "controller_id string, mac string, ip string")
    texts = {x for mac, ip in sought for x in ((mac or "").lower().replace("-", ":"), ip) if x}
    shaped = {x for x in texts if x.count(".") == 3 and 7 <= len(x) or x.count(":") == 5}
    whole = {x for x in lines if x is not None and set(x.split()) & texts}
    assert {r["line"] for r in matching.purge_leases(leases, nodes).collect()} == whole
    got = {r["line"] for r in matching.purge_leases(leases, nodes, "substring").collect()}
    assert got == whole | {x for x in lines if x is not None and any(t in x for t in shaped)}

    many = spark.range(3000).select(F.lit("c").alias("controller_id"), F.concat(F.lit("1700 h * 10.0.0."), "id").alias("line"))
    for mode in ("exact", "substring"):
        plan = matching.purge_leases(many, nodes, mode)
        words = matching.purge_leases(many.withColumn("line", F.lit("1700 h *")), nodes, mode)
        assert plan.count() > 0 and words.count() == 0


def test_targets_of_keyed_waits_are_written_by_many_tasks(spark, small, tmp_path, monkeypatch):
    places = iter(range(100))
    monkeypatch.setattr(queries, "scratch_dir", lambda _: f"{tmp_path}/{next(places)}")  # the targets come first
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = rows(QUERIES["st3_keyed_waits"](spark, small))
    finally:
        spark.conf.set(name, "true")
    assert got and len(spark.read.parquet(f"{tmp_path}/0").inputFiles()) > 1


def test_small_folders_share_batches_and_are_made_once(spark, small, tmp_path, monkeypatch):
    """Folders and files are as many as the customers; neither a batch nor a new folder is spent on every one."""
    import pyarrow as pa

    from fleetlens.sources import listing

    made = []

    class Store:
        def __init__(self, store):
            self.store = store

        def create_dir(self, path):
            made.append(path)
            self.store.create_dir(path)

        def __getattr__(self, name):
            return getattr(self.store, name)

    def opened(path):
        store, place = listing.open_store(path)
        return Store(store), place

    monkeypatch.setattr(bindings, "open_store", opened)
    files = [(f"{tmp_path}/c{k}/{name}", text) for k in range(40) for name, text in ((".a", "x"), ("b", "y"), ("", None))[k % 3:]]
    list(bindings._put(iter([pa.RecordBatch.from_pylist([{"path": p, "content": t} for p, t in files])])))
    assert sorted(made) == sorted(f"{tmp_path}/c{k}" for k in range(40))

    reader = listing.ListingReader({"path": str(tmp_path), "content": "b"})
    want = {(f"c{k}", name) for k in range(40) for name in ((".a", "b") if k % 3 == 0 else ("b",) if k % 3 == 1 else (None,))}
    for rows_, held, batches in ((4096, 1 << 20, 1), (7, 1 << 20, 8), (4096, 2, 14)):
        monkeypatch.setattr(listing, "ROWS", rows_)
        monkeypatch.setattr(listing, "HELD", held)
        got = [b for part in reader.partitions() for b in reader.read(part)]
        found = [r for b in got for r in b.to_pylist()]
        assert {(r["folder"], r["name"]) for r in found} == want and len(found) == len(want), rows_
        assert all(r["content"] == ("y" if r["name"] == "b" else None) for r in found)
        assert len(got) <= batches, (len(got), rows_, held)
    assert bindings.spread(spark.range(50), 2).rdd.getNumPartitions() == 25


def test_queries_of_few_columns_write_no_whole_documents(spark, small, monkeypatch):
    """Configurations and states are views, so a reader builds only what it asks for."""
    def refused(_):
        raise AssertionError("documents were written whole")

    monkeypatch.setattr(bindings, "_STORED", {})
    monkeypatch.setattr(bindings, "scratch_dir", refused)
    for name in ("p10_desired_pools", "u3_boot_plan", "r53_host_violations"):
        assert QUERIES[name](spark, small).count() > 0, name
    # lists that are written out end where the count of their row says
    sizes = {(r["m"], r["w"], r["b"]) for r in bindings.flat(spark, small).select(
        F.size("masters").alias("m"), F.size("workers").alias("w"), F.size("bootstrap").alias("b")).distinct().collect()}
    assert {m for m, _, _ in sizes} == {1, 2, 3, 4, 5} and {w for _, w, _ in sizes} == {0, 1, 2, 3, 4} and {b for _, _, b in sizes} == {0, 1}


def test_addresses_are_parsed_behind_the_join(spark, small, monkeypatch):
    """The join moves addresses as text, and the numbered nodes are not written out for one reader."""
    nodes = spark.createDataFrame([(1, "fd00:2::1"), (1, "10.1.0.9"), (1, "fd00:1::7"), (1, "x"), (2, "10.2.0.1"), (3, "10.3.0.1")], "k int, ip string")
    nets = spark.createDataFrame([(1, "fd00:1::/32"), (2, "10.2.0.0/16"), (3, "bad")], "k int, machine_cidr string")
    out = matching.outside_network(nodes, nets, ["k"], strict=True)
    assert rows(out, "k", "ip") == [(1, "10.1.0.9"), (1, "fd00:2::1"), (1, "x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("_ip_at") < plan.index("Join")

    def refused(_):
        raise AssertionError("nodes were written whole")

    monkeypatch.setattr(bindings, "_STORED", {})
    monkeypatch.setattr(bindings, "scratch_dir", refused)
    for name in ("j8_wide_outside", "j15_resolve_uuid"):
        QUERIES[name](spark, small)


def test_cleanup_leaves_repeats_in_the_order_of_its_join(spark):
    wanted = spark.createDataFrame([("a", "power_off", "m"), ("a", "power_off", "m"), ("a", "power_off", "n"), ("a", "remove_vip", "vip"),
                                    ("b", "power_off", None), ("b", "power_off", None)], "k string, step string, item string")
    states = spark.createDataFrame([("a", (["n"], None, None, None, True))], "k string, cleanup_progress struct<power_off_completed:array<string>,"
                                   "iso_unmapped:array<string>,nfs_unmounted:array<string>,services_removed:array<string>,vip_removed:boolean>")
    out = planning.cleanup_remaining(states, wanted, ["k"])
    assert rows(out) == sorted([("a", "power_off", "m"), ("b", "power_off", None)], key=repr)
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
