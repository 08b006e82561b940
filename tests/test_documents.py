"""Hand-made documents, one small case per quirk."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import resolve, rules
from fleetlens.plans import reports
from fleetlens.schemas import CONFIG
from fleetlens.sources import documents, sinks, snapshots
from tests.conftest import rows

NODE = "    - name: {0}\n      ip: {1}\n      existing_lpar_name: {2}\n      system_name: s1\n"


def config(name, *, isolation="connected", services="", version="4.21.18", boot="agent", masters=3, workers=0,
           bootstrap=0, extra_nodes="", password="real"):
    nodes = ""
    for role, count in (("bootstrap", bootstrap), ("masters", masters), ("workers", workers)):
        if count:
            nodes += f"  {role}:\n" + "".join(
                NODE.format(f"{role}{i}", f"10.0.{ord(role[0])}.{i + 10}", f"l-{role}-{i}") for i in range(count))
    return (f"services:\n{services}network:\n  isolation_level: {isolation}\n  controller_interface: eth0\n"
            "  machine_network_cidr: 10.0.0.0/16\n  gateway: 10.0.0.1\n  dns_forwarders: [8.8.8.8]\n"
            f"openshift:\n  cluster_name: {name}\n  version: {version}\n  base_domain: b.local\n"
            "  pull_secret_file: p\n  ssh_public_key_file: k\n"
            f"hmc:\n  ip: 10.9.9.9\n  username: u\n  password: {password}\nnodes:\n  boot_method: {boot}\n{nodes}{extra_nodes}")


@pytest.fixture(scope="module")
def parsed(spark):
    texts = {
        "plain": config("plain"),
        "empty-proxy": config("empty-proxy", services="  proxy: {}\n"),
        "away-proxy": config("away-proxy", services="  proxy:\n    external_http_proxy: http://p\n"),
        "order": config("order", isolation="air-gapped", services="  proxy: {}\n"),
        "gap": config("gap", isolation="air-gapped", version="4.20"),
        "odd": config("odd", isolation="foo"),
        "single": config("single", masters=1, workers=2),
        "one": config("one", masters=1),
        "five": config("five", masters=5, workers=2, bootstrap=1, boot="netboot"),
        "placeholder": config("placeholder", password="YOUR_HMC_PASSWORD"),
        "bad": "a: [",
    }
    data = [("c1", "10.0.0.2", name, text) for name, text in texts.items()]
    raw = spark.createDataFrame(data, "controller_id string, controller_ip string, directory string, raw string")
    return documents.parse_configs(raw)


@pytest.fixture(scope="module")
def flat(parsed):
    return resolve.flatten(parsed.filter("_error is null"))


def by_name(df, *columns):
    return {r["cluster_name"]: tuple(r[c] for c in columns) for r in df.select("cluster_name", *columns).collect()}


def test_absent_empty_and_external_blocks(flat):
    got = by_name(resolve.with_managed_flags(flat), "proxy_present", "proxy_managed", "dns_managed")
    assert got["plain"] == (False, False, True)
    assert got["empty-proxy"] == (True, True, True)
    assert got["away-proxy"] == (True, False, True)


def test_resolver_order_and_versions(flat):
    got = by_name(resolve.resolve_defaults(flat), "isolation", "release_image", "registry_managed", "vip")
    assert got["order"][0] == "restricted-network"
    assert got["odd"][0] == "connected"
    assert got["gap"][0] == "air-gapped" and got["gap"][1].endswith(":4.20.0-ppc64le") and got["gap"][2]
    assert got["plain"] == ("connected", "", False, "10.0.0.2")


def test_bad_document_keeps_its_row(parsed):
    bad = parsed.filter("_error is not null").select("directory", "openshift").collect()
    assert [tuple(r) for r in bad] == [("bad", None)]


def test_placeholder_password_is_not_set(flat):
    got = by_name(flat, "hmc_password_set")
    assert got["plain"] == (True,) and got["placeholder"] == (False,)


def test_structure_stops_other_node_rules(flat):
    out = reports.preflight(resolve.resolve_defaults(flat))
    node_rules = [f"R{i}" for i in (*range(27, 50),)]
    got = {}
    for r in out.filter(F.col("rule_id").isin(node_rules)).collect():
        got.setdefault(r["cluster_name"], set()).add(r["rule_id"])
    assert got["single"] == {"R27"}
    assert got["five"] == {"R42"}
    assert "one" not in got and "plain" not in got


def test_duplicates_name_the_previous_holder(spark):
    nodes = spark.createDataFrame(
        [("c", "k", i, h, ip, lp) for i, (h, ip, lp) in enumerate([
            ("a", "1", "x"), ("b", "1", "y"), ("c", "1", "x"), ("d", "", "z"), ("e", "", "w")])],
        "controller_id string, cluster_name string, ord int, hostname string, ip string, lpar_name string")
    got = sorted(r["message"] for r in rules.duplicate_rules(nodes, ("controller_id", "cluster_name")).collect())
    assert got == ["duplicate address 1: a, b", "duplicate address 1: b, c", "duplicate address : d, e",
                   "duplicate partition x: a, c"]


def test_worker_with_bad_address_passes_syntax_and_network(spark):
    n = spark.createDataFrame([("w", "worker", 0, "x", "l", "s", "10.0.0.0/16"), ("m", "master", 0, "x", "l", "s", "10.0.0.0/16")],
                              "hostname string, role string, role_ord int, ip string, lpar_name string, system_name string, "
                              "machine_cidr string")
    got = rules.check(rules.node_facts(n), rules.node_rules(), ["hostname"]).select("hostname", "rule_id").collect()
    assert [tuple(r) for r in got] == [("m", "R47")]


def test_files_states_markers_and_listing(spark, tmp_path):
    now = F.lit("2026-06-23T00:00:00Z").cast("timestamp")
    states = {
        "done": {"state_version": 2, "cluster_name": "done", "status": "completed", "start_time": "2026-06-22T02:00:00+05:30",
                 "end_time": "2026-06-22T03:00:00+05:30", "completed_phases": ["boot"], "completed_events": ["a", "b", "a"]},
        "failed": {"cluster_name": "failed", "status": "failed", "start_time": "2026-06-22T02:00:00Z"},
        "blank": {"cluster_name": "blank", "start_time": "2026-06-22T02:00:00Z"},
    }
    for name in ("done", "failed", "blank", "torn", "gone"):
        folder = tmp_path / "fleet" / name
        os.makedirs(folder)
        (folder / "config.yaml").write_text(config(name))
        (folder / "state.json").write_text(json.dumps(states[name], indent=1) if name in states else '{"status": ')
    (tmp_path / "fleet" / "gone" / ".deleted").write_text("x")
    (tmp_path / "fleet" / "done" / ".managed").write_text("x")
    (tmp_path / "fleet" / "done" / ".lock").write_text("Locked at: 2026-06-22T02:00:00+02:00\nPID: 77\n")

    root = f"{tmp_path}/fleet/*"
    own = [F.lit("c1").alias("controller_id"), F.col("directory").alias("cluster_name")]
    st = documents.read_states(spark, f"{root}/state.json")
    st = st.select(*own, *[c for c in st.columns if c not in ("directory", "cluster_name")])
    marks = documents.read_markers(spark, f"{tmp_path}/fleet").withColumn("controller_id", F.lit("c1"))
    cfg = documents.read_configs(spark, f"{root}/config.yaml")
    cfg = resolve.flatten(cfg.withColumns({"controller_id": F.lit("c1"), "controller_ip": F.lit("10.0.0.2")}))
    listed = by_name(reports.fleet_list(cfg, st, marks, now), "status", "duration", "type", "network")
    assert listed == {
        "done": ("completed", "1h 0m", "Multi (agent)", "Connected"),
        "failed": ("failed", "N/A", "Multi (agent)", "Connected"),
        "blank": ("in_progress", "22h 0m*", "Multi (agent)", "Connected"),
        "torn": ("unknown", "N/A", "N/A", "N/A")}
    updated = by_name(reports.fleet_list(cfg, st, marks, now), "last_updated")
    assert updated["done"] == ("2026-06-22 03:00:00",)

    locks = documents.read_locks(spark, f"{tmp_path}/fleet")
    assert [(r["cluster_name"], r["lock_pid"]) for r in locks.collect()] == [("done", 77)]
    flags = by_name(marks, "managed", "deleted", "locked")
    assert flags["done"] == (True, False, True) and flags["gone"] == (False, True, False)

    out = f"{tmp_path}/report"
    sinks.write_report(reports.fleet_counts(marks), out, "json")
    assert spark.read.json(out).select("visible", "prunable").first() == (4, 1)


def test_manifest_names_match_whole(spark, tmp_path):
    os.makedirs(tmp_path / "m" / "c1")
    (tmp_path / "m" / "c1" / "sha256sum.txt").write_text("h1  my-kernel\nh2  kernel\nlone\nh3 *  kernel\n")
    got = snapshots.read_manifests(spark, f"{tmp_path}/m/*/sha256sum.txt")
    assert rows(got) == [("c1", "kernel", "h2"), ("c1", "my-kernel", "h1")]


def test_host_files_and_listing(spark, tmp_path):
    host = tmp_path / "hosts" / "c1"
    os.makedirs(host)
    (host / "sockets.txt").write_text('LISTEN 0 128 [::]:53 [::]:* users:(("named",pid=1,fd=2))\n')
    (host / "addrs.txt").write_text("2: eth0    inet 10.0.0.5/24 brd 10.0.0.255 scope global eth0\n")
    (host / "disk.txt").write_text("/var/www/html 123K\n/opt/registry ?\n")
    (host / "ping.txt").write_text("10.0.0.1 0\n10.0.0.2 1\n")
    read = {k: snapshots.read_host(spark, k, f"{tmp_path}/hosts/*/{k}.txt") for k in ("sockets", "addrs", "disk", "ping")}
    assert rows(read["sockets"], "controller_id", "local_addr", "port") == [("c1", "[::]", 53)]
    assert rows(read["addrs"], "iface", "ip", "prefix") == [("eth0", "10.0.0.5", 24)]
    assert rows(read["disk"], "mount", "avail_kb") == [("/opt/registry", None), ("/var/www/html", 123)]
    assert rows(read["ping"], "ip", "alive") == [("10.0.0.1", True), ("10.0.0.2", False)]
    files = snapshots.read_files(spark, f"{tmp_path}/hosts")
    assert files.count() == 4 and files.columns == ["path", "length", "mtime"]


def test_snapshot_history_is_dated(spark, tmp_path):
    df = spark.sql("select 'a' as cluster_name, timestamp'2026-01-02 03:04:05' as snapshot_ts")
    sinks.append_snapshot(df, f"{tmp_path}/h")
    sinks.append_snapshot(df, f"{tmp_path}/h")
    assert rows(spark.read.parquet(f"{tmp_path}/h"), F.col("snapshot_date").cast("string")) == [("2026-01-02",)] * 2


def test_scalars_stay_as_written_and_errors_stay_in_their_row(spark):
    good = ("openshift: {cluster_name: on, version: 4.20, cluster_network_host_prefix: 23, force_ocp_download: yes}\n"
            "nodes: {workers: [{name: 010, mac_address: 10:20:30:40:50:55, ip: ~, system_name: '~'}]}\n")
    bad = ["a: &x {b: *x}", "nodes: {boot_method: a, boot_method: b}", "openshift: {cluster_network_host_prefix: abc}",
           "services: [1]", "openshift: {force_ocp_download: 'yes'}", "[1]", "a: [", "openshift: {version: {a: 1}}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, *bad, "", None])], "i int, raw string")
    out = {r["i"]: r for r in documents.parse_configs(df).collect()}
    first = out[0]
    assert first["_error"] is None and first["openshift"]["cluster_name"] == "on" and first["openshift"]["version"] == "4.20"
    assert first["openshift"]["cluster_network_host_prefix"] == 23 and first["openshift"]["force_ocp_download"] is True
    worker = first["nodes"]["workers"][0]
    assert (worker["name"], worker["mac_address"], worker["ip"], worker["system_name"]) == ("010", "10:20:30:40:50:55", None, "~")
    assert all(out[i]["_error"] and out[i]["openshift"] is None for i in range(1, len(bad) + 1))
    assert all(out[i]["_error"] is None for i in (len(bad) + 1, len(bad) + 2))


def test_scalars_are_not_visited_when_keys_are_checked(spark, monkeypatch):
    seen, check = [], documents._check
    monkeypatch.setattr(documents, "_check", lambda node, *more: (seen.append(node.id), check(node, *more))[1])
    text = "hmc: {ip: ~, username: 'null'}\nnodes:\n  masters:\n    - {name: null, ip: a}\n"
    got, error = documents._yaml_to_json(text, T.StructType.fromDDL(CONFIG))
    assert error is None and json.loads(got) == {"hmc": {"ip": None, "username": "null", "password_set": False},
                                                 "nodes": {"masters": [{"name": None, "ip": "a"}]}}
    assert "scalar" not in seen and len(seen) == 5
