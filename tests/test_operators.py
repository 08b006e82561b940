"""Operators on small hand-made tables, and properties that hold for any input."""

from pyspark.sql import functions as F

from fleetlens.functions import net, text, times
from fleetlens.operators import capacity, desired, history, logs, matching, planning, rules
from tests.conftest import rows


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_addresses(spark):
    good = ["10.0.0.1", "255.255.255.255", "::", "::1", "fe80::1:2", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "1::8"]
    bad = ["", "x", "10.0.0", "10.0.0.256", "010.0.0.1", "1.2.3.4.5", ":::", "1:2:3", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9"]
    df = column(spark, good + bad + [None])
    assert values(df, net.is_ip(F.col("x"))) == [True] * len(good) + [False] * (len(bad) + 1)


def test_networks(spark):
    df = spark.createDataFrame([
        ("10.0.0.0/8", "10.1.2.3"), ("10.0.0.0/8", "11.0.0.1"), ("0.0.0.0/0", "1.1.1.1"), ("10.0.0.7/32", "10.0.0.7"),
        ("10.0.0.0/33", "10.0.0.1"), ("10.0.0.0/8", "::1"), ("fd00::/8", "fd00::1"), ("10.0.0.0/8", "x")],
        "c string, i string")
    got = [r["inside"] for r in net.with_inside(df, "inside", "c", "i").collect()]
    assert got == [True, False, True, True, None, False, True, None]
    masks = values(column(spark, ["10.0.0.0/20", "10.0.0.0/0", "bad"]), net.cidr_netmask(F.col("x")))
    assert masks == ["255.255.240.0", "0.0.0.0", "255.255.255.0"]


def test_durations(spark):
    df = column(spark, ["1h2m3.5s", "250ms", "-2s", "0s", "1.5h", "3µs", "5", "1h x", None])
    got = values(df, times.duration_seconds(F.col("x")))
    assert [None if v is None else round(v, 6) for v in got] == [3723.5, 0.25, -2.0, 0.0, 5400.0, 3e-06, None, None, None]
    assert values(column(spark, [3720, 123, 3, 0, 86400], "int"), times.human_duration(F.col("x"))) == [
        "1h 2m", "2m 3s", "3s", "0s", "24h 0m"]


def test_elapsed_forms(spark):
    df = spark.createDataFrame([
        ("failed", "2026-01-01T00:00:00Z", ""), ("in_progress", "2026-01-01T00:00:00Z", ""),
        ("in_progress", "2026-01-03T00:00:00Z", ""), ("completed", "2026-01-01T00:00:00Z", "2026-01-01T00:01:05.9Z"),
        ("completed", "bad", "")], "status string, start_time string, end_time string")
    out = times.with_elapsed(df, F.lit("2026-01-02T00:00:00Z").cast("timestamp"), listed="l", detailed="d")
    got = [(r["l"], r["d"]) for r in out.collect()]
    assert got[0] == ("N/A", "N/A") and got[1] == ("24h 0m*", "24h 0m*") and got[3] == ("1m 5s", "1m 5s")
    assert got[2][0].endswith("*") and got[2][1] == "N/A" and got[4] == ("N/A", "N/A")


def test_text_helpers(spark):
    df = column(spark, ["https://h/a/f.tgz?sig=1/2"])
    assert values(df, text.url_basename(F.col("x"))) == ["f.tgz"]
    assert values(column(spark, ["", "ab", "g" * 64, "A" * 64]), text.checksum_problem(F.col("x"))) == [None, "length", "hex", None]


MARKS = "controller_id string, cluster_name string, managed boolean, failed boolean, deleted boolean, vip string"


def test_vip_conflicts_match_brute_force(spark):
    data = [("c", f"k{i:03d}", i % 3 == 0, i % 5 == 0, i % 7 == 0, "" if i % 11 == 0 else f"v{min(i % 4, 1)}")
            for i in range(80)]
    df = spark.createDataFrame(data, MARKS)
    got = {r["cluster_name"]: r["held_by"] for r in matching.vip_conflicts(df, matching.active(df)).collect()}
    want = {}
    for _, name, _, _, _, vip in data:
        others = sorted(n for _, n, m, f, d, v in data if v == vip != "" and n != name and (m or f) and not d)
        if others:
            want[name] = others[0]
    assert got == want


def test_leases_exact_and_substring(spark):
    leases = spark.createDataFrame([("c", "1 aa:bb:cc:dd:ee:01 10.0.0.1 h *"), ("c", "1 aa:bb:cc:dd:ee:02 10.0.0.10 h *"),
                                    ("c", "1 aa:bb:cc:dd:ee:03 10.0.0.2 h 01:aa:bb:cc:dd:ee:04"),
                                    ("c", "1 fd:00 fd00::1 h *")], "controller_id string, line string")
    nodes = spark.createDataFrame([("c", "", "10.0.0.1"), ("c", "AA-BB-CC-DD-EE-04", ""), ("c", "", "fd00::1")],
                                  "controller_id string, mac string, ip string")
    lines = [r["line"] for r in leases.collect()]
    exact = {r["line"] for r in matching.purge_leases(leases, nodes).collect()}
    loose = {r["line"] for r in matching.purge_leases(leases, nodes, "substring").collect()}
    assert exact == {lines[0], lines[3]}
    assert loose == {x for x in lines if any(s in x for s in ("10.0.0.1", "aa:bb:cc:dd:ee:04", "fd00::1"))} == set(lines)


def test_scale_partitions_workers(spark):
    key = ("cluster_name",)
    found = spark.createDataFrame([("k", "a", "worker"), ("k", "b", "worker"), ("k", "m", "master")],
                                  "cluster_name string, hostname string, role string")
    new = spark.createDataFrame([("k", "b", "worker"), ("k", "c", "worker"), ("k", "d", "worker")],
                                "cluster_name string, hostname string, role string")
    state = spark.createDataFrame([("k", ["ready_b", "booted_d"])], "cluster_name string, completed_phases array<string>")
    live = spark.createDataFrame([], "cluster_name string, name string, ready string")
    down = matching.scale_down(found, new, key)
    up = matching.scale_up(new, state, live, key)
    assert rows(down, "hostname") == [("a",)]
    assert rows(up, "hostname", "action", "pending_boot") == [("c", "add", True), ("d", "add", False)]
    seen = {r["hostname"] for r in down.union(up.select(found.columns)).collect()} | {"b"}
    assert seen == {"a", "b", "c", "d"}


STATE = ("controller_id string, cluster_name string, status string, end_time string, state_version int, "
         "completed_phases array<string>, completed_events array<string>, failed_events array<string>")


def test_repair_is_idempotent_and_keeps_invalid_status(spark):
    df = spark.createDataFrame([("c", "a", "", "x", 0, ["p"], ["a", "b", "a"], None), ("c", "b", None, None, None, None, None, None),
                                ("c", "d", "odd", None, 2, [], ["z"], ["q"])], STATE)
    once = planning.repair(df)
    assert rows(once) == rows(planning.repair(once))
    assert rows(once, "cluster_name", "status", "completed_events") == [
        ("a", "completed", ["a", "b"]), ("b", "in_progress", []), ("d", "odd", ["z"])]


def test_resume_plans(spark):
    every = list(planning.PHASE_ORDER)
    df = spark.createDataFrame([
        ("c", "gap", "failed", None, 2, ["discovery", "services"], [], []), ("c", "all", "failed", None, 2, every, [], []),
        ("c", "lost", "failed", None, 2, every, [], []), ("c", "new", "in_progress", None, 2, [], [], [])], STATE)
    have = spark.createDataFrame([("c", n, n != "lost", True) for n in ("gap", "all", "lost", "new")],
                                 "controller_id string, cluster_name string, has_installer boolean, has_install_dir boolean")
    got = {r["cluster_name"]: r["plan"] for r in planning.resume_plan(df, have).collect()}
    assert got == {"gap": ["downloads", "ignition", "boot", "wait"], "all": [], "lost": ["downloads"], "new": every}


def test_state_rules_report_repeats_and_ready_markers(spark):
    df = spark.createDataFrame([("k", ["ready_w0", "booted_w0", "boot"], ["a", "b", "a", "a"])],
                               "cluster_name string, completed_phases array<string>, completed_events array<string>")
    assert rows(rules.phase_rules(df, ["cluster_name"]), "rule_id", "message") == [("R72", "unknown completed phase: ready_w0")]
    assert rules.phase_rules(df, ["cluster_name"], ("booted_", "ready_")).count() == 0
    assert rows(rules.event_rules(df, ["cluster_name"]), "message") == [("duplicate completed event: a",)] * 2


def test_head_tail_limits(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 20), ("b", 21), ("c", 3)) for i in range(n)], "g string, i int")
    out = history.head_tail(df, ["g"], ["i"])
    got = {g: sorted((r["i"], r["omitted"]) for r in out.filter(F.col("g") == g).collect()) for g in "abc"}
    assert [i for i, _ in got["a"]] == list(range(20)) and got["a"][0][1] == 0
    assert [i for i, _ in got["b"]] == [*range(10), *range(11, 21)] and got["b"][0][1] == 1
    assert [i for i, _ in got["c"]] == [0, 1, 2]


def test_keep_last_ignores_input_order_and_overlay_is_idempotent(spark):
    df = spark.createDataFrame([("a", i, f"v{i}") for i in range(9)] + [("b", 1, None)], "k string, ord int, v string")
    want = [("a", 8, "v8"), ("b", 1, None)]
    assert rows(history.keep_last(df, ["k"], ["ord"])) == rows(history.keep_last(df.orderBy(F.rand(3)), ["k"], ["ord"])) == want
    last = history.keep_last(df, ["k"], ["ord"])
    assert rows(matching.overlay(last, last, ["k"])) == rows(last)


def test_reconcile_actions(spark):
    kind = "k string, v string"
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], kind)
    have = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], kind)
    assert rows(desired.reconcile(want, have, ["k"]), "k", "action") == [
        ("a", "add"), ("b", "change"), ("c", "same"), ("d", "remove")]


def test_media_capacity(spark):
    nodes = spark.createDataFrame([("c", "k", "s1")] * 3 + [("c", "k", "s2")] * 8,
                                  "controller_id string, cluster_name string, system_name string")
    need = capacity.media_need(nodes)
    assert rows(need, "system_name", "need_mb", "create_mb", "boot_create_mb") == [
        ("s1", 4608, 10240, 16896), ("s2", 12288, 12288, 16896)]
    vgs = spark.createDataFrame([("v", 0, "ROOTVG", "99"), ("v", 1, "data", "11.5"), ("v", 2, "big", "50"), ("v", 3, "odd", "n/a")],
                                "vios_uuid string, ord int, group_name string, free_space string")
    ask = spark.createDataFrame([("x", "v", 10.0), ("y", "v", 12.0), ("z", "v", 60.0), ("none", "v", 100.0)],
                                "q string, vios_uuid string, need_gb double")
    assert rows(capacity.pick_vg(vgs, ask, ["q"], ["vios_uuid"])) == [("x", "data"), ("y", "big"), ("z", "ROOTVG")]


def test_redaction_leaves_no_token(spark):
    token = "s3cr3t$1\\x"
    df = spark.createDataFrame([(f"hdr {token} <x-api-session>{token}</X-API-SESSION> and <X-API-Session>other</X-API-Session>",
                                 token, None), ("<X-API-Session>a\nb</X-API-Session>", "", "b")],
                               "line string, sent string, got string")
    out = [r["line"] for r in logs.redact(df, "line", ["sent", "got"]).collect()]
    assert token not in out[0] and "other" not in out[0] and out[0].count(logs.REDACTED) == 3
    assert out[1] == f"<X-API-Session>a\n{logs.REDACTED}</X-API-Session>"


def test_first_class_wins(spark):
    df = column(spark, ["Unauthorized: no space left on device", "NO SPACE left on device", "fine"])
    got = logs.classify(df, "x", "mirror")
    assert [r["error_class"] for r in got.collect()] == ["auth", "disk_full", None]


def test_segments_and_blocks(spark):
    lines = ["boot", "=== one ===", "a", "=== TOOL OUTPUT ===", "b", "====================", "=== two ==="]
    df = spark.createDataFrame([("k", "f", i, t) for i, t in enumerate(lines)],
                               "cluster_name string, file string, line_no int, text string")
    got = rows(logs.segment_log(df), "segment", "title", "first_line", "last_line", "lines")
    assert got == [(0, None, 0, 0, 1), (1, "one", 1, 2, 2), (2, "TOOL OUTPUT", 3, 5, 3), (3, "two", 6, 6, 1)]
    assert got == rows(logs.segment_log(df, slices=7), "segment", "title", "first_line", "last_line", "lines")


def test_pairs_flag_overlap(spark):
    arrows = ["[HMC →] GET u", "[HMC ←] 200 OK u", "[HMC →] GET u", "[HMC →] GET u", "[HMC ←] 200 OK u", "[HMC ✗] GET u — gone: now",
              "[HMC →] PUT u"]
    df = spark.createDataFrame([("k", i, i, t) for i, t in enumerate(arrows)],
                               "cluster_name string, line_no int, at int, text string")
    got = rows(logs.pair_requests(logs.request_lines(df)), "turn", "opened_at", "closed_at", "failed", "ambiguous", "unanswered")
    assert got == [(1, 0, 1, False, False, False), (2, 2, 4, False, True, False), (3, 3, 5, True, True, False),
                   (4, 6, None, False, False, True)]


def test_stale_media(spark):
    uuid = "0123ABCD-0000-0000-0000-00000000000"
    maps = spark.createDataFrame([("n1", "m1", "v", uuid + "1"), ("n2", "m1", "v", uuid + "2"), ("n3", "m1", "v", uuid + "3")],
                                 "node_name string, media_name string, vios_uuid string, lpar_uuid string")
    drive = spark.createDataFrame([("v", "https://h/" + uuid.lower() + "1", "m1"), ("v", "https://h/" + uuid + "2", "old"),
                                   ("v", "https://h/" + uuid + "1", ""), ("v", "https://h/" + uuid + "1", "x"), ("v", "short", "m9")], "vios_uuid string, lpar_href string, media_name string")
    assert rows(matching.stale_media(maps, drive), "node_name", "status") == [("n1", "mapped"), ("n2", "stale"), ("n3", "absent")]


def test_name_collision_words(spark):
    names = ("prod", "prod-east", "east", "10-prod", "dns")
    clusters = spark.createDataFrame([("c", n) for n in names], "controller_id string, cluster_name string")
    paths = spark.createDataFrame([("c", "/etc/dnsmasq.d/10-prod-east-dns.conf"), ("c", "/etc/dnsmasq.d/dns.conf"),
                                   ("c", "/etc/dnsmasq.d/a-dns.conf")], "controller_id string, path string")
    assert rows(matching.name_collisions(clusters, paths), "cluster_name") == [("east",), ("prod",), ("prod-east",)]


def test_values_are_compared_one_by_one(spark):
    want = spark.createDataFrame([("api", "1"), ("api", "2"), ("n", None)], "k string, v string")
    have = spark.createDataFrame([("api", "2"), ("n", None), ("old", "3")], "k string, v string")
    assert rows(desired.reconcile_values(want, have, ["k"]), "k", "action") == [
        ("api", "add"), ("api", "same"), ("n", "same"), ("old", "remove")]


def test_ports_meet_few_rows(spark):
    kind = "controller_id string, cluster_name string, port int, proto string, owner string, own_addr string"
    ports = spark.createDataFrame([("c", "a", 80, "tcp", "haproxy", "10.0.0.1"), ("c", "b", 80, "tcp", "", "10.0.0.2"),
                                   ("c", "d", 53, "udp", "dnsmasq", "10.0.0.3")], kind)
    held = [("c", "tcp", 80, "10.0.0.1", "HAProxy"), ("c", "tcp", 80, "*", "haproxy"), ("c", "udp", 53, "10.0.0.9", "named")]
    sockets = spark.createDataFrame(held, "controller_id string, proto string, port int, local_addr string, process string")
    assert rows(matching.port_collisions(ports, sockets), "cluster_name") == [("b",)]
    more = sockets.unionByName(spark.createDataFrame([("c", "udp", 53, "10.0.0.3", "x"), ("c", "tcp", 80, "10.0.0.1", "nginx")],
                                                     sockets.schema))
    assert rows(matching.port_collisions(ports, more), "cluster_name") == [("a",), ("b",), ("d",)]
