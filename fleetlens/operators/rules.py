"""The rule engine and its rule packs (R01-R77), roll-up (A3).

A rule is a predicate and a message, both Columns.  ``check`` evaluates all
rules of a pack in one projection over the input, so adding a rule never adds a
scan.  A null predicate counts as no violation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.collections import let
from fleetlens.functions.net import address_facts, inside, network_facts
from fleetlens.functions.text import blank, kb_to_gb
from fleetlens.operators.ordered import ordered

# Limits and placeholders.
DISK_GB = 10.0
REGISTRY_DISK_GB = 40.0
PLACEHOLDER_REGISTRY = "registry.example.com"
STATUSES = ("in_progress", "completed", "failed", "deleted")
PHASES = ("discovery", "downloads", "services", "ignition", "boot", "wait", "iso_cleanup")
LB_PORTS = (6443, 22623, 443, 80)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    when: Column
    message: Column
    severity: str = "E"


def rule(rule_id: str, when: Column, *message: Column | str, severity: str = "E") -> Rule:
    parts = [m.cast("string") if isinstance(m, Column) else F.lit(m) for m in message]
    return Rule(rule_id, when, F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), severity)


def check(df: DataFrame, rules: Iterable[Rule], entity: Sequence[str], *more: Column) -> DataFrame:
    """Violations as ``entity..., rule_id, severity, message`` rows, in one pass.

    ``more`` are arrays of (rule_id, severity, message) that a row has besides.
    """
    hits = [F.when(F.coalesce(r.when, F.lit(False)), F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), r.message.alias("message")))
        for r in rules]
    found = F.array_compact(F.array(*hits))
    return df.select(*entity, F.inline(F.concat(found, *more) if more else found))


def _empty(name: str) -> Column:
    return F.col(name) == ""


def config_facts(resolved: DataFrame) -> DataFrame:
    """Parse each configuration's network and addresses once, for ``config_rules``."""
    return resolved.withColumns({
        **network_facts(F.col("machine_cidr")), **address_facts(F.col("vip"), "_vip"),
        **address_facts(F.col("gateway"), "_gateway")})


def node_facts(nodes: DataFrame) -> DataFrame:
    """Parse each node's network and address once, for ``node_rules`` and ``scale_rules``."""
    return nodes.withColumns({**network_facts(F.col("machine_cidr")), **address_facts(F.col("ip"))})


def config_rules() -> list[Rule]:
    """Row rules over resolved configurations with ``config_facts``.

    A missing or invalid network stops the rules that need it (R09-R14), which
    is written here as a guard in their predicates.
    """
    c = F.col
    net, vip, gateway, isolation = c("machine_cidr"), c("vip"), c("gateway"), c("isolation")
    usable = c("_net_ok")
    agent = c("boot_method") == "agent"

    def outside(name: str) -> Column:
        bad = ~c(f"_{name}_ok") | (inside(ip=f"_{name}") == F.lit(False))
        return usable & (c(name) != "") & bad

    return [
        rule("R01", _empty("interface"), "controller interface is empty"),
        rule("R02", (vip != "") & ~c("_vip_ok"), "vip is no address: ", vip),
        rule("R03", _empty("hmc_ip"), "hypervisor address is empty"),
        rule("R04", _empty("hmc_user"), "hypervisor user is empty"),
        rule("R05", ~c("hmc_password_set"), "hypervisor password is not set"),
        rule("R06", _empty("base_domain"), "base domain is empty"),
        rule("R07", net == "", "machine network is empty"),
        rule("R08", (net != "") & ~usable, "machine network is invalid: ", net),
        rule("R09", outside("gateway"), "gateway ", gateway, " is outside ", net),
        rule("R10", outside("vip"), "vip ", vip, " is outside ", net),
        rule("R11", usable & (gateway == ""), "gateway is empty"),
        rule("R12", usable & c("dns_managed") & (F.size("dns_forwarders") == 0), "no forwarders for managed dns"),
        rule("R13", usable & ~c("dns_managed") & _empty("dns_external"), "external dns is empty"),
        rule("R15", _empty("version"), "version is empty"),
        rule("R16", ~c("release_type").isin("official", "ci"), "unknown release type: ", c("release_type")),
        rule("R17", _empty("pull_secret"), "pull secret path is empty"),
        rule("R18", _empty("ssh_key"), "ssh key path is empty"),
        rule("R19", _empty("client_url"), "client address is empty"),
        rule("R20", _empty("installer_url"), "installer address is empty"),
        rule("R21", ~agent & _empty("kernel_url"), "kernel address is empty"),
        rule("R22", ~agent & _empty("initramfs_url"), "initramfs address is empty"),
        rule("R23", ~agent & _empty("rootfs_url"), "rootfs address is empty"),
        rule("R24", ~isolation.isin("connected", "restricted-network", "air-gapped"), "unknown isolation: ", isolation),
        rule("R25", (isolation == "air-gapped") & ~c("registry_managed") & (c("registry_external") == PLACEHOLDER_REGISTRY),
             "registry is still the placeholder"),
        rule("R26", (isolation == "restricted-network") & ~c("proxy_managed") & _empty("proxy_http"),
             "restricted network without proxy"),
    ]


def topology_problem() -> Column:
    """The first structural problem, which stops every later node rule."""
    masters, workers, boots = F.size("masters"), F.size("workers"), F.size("bootstrap")
    single = masters == 1
    return (F.when(single & ((workers > 0) | (boots > 0)), F.lit("R27"))
            .when(single, F.lit(None).cast("string"))
            .when(masters < 3, F.lit("R28"))
            .when(masters % 2 == 0, F.lit("R29"))
            .when((F.col("boot_method") == "netboot") & (boots == 0), F.lit("R30"))
            .when((F.col("boot_method") == "agent") & (boots > 0), F.lit("R31")))


_TOPOLOGY_TEXT = {
    "R27": "one master together with other nodes",
    "R28": "fewer than three masters",
    "R29": "even number of masters",
    "R30": "netboot without bootstrap node",
    "R31": "agent boot with bootstrap node",
}


def topology_rules() -> list[Rule]:
    """Shape of the node lists, and rules that depend on it being sound."""
    problem = topology_problem()
    sound = problem.isNull()
    masters, workers, boots = F.size("masters"), F.size("workers"), F.size("bootstrap")
    many = sound & (masters != 1)
    agent, netboot = F.col("boot_method") == "agent", F.col("boot_method") == "netboot"
    away = ~F.col("nfs_managed")
    return [
        *[rule(rid, problem == rid, text) for rid, text in _TOPOLOGY_TEXT.items()],
        rule("R32", sound & agent & away, "agent boot without managed nfs"),
        rule("R33", sound & away & (F.col("nfs_path") == ""), "external nfs without path"),
        rule("R41", many & netboot & (boots != 1), "netboot needs one bootstrap node, found ", boots),
        rule("R42", many & netboot & (masters != 3), "netboot needs three masters, found ", masters),
        rule("R43", many & netboot & (workers < 2), "netboot needs two workers, found ", workers),
        rule("R44", many & agent & (boots > 0), "agent boot takes no bootstrap node, found ", boots),
        rule("R45", many & agent & (masters < 3), "agent boot needs three masters, found ", masters),
        rule("R46", many & agent & (masters >= 3) & (masters % 2 == 0), "master count must be odd, found ", masters),
    ]


def node_rules() -> list[Rule]:
    """Row rules over exploded nodes with ``node_facts``.

    Workers and bootstrap nodes get no address syntax check.
    """
    c = F.col
    role, ip, net = c("role"), c("ip"), c("machine_cidr")
    place = F.concat(F.when(role == "master", "masters").when(role == "worker", "workers").otherwise("bootstrap"),
                     F.lit("["), c("role_ord").cast("string"), F.lit("]"))
    sno = role == "sno"
    out = [
        rule("R37", c("_net_ok") & c("_ip_ok") & (inside() == F.lit(False)),
             "node ", c("hostname"), " address ", ip, " is outside ", net),
        rule("R38", sno & ~c("_ip_ok"), "single node address is empty or invalid: ", ip),
        rule("R39", sno & (c("system_name") == ""), "single node system is empty"),
        rule("R40", sno & (c("lpar_name") == ""), "single node partition is empty"),
    ]
    for rid, name in (("R47", "master"), ("R48", "bootstrap"), ("R49", "worker")):
        here = role == name
        out += [rule(rid, here & (c(field) == ""), place, f" {label} is empty") for field, label in (
            ("hostname", "name"), ("system_name", "system"), ("ip", "address"), ("lpar_name", "partition"))]
        if name == "master":
            out.append(rule(rid, here & (ip != "") & ~c("_ip_ok"), place, " address is invalid: ", ip))
    return out


_DUPLICATES = {"R34": ("ip", "address"), "R35": ("hostname", "hostname"), "R36": ("lpar_name", "partition")}


def duplicates(df: DataFrame, scope: Sequence[str], key: str, order: Sequence[str], label: str,
               slices: int | None = None) -> DataFrame:
    """Rows that repeat a key within a scope, with the previous holder's label."""
    seen = ordered(df, [*scope, key], list(order), previous={"previous_holder": label}, rank="occurrence",
                   slices=slices)
    return seen.filter(F.col("occurrence") > 1)


def document_duplicates(nodes: Column) -> Column:
    """R34-R36 within one document, as an array of violations; ``nodes`` are its ``node_entries``.

    Each of the three keys is sorted with the node's place, so that repeats are
    neighbours: a document of n nodes costs n log n and no row leaves it.
    """
    def repeats(rid: str, field: str, kind: str) -> Column:
        place = F.transform(nodes, lambda n, i: F.struct(
            blank(n["node"][field]).alias("key"), i.alias("ord"), blank(n["node"]["name"]).alias("hostname")))

        def twice(s: Column) -> Column:
            same = F.filter(F.transform(s, lambda n, i: F.struct(
                n.alias("n"), F.get(s, i - 1).alias("before"))), lambda p: p["n"]["key"] == p["before"]["key"])
            return F.transform(same, lambda p: F.struct(
                F.lit(rid).alias("rule_id"), F.lit("E").alias("severity"), F.concat(
                    F.lit(f"duplicate {kind} "), p["n"]["key"], F.lit(": "), p["before"]["hostname"], F.lit(", "),
                    p["n"]["hostname"]).alias("message")))

        return let(F.array_sort(place), twice)

    fields = {"ip": "ip", "hostname": "name", "lpar_name": "existing_lpar_name"}
    return F.concat(*[repeats(rid, fields[col], kind) for rid, (col, kind) in _DUPLICATES.items()])


def duplicate_rules(nodes: DataFrame, scope: Sequence[str], order: Sequence[str] = ("ord",),
                    slices: int | None = None) -> DataFrame:
    """R34-R36 in one ordered scan: each node offers its three keys.

    Empty text counts as equal, and partitions are compared without their system.
    """
    kinds = F.inline(F.array(*[F.struct(F.lit(rid).alias("rule_id"), F.lit(text).alias("_kind"),
                                        F.col(col).alias("_key")) for rid, (col, text) in _DUPLICATES.items()]))
    offered = nodes.select(*scope, *[c for c in order if c not in scope], "hostname", kinds)
    seen = ordered(offered, [*scope, "rule_id", "_key"], list(order), previous={"_prev": "hostname"}, rank="_n",
                   slices=slices)
    text = F.concat(F.lit("duplicate "), F.col("_kind"), F.lit(" "), F.col("_key"), F.lit(": "),
                    F.col("_prev"), F.lit(", "), F.col("hostname"))
    return seen.filter(F.col("_n") > 1).select(
        *scope, "rule_id", F.lit("E").alias("severity"), text.alias("message"))


def disk_rules() -> list[Rule]:
    """Free space on the file server and the registry volume (R51, R52); unreadable is a warning."""
    web, reg = kb_to_gb(F.col("web_avail_kb")), kb_to_gb(F.col("registry_avail_kb"))
    needs = (F.col("isolation") == "air-gapped") & F.col("registry_managed")
    known = F.col("web_avail_kb").isNotNull()
    return [
        rule("R51", web < DISK_GB, "file server disk is low"),
        rule("R51", ~known, "file server disk is unreadable", severity="W"),
        # The registry volume is looked at only once the first figure was read.
        rule("R52", known & needs & (reg < REGISTRY_DISK_GB), "registry disk is low"),
        rule("R52", known & needs & F.col("registry_avail_kb").isNull(), "registry disk is unreadable", severity="W"),
    ]


def external_rules() -> list[Rule]:
    """Advisories on external services.

    Expects ``all_static`` (every node has an address), ``dns_answers`` and
    ``silent_ports`` (external balancer ports that do not answer).
    """
    c = F.col
    agent = c("boot_method") == "agent"
    lb = ~c("lb_managed")
    return [
        rule("R64", ~c("dns_managed") & ~c("dns_answers"), "external dns does not answer: ", c("dns_external"),
             severity="W"),
        rule("R65", ~c("dhcp_managed") & ~c("all_static"), "external dhcp must cover the nodes", severity="W"),
        rule("R66", ~c("pxe_managed") & ~agent, "external pxe must serve the boot files", severity="W"),
        *[rule("R67", lb & F.array_contains("silent_ports", F.lit(p)), f"external balancer port {p} does not answer",
               severity="W") for p in LB_PORTS],
        rule("R67", lb, "external balancer must be configured at ", c("vip"), severity="W"),
    ]


def state_rules() -> list[Rule]:
    """Row rules over state documents."""
    c = F.col
    status = blank(c("status"))
    return [
        rule("R68", F.coalesce(c("state_version"), F.lit(0)) == 0, "state version is not set"),
        rule("R69", blank(c("cluster_name")) == "", "cluster name is empty"),
        rule("R70", ~status.isin(*STATUSES), "invalid status: ", status),
        rule("R71", blank(c("start_time")) == "", "start time is not set"),
        rule("R73", c("cleanup_progress").isNotNull() & (status != "deleted")
             & (blank(c("cleanup_progress.status")) == "completed"), "cleanup is completed but state is not deleted"),
    ]


def phase_rules(states: DataFrame, entity: Sequence[str], allowed_prefixes: Sequence[str] = ("booted_",)) -> DataFrame:
    """One row per unknown completed phase.

    ``ready_`` markers are flagged by default although scaling writes them; add
    the prefix to accept them.
    """
    known = F.col("_p").isin(*PHASES)
    for prefix in allowed_prefixes:
        known = known | F.col("_p").startswith(prefix)
    each = states.select(*entity, F.explode("completed_phases").alias("_p"))
    return check(each.filter(~known), [rule("R72", F.lit(True), "unknown completed phase: ", F.col("_p"))], entity)


def event_rules(states: DataFrame, entity: Sequence[str]) -> DataFrame:
    """One row per repeat of a completed event (R74): n equal events give n - 1 rows.

    ``entity`` names one document.  Counting per event reduces in map tasks and
    stays linear in the length of the list.
    """
    each = states.select(*entity, F.explode("completed_events").alias("_e"))
    counted = each.groupBy(*entity, "_e").agg((F.count(F.lit(1)) - 1).cast("int").alias("_n")).filter(F.col("_n") > 0)
    copies = counted.select(*entity, F.explode(F.array_repeat("_e", F.col("_n"))).alias("_e"))
    return check(copies, [rule("R74", F.lit(True), "duplicate completed event: ", F.col("_e"))], entity)


def scale_rules() -> list[Rule]:
    """Scale checks over new nodes with ``node_facts``, status and live addresses.

    Stricter than R37: an unparseable address fails too.
    """
    c = F.col
    ip, net = c("ip"), c("machine_cidr")
    return [
        rule("R75", c("status") != "completed", "cluster is not completed: ", c("status")),
        rule("R76", ~c("_ip_ok") | (inside() == F.lit(False)), "address ", ip, " is invalid or outside ", net),
        rule("R77", c("alive"), "address ", ip, " already answers"),
    ]


_FOUND = ("rule_id", "severity", "message")


def rollup(violations: DataFrame, entities: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Error and warning counts per entity; an entity passes when it has no errors (A3).

    Entities without violations are kept.  Counting reduces inside map tasks, so
    an entity with very many violations costs no more than any other.
    """
    # each entity adds a row without a rule, so that one shuffle counts and keeps
    own = entities.select(*entity, F.lit(True).alias("_own"), *[F.lit(None).cast("string").alias(c) for c in _FOUND])
    counts = violations.select(*entity, F.lit(False).alias("_own"), *_FOUND).unionByName(own).groupBy(*entity).agg(
        F.bool_or("_own").alias("_own"),
        F.count_if(F.col("severity") == "E").alias("errors"),
        F.count_if(F.col("severity") == "W").alias("warnings"),
        F.min(F.when(F.col("severity") == "E", F.col("rule_id"))).alias("first_rule"),
        # on its own, so that messages are not shuffled for a reader that does not ask for them
        F.min(F.when(F.col("severity") == "E", F.struct("rule_id", "message"))).alias("_first"))
    return counts.filter("_own").select(
        *entity, "errors", "warnings", (F.col("errors") == 0).alias("passed"), "first_rule",
        F.col("_first.message").alias("first_message"))


def report_pages(violations: DataFrame, entity: Sequence[str], per_page: int = 500,
                 slices: int | None = None) -> DataFrame:
    """All messages of an entity as ordered pages of bounded size."""
    numbered = ordered(violations, list(entity), ["severity", "rule_id", "message"], rank="_n", slices=slices)
    paged = numbered.withColumn("page", F.floor((F.col("_n") - 1) / per_page))
    return paged.groupBy(*entity, "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "message"))), lambda s: s["message"]).alias("messages"))
