"""Joins between configurations, states, inventory, hosts and files.

Every join has an equality key, so none plans as a nested loop.  Sides are never
broadcast by hint: Spark picks from measured sizes and splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.net import address_facts, inside, is_cidr, mac_colons, network_facts
from fleetlens.functions.text import blank, link_uuid, url_basename

_CLUSTER = ("controller_id", "cluster_name")


def active(markers: DataFrame) -> DataFrame:
    """Clusters that hold their shared address: managed or failed, and not deleted (FL2)."""
    return markers.filter((F.col("managed") | F.col("failed")) & ~F.col("deleted"))


def vip_conflicts(candidates: DataFrame, holders: DataFrame) -> DataFrame:
    """The first other active cluster, by name, with the same address.

    ``candidates`` carry the resolved ``vip``; ``holders`` are active clusters
    with their saved ``vip``.  Per address only the two smallest holder names
    matter: whichever of them is not the candidate itself is the answer.  Each
    map task keeps two rows per address before the shuffle, so an address held
    by very many clusters stays small and no pairs are formed.
    """
    keys = ["controller_id", "vip"]
    held = holders.filter(blank(F.col("vip")) != "").select(*keys, "cluster_name").distinct()
    two = (held.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("cluster_name")))
           .filter(F.col("_n") <= 2)
           .groupBy(*keys).agg(F.min("cluster_name").alias("_first"), F.max("cluster_name").alias("_last")))
    other = (F.when(F.col("_first") != F.col("cluster_name"), F.col("_first"))
             .when(F.col("_last") != F.col("cluster_name"), F.col("_last")))
    return (candidates.filter(F.col("vip") != "").join(two, keys)
            .withColumn("held_by", other).filter(F.col("held_by").isNotNull()).drop("_first", "_last"))


def vip_candidates(resolved: DataFrame) -> DataFrame:
    """Clusters whose address is checked: balancer managed, interface known, address not the host's own."""
    return resolved.filter(F.col("lb_managed") & (F.col("interface") != "") & (F.col("vip") != F.col("controller_ip")))


def vip_state(resolved: DataFrame, holders: DataFrame, host_addrs: DataFrame) -> DataFrame:
    """Address problems of R14: held by a cluster, or bound on the interface by nobody known.

    A cluster whose network is missing or invalid (R07, R08) is not checked further.
    """
    checked = vip_candidates(resolved).filter(is_cidr(F.col("machine_cidr")))
    bound = host_addrs.select("controller_id", F.col("iface").alias("interface"), F.col("ip").alias("vip"),
                              F.lit(True).alias("bound")).distinct()
    conflicts = vip_conflicts(checked, holders).select(*_CLUSTER, "held_by")
    joined = (checked.select(*_CLUSTER, "interface", "vip")
              .join(bound, ["controller_id", "interface", "vip"], "left").join(conflicts, list(_CLUSTER), "left"))
    kind = (F.when(F.col("bound") & F.col("held_by").isNotNull(), "in use by cluster")
            .when(F.col("bound"), "bound on interface").when(F.col("held_by").isNotNull(), "assigned to cluster"))
    return joined.withColumn("problem", kind).filter(F.col("problem").isNotNull()).drop("bound")


def vip_alive(resolved: DataFrame, host_addrs: DataFrame, ping: DataFrame,
              scope: Sequence[str] = ("controller_id",)) -> DataFrame:
    """Managed shared addresses that answer although this host does not hold them."""
    checked = resolved.filter(F.col("lb_managed") & (F.col("vip") != "") & (F.col("vip") != F.col("controller_ip")))
    bound = host_addrs.select("controller_id", F.col("iface").alias("interface"), F.col("ip").alias("vip"))
    answering = ping.filter("alive") if "alive" in ping.columns else ping
    return (checked.join(bound, ["controller_id", "interface", "vip"], "left_anti")
            .join(answering.select(*scope, F.col("ip").alias("vip")), [*scope, "vip"], "left_semi"))


def shared_service(flat: DataFrame, markers: DataFrame, service: str) -> DataFrame:
    """Is the controller's registry or proxy still used by another live cluster (J2)?

    Live is weaker than active: not deleted, with a readable configuration.
    """
    live = F.coalesce(~F.col("deleted"), F.lit(True)) & F.col(f"{service}_managed")
    facts = flat.join(markers.select(*_CLUSTER, "deleted"), list(_CLUSTER), "left").select(
        *_CLUSTER, live.alias("_uses"))
    totals = facts.groupBy("controller_id").agg(F.count_if("_uses").alias("_users"))
    others = F.col("_users") - F.col("_uses").cast("int")
    return facts.join(totals, "controller_id").select(
        *_CLUSTER, others.alias("other_users"), (others > 0).alias("shared"))


def lpar_check(nodes: DataFrame, lpars: DataFrame) -> DataFrame:
    """Planned partitions against inventory: missing, running or ok."""
    stock = lpars.select("system_name", "lpar_name", F.col("state").alias("lpar_state"))
    verdict = (F.when(F.col("lpar_state").isNull(), "missing")
               .when(F.col("lpar_state") == "running", "running").otherwise("ok"))
    return (nodes.filter(F.col("lpar_name") != "").join(stock, ["system_name", "lpar_name"], "left")
            .withColumn("verdict", verdict))


def enrich_nodes(nodes: DataFrame, discovered: DataFrame, key: Sequence[str] = (*_CLUSTER, "hostname"),
                 facts: Sequence[str] = ("mac", "uuid", "profile_uuid", "location_code")) -> DataFrame:
    """Replace node facts by discovered ones where the host was discovered.

    A host discovered more than once counts as it was last, by ``ord``.
    """
    last = discovered.groupBy(*key).agg(F.max_by(F.struct(*facts), "ord").alias("_f"))
    found = last.select(*key, F.lit(True).alias("_found"), *[F.col(f"_f.{f}").alias(f"_d_{f}") for f in facts])
    joined = nodes.join(found, list(key), "left")
    keep = [c for c in nodes.columns if c not in facts]
    merged = []
    for fact in facts:
        have = F.col(fact) if fact in nodes.columns else F.lit(None).cast(joined.schema[f"_d_{fact}"].dataType)
        merged.append(F.when(F.col("_found"), F.col(f"_d_{fact}")).otherwise(have).alias(fact))
    return joined.select(*keep, *merged)


def discover(nodes: DataFrame, lpars: DataFrame, profiles: DataFrame, adapters: DataFrame) -> DataFrame:
    """Node facts from inventory: first profile and first adapter of its partition.

    A missing part leaves the row in place with the reason in ``error``.
    """
    part = lpars.select("system_name", "lpar_name", F.col("lpar_uuid").alias("uuid"))
    profile = profiles.groupBy(F.col("lpar_uuid").alias("uuid")).agg(F.min_by("profile_uuid", "ord").alias("profile_uuid"))
    adapter = adapters.groupBy(F.col("lpar_uuid").alias("uuid")).agg(
        F.min_by(F.struct("mac", "location_code"), "ord").alias("_a"))
    joined = (nodes.drop("mac").join(part, ["system_name", "lpar_name"], "left")
              .join(profile, "uuid", "left").join(adapter, "uuid", "left"))
    error = (F.when(blank(F.col("uuid")) == "", "partition not found")
             .when(F.col("profile_uuid").isNull(), "no profile")
             .when(F.col("_a").isNull(), "no network adapter"))
    return joined.withColumns({"mac": F.col("_a.mac"), "location_code": F.col("_a.location_code"),
                               "error": error}).drop("_a")


def scale_down(discovered: DataFrame, nodes: DataFrame, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Deployed workers that the new configuration no longer names."""
    wanted = nodes.filter(F.col("role") == "worker").select(*key, "hostname")
    return discovered.filter(F.col("role") == "worker").join(wanted, [*key, "hostname"], "left_anti")


def scale_up(nodes: DataFrame, states: DataFrame, k8s_nodes: DataFrame, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """New workers, those still to boot, and markers to backfill.

    ``action`` is ``add`` for a worker with neither marker nor ready status, or
    ``backfill`` where the cluster already reports it ready.
    """
    marks = states.select(*key, F.explode("completed_phases").alias("_m")).distinct()
    ready = marks.filter(F.col("_m").startswith("ready_")).select(*key, F.substring("_m", 7, 1 << 30).alias("hostname"))
    booted = marks.filter(F.col("_m").startswith("booted_")).select(
        *key, F.substring("_m", 8, 1 << 30).alias("hostname"), F.lit(True).alias("_booted"))
    live = (k8s_nodes.filter(F.trim("ready") == "True")
            .select(*key, F.col("name").alias("hostname"), F.lit(True).alias("_live")).distinct())
    fresh = nodes.filter(F.col("role") == "worker").join(ready, [*key, "hostname"], "left_anti")
    joined = fresh.join(live, [*key, "hostname"], "left").join(booted, [*key, "hostname"], "left")
    adding = F.col("_live").isNull()
    return joined.withColumns({
        "action": F.when(adding, "add").otherwise("backfill"),
        "pending_boot": adding & F.col("_booted").isNull(),
        "marker": F.concat(F.lit("ready_"), F.col("hostname"))}).drop("_live", "_booted")


def outside_network(nodes: DataFrame, configs: DataFrame, key: Sequence[str] = _CLUSTER,
                    strict: bool = False) -> DataFrame:
    """Nodes whose address lies outside their cluster's network.

    The range test runs beside the cluster key, never alone.  ``strict`` also
    reports addresses that do not parse.
    """
    net = configs.select(*key, "machine_cidr", *[v.alias(n) for n, v in network_facts(F.col("machine_cidr")).items()])
    # addresses are parsed behind the join, which so moves their text alone; the row number keeps the filter from
    # being moved below the parsing, where each mention of a fact would parse again
    placed = nodes.join(net.filter("_net_ok"), list(key)).withColumns(
        {**address_facts(F.col("ip")), "_row": F.monotonically_increasing_id()})
    bad = F.col("_ip_ok") & (inside() == F.lit(False))
    if strict:
        bad = bad | ~F.col("_ip_ok")
    return placed.filter((F.col("_row") >= 0) & bad).select(*nodes.columns, "machine_cidr")


def live_conflicts(nodes: DataFrame, ping: DataFrame, scope: Sequence[str] = ("controller_id",)) -> DataFrame:
    """Planned addresses that already answer."""
    answering = ping.filter("alive") if "alive" in ping.columns else ping
    return nodes.filter(F.col("ip") != "").join(answering.select(*scope, "ip"), [*scope, "ip"], "left_semi")


# Local addresses that mean every interface.
ANY_ADDRESS = ("0.0.0.0", "*", "[::]")


#: Processes that may hold a port; no name means that none may.
OWNERS = ("", "haproxy", "dnsmasq", "squid")


def port_collisions(ports: DataFrame, sockets: DataFrame, registry_answers: DataFrame | None = None,
                    owners: Sequence[str] = OWNERS) -> DataFrame:
    """Needed ports held by another process (J10); rows of ``ports`` as they are.

    ``owners`` names every owner that ``ports`` may have.  Sockets are reduced
    to one row per address before they meet the ports, with one mark per owner:
    is some process there another one?  So the join makes no more rows than
    there are ports, however many sockets share one.  ``registry_answers`` lists
    controllers whose own registry replied on its port; there port 5000 is no
    collision.
    """
    key = ["controller_id", "proto", "port"]
    at = F.when(F.col("local_addr").isin(*ANY_ADDRESS), "").otherwise(F.col("local_addr"))
    name = F.lower("process")
    held = sockets.groupBy(*key, at.alias("_at")).agg(F.array(*[
        F.coalesce(F.bool_or((F.lit(owner) == "") | ~F.contains(name, F.lit(owner))), F.lit(False))
        for owner in owners]).alias("_foreign"))
    place = F.array_position(F.array(*map(F.lit, owners)), F.col("owner")).cast("int") - 1

    def foreign(marks: str) -> Column:
        return F.coalesce(F.get(marks, place), F.lit(False))

    everywhere = held.filter(F.col("_at") == "").select(*key, F.col("_foreign").alias("_any"))
    single = held.filter(F.col("_at") != "").select(*key, F.col("_at").alias("own_addr"), F.col("_foreign").alias("_own"))
    hits = (ports.join(everywhere, key, "left").join(single, [*key, "own_addr"], "left")
            .filter(foreign("_any") | foreign("_own")))
    if registry_answers is not None:
        fine = registry_answers.select("controller_id", F.lit(5000).alias("port"))
        hits = hits.join(fine, ["controller_id", "port"], "left_anti")
    return hits.select(*ports.columns)


def stale_media(mappings: DataFrame, scsi_maps: DataFrame) -> DataFrame:
    """Media in each node's drive against the media it should hold.

    The suffix test on the partition link is an equality on its last 36
    characters.  Status: mapped (some drive holds it), stale (only other media
    are in its drives) or absent; ``others`` lists the other media.  The drives
    of one partition are few, so they are gathered before the join.
    """
    filled = scsi_maps.filter(blank(F.col("media_name")) != "")
    drives = filled.groupBy("vios_uuid", F.lower(link_uuid(F.col("lpar_href"))).alias("_lpar")).agg(
        F.sort_array(F.collect_set("media_name")).alias("_media"))
    want = mappings.withColumn("_lpar", F.lower("lpar_uuid"))
    joined = want.join(drives, ["vios_uuid", "_lpar"], "left").drop("_lpar")
    status = (F.when(F.col("_media").isNull(), "absent")
              .when(F.array_contains("_media", F.col("media_name")), "mapped").otherwise("stale"))
    others = F.coalesce(F.array_remove("_media", F.col("media_name")), F.array().cast("array<string>"))
    return joined.withColumns({"status": status, "others": others}).drop("_media")


# Folders and boot files each form of the check expects.
SERVER_FOLDERS = ("ignition", "rhcos", "tools", "scripts")
SERVER_IMAGES = ("rhcos/kernel", "rhcos/initramfs.img", "rhcos/rootfs.img")
HELPER_FILES = (
    "ignition/bootstrap.ign", "ignition/master.ign", "ignition/worker.ign",
    "rhcos/rhcos-live-kernel-ppc64le", "rhcos/rhcos-live-initramfs.ppc64le.img",
    "rhcos/rhcos-live-rootfs.ppc64le.img", "tools/openshift-install", "tools/oc", "tools/kubectl")


def expected_files(clusters: DataFrame, form: str = "server") -> DataFrame:
    """File paths each cluster's folder should hold; the helper form names other images."""
    names = SERVER_IMAGES if form == "server" else HELPER_FILES
    return clusters.select(*_CLUSTER, F.explode(F.array(*map(F.lit, names))).alias("path"))


def missing_folders(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """Server folders of a cluster in which no file is listed."""
    want = clusters.select(*_CLUSTER, F.explode(F.array(*map(F.lit, SERVER_FOLDERS))).alias("folder"))
    have = files.select(*_CLUSTER, F.substring_index("path", "/", 1).alias("folder"))
    return want.join(have, [*_CLUSTER, "folder"], "left_anti")


def missing_files(expected: DataFrame, files: DataFrame, key: Sequence[str] = (*_CLUSTER, "path")) -> DataFrame:
    """Expected files that are not listed."""
    return expected.join(files.select(*key), list(key), "left_anti")


def name_collisions(clusters: DataFrame, paths: DataFrame) -> DataFrame:
    """Files on the host that already carry the cluster's name.

    ``paths`` has ``controller_id`` and ``path``.  A name service file counts for
    every run of words between two hyphens of its name, as cluster names may hold
    hyphens themselves.  The balancer file counts under the name it is written
    with (``10-``); the older name (``99-``) is reported as ``legacy``.
    """
    path = F.col("path")
    dns = r"^/etc/dnsmasq\.d/([^/.][^/]*-[^/]+-[^/]*|-[^/]+-[^/]*)\.conf$"
    words = F.split(F.regexp_extract(path, dns, 1), "-")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    runs = F.flatten(F.transform(inner, lambda _, i: F.transform(
        F.sequence(F.lit(1), F.size(inner) - i), lambda n: F.array_join(F.slice(inner, i + 1, n), "-"))))
    pool = r"^/etc/haproxy/conf\.d/(10|99)-(.+)\.cfg$"
    found = paths.select(
        "controller_id", "path",
        F.explode(F.when(path.rlike("^/var/www/html/[^/]+"), F.array(F.regexp_extract(path, "^/var/www/html/([^/]+)", 1)))
                  .when(path.rlike(dns), F.array_distinct(runs))
                  .when(path.rlike(pool), F.array(F.regexp_extract(path, pool, 2)))).alias("cluster_name"),
        F.coalesce(F.regexp_extract(path, pool, 1) == "99", F.lit(False)).alias("legacy"))
    return clusters.select(*_CLUSTER).join(found, list(_CLUSTER))


def absent_interfaces(resolved: DataFrame, host_addrs: DataFrame) -> DataFrame:
    """Named interfaces that the host does not have."""
    have = host_addrs.select("controller_id", F.col("iface").alias("interface"))
    return resolved.filter(F.col("interface") != "").join(have, ["controller_id", "interface"], "left_anti")


def download_action(artifacts: DataFrame, manifests: DataFrame, files: DataFrame,
                    key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Skip, wipe or fetch each artifact.

    ``artifacts``: url, destination, force; ``manifests``: name, hash;
    ``files``: path, length, actual hash.  Hashes compare as exact lower-case text.
    """
    named = artifacts.withColumn("name", url_basename(F.col("url")))
    joined = (named.join(manifests.select(*key, "name", F.col("hash").alias("expected")), [*key, "name"], "left")
              .join(files.select(*key, F.col("path").alias("destination"), "length", F.col("hash").alias("actual")),
                    [*key, "destination"], "left"))
    return joined.withColumn("action", decide_download(
        F.col("force"), F.col("expected"), F.col("length").isNotNull(), F.col("length"), F.col("actual")))


def decide_download(force: Column, expected: Column, present: Column, length: Column, actual: Column) -> Column:
    known = blank(expected) != ""
    return (F.when(force, "wipe")
            .when(known & ~present, "fetch")
            .when(known & (actual == F.trim(expected)), "skip")
            .when(known, "wipe")
            .when(present & (length > 0), "skip").otherwise("fetch"))


def resolve_uuid(nodes: DataFrame, discovered: DataFrame, lpars: DataFrame,
                 key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Partition id from state, otherwise from inventory.

    Of several the first in list order counts (``ord``; inventory without that
    column has one row a partition, or the smallest id is taken).
    """
    known = (discovered.filter(blank(F.col("uuid")) != "").groupBy(*key, "hostname")
             .agg(F.min_by("uuid", "ord").alias("_state")))
    first = F.min_by("lpar_uuid", "ord") if "ord" in lpars.columns else F.min("lpar_uuid")
    stock = lpars.groupBy("system_name", "lpar_name").agg(first.alias("_stock"))
    joined = nodes.join(known, [*key, "hostname"], "left").join(stock, ["system_name", "lpar_name"], "left")
    uuid = F.coalesce("_state", F.nullif(F.col("_stock"), F.lit("")))
    source = (F.when(F.col("_state").isNotNull(), "state").when(uuid.isNotNull(), "inventory").otherwise("unknown"))
    return joined.withColumns({"resolved_uuid": uuid, "uuid_source": source}).drop("_state", "_stock")


# Service names in state documents.
SERVICE_RECORDS = {"lb": "haproxy", "proxy": "squid-proxy", "registry": "local-registry"}


def was_managed(resolved: DataFrame, services: DataFrame, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Managed now, or recorded as managed before."""
    before = services.groupBy(*key).agg(*[
        F.bool_or(F.col("managed") & (F.col("name") == record)).alias(f"_{kind}")
        for kind, record in SERVICE_RECORDS.items()])
    now = {"lb": F.col("lb_managed"), "proxy": F.col("proxy_managed"),
           "registry": (F.col("isolation") == "air-gapped") & F.col("registry_managed")}
    joined = resolved.join(before, list(key), "left")
    return joined.select(*key, *[(now[k] | F.coalesce(F.col(f"_{k}"), F.lit(False))).alias(f"was_{k}_managed")
                                 for k in SERVICE_RECORDS])


#: Width of a hardware address; least and most width of a dotted address.
HARDWARE, DOTTED = 17, (7, 15)
_DIGITS = "[0-9A-Fa-f]*"


def purge_leases(leases: DataFrame, nodes: DataFrame, mode: str = "exact",
                 scope: Sequence[str] = ("controller_id",)) -> DataFrame:
    """Lease lines that belong to the given nodes, by hardware or network address.

    ``exact`` compares whole tokens.  ``substring`` also removes lines that merely
    contain the text, so ``10.0.0.1`` takes ``10.0.0.10`` with it.  Both are
    equality joins: a match lies inside one run of address characters, so each
    distinct run is cut once into the pieces that are shaped like a hardware or
    dotted address, and lines meet the runs of which a piece is sought; sought
    text of any other shape meets whole tokens.  A dot stands for itself only.
    Tokens of a shape that nothing sought has (times, names, the star) are left
    out before the join, so words that stand in every line do not gather.
    """
    sought = (nodes.select(*scope, F.explode(F.array_compact(F.array(
        F.when(F.col("mac") != "", mac_colons(F.col("mac"))), F.when(F.col("ip") != "", F.col("ip"))))).alias("_t"))
        .distinct())
    shapes = sought.agg(F.collect_set(_shape(F.col("_t"))).alias("_shapes")).scalar()
    words = F.regexp_extract_all("line", F.lit(r"\S+"), 0)
    text, known = F.col("_t"), F.array_contains(shapes, _shape(F.col("_t")))
    if mode == "exact":
        told = leases.select(*scope, "line", F.explode(words).alias("_t")).filter(known)
        return _spread_semi(told, sought, [*scope, "_t"]).drop("_t").distinct()
    runs = F.regexp_extract_all("line", F.lit(rf"[0-9A-Fa-f.:]{{{DOTTED[0]},}}"), 0)
    each = leases.select(*scope, "line", F.size(words).alias("_words"), F.posexplode(F.concat(words, runs)).alias("_i", "_t"))
    told = each.select(*scope, "line", "_t", (F.col("_i") >= F.col("_words")).alias("_run")).filter(F.when(
        F.col("_run"), _holds_address(text)).otherwise(known & ~_is_hardware(text) & ~_is_dotted(text)))  # these are runs
    met = _pieces(leases.select(*scope, F.explode(runs).alias("_t")).filter(_holds_address(text)).distinct()).join(
        sought.withColumnRenamed("_t", "_piece"), [*scope, "_piece"], "left_semi").select(*scope, "_t").distinct()
    wanted = met.withColumn("_run", F.lit(True)).unionByName(sought.withColumn("_run", F.lit(False)))
    return _spread_semi(told, wanted, [*scope, "_t", "_run"]).select(*scope, "line").distinct()


#: Parts over which the rows of one frequent key are spread.
SPREAD = 8


def _spread_semi(rows: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted; those of one key go to several tasks."""
    parts = F.explode(F.array(*map(F.lit, range(SPREAD))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("line"), F.lit(SPREAD)).cast("int")).join(
        wanted.withColumn("_part", parts), [*key, "_part"], "left_semi").drop("_part")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _shape(text: Column) -> Column:
    """Length, dots and colons as one of 4096 numbers; larger figures share the last."""
    return (F.least(F.length(text), F.lit(63)) * 64 + F.least(_count(text, "."), F.lit(7)) * 8
            + F.least(_count(text, ":"), F.lit(7)))


def _holds_address(run: Column) -> Column:
    """Three dots or five colons with nothing but digits between them."""
    return (F.length(run) >= DOTTED[0]) & run.rlike(rf"\.{_DIGITS}\.{_DIGITS}\.|:(?:{_DIGITS}:){{4}}")


def _is_hardware(text: Column) -> Column:
    return (F.length(text) == HARDWARE) & text.rlike(rf"\A{_DIGITS}(?::{_DIGITS}){{5}}\z")


def _is_dotted(text: Column) -> Column:
    return F.length(text).between(*DOTTED) & text.rlike(rf"\A{_DIGITS}(?:\.{_DIGITS}){{3}}\z")


def _pieces(runs: DataFrame) -> DataFrame:
    """Runs (``_t``) with every ``_piece`` of them that is shaped like a hardware or dotted address.

    From each place on, a dotted piece ends behind the third dot and before a fourth dot or a colon.
    """
    at = runs.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_t") - DOTTED[0] + 1)))
    at = at.withColumn("_rest", F.substring("_t", F.col("_at"), F.lit(HARDWARE)))
    flat = F.substring_index("_rest", ":", 1)
    least = F.greatest(F.length(F.substring_index(flat, ".", 3)) + 1, F.lit(DOTTED[0]))
    most = F.least(F.length(F.substring_index(flat, ".", 4)), F.lit(DOTTED[1]))
    widths = F.when((_count(flat, ".") >= 3) & (least <= most), F.sequence(least, most))
    hardware = F.when(_is_hardware(F.col("_rest")), F.array(F.lit(HARDWARE)))
    wide = at.withColumn("_width", F.explode(F.coalesce(hardware, widths)))
    return wide.withColumn("_piece", F.substring("_rest", F.lit(1), F.col("_width"))).drop("_at", "_rest", "_width")


def orphans(mappings: DataFrame, markers: DataFrame, configs: DataFrame, key: Sequence[str] = _CLUSTER) -> DataFrame:
    """Media mappings left on deleted clusters, or on clusters no longer booted by agent."""
    joined = (mappings.join(markers.select(*key, "deleted"), list(key), "left")
              .join(configs.select(*key, "boot_method"), list(key), "left"))
    gone = F.coalesce("deleted", F.lit(False))
    reason = (F.when(gone, "deleted").when(F.coalesce(F.col("boot_method"), F.lit("agent")) != "agent", "boot method"))
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def overlay(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New entries replace old ones of the same key; the last new entry of a key wins.

    ``ord`` orders entries within each side.
    """
    layered = (existing.withColumn("_layer", F.lit(0)).unionByName(new.withColumn("_layer", F.lit(1))))
    packed = F.struct(*existing.columns)
    best = layered.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(
        F.max_by(packed, F.struct("_layer", "ord")).alias("_r"))
    return best.select("_r.*")


def rename_context(entries: DataFrame, current: str, new_name: Column) -> DataFrame:
    """Entries named like the current context take the new name."""
    return entries.withColumn("name", F.when(F.col("name") == F.col(current), new_name).otherwise(F.col("name")))


def stale_locks(locks: DataFrame, processes: DataFrame, as_of: Column, limit_seconds: int = 3600) -> DataFrame:
    """Locks whose process is gone, or that are unreadable and older than an hour (ST5)."""
    alive = processes.select("controller_id", F.col("pid").alias("lock_pid"), F.lit(True).alias("_alive")).distinct()
    joined = locks.join(alive, ["controller_id", "lock_pid"], "left")
    readable = F.coalesce(F.col("lock_pid"), F.lit(0)) > 0
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("modified_at"))
    verdict = (F.when(readable & F.col("_alive").isNull(), "stale")
               .when(readable, "held").when(age > limit_seconds, "stale").otherwise("held"))
    return joined.withColumn("verdict", verdict).drop("_alive")
