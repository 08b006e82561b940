"""Flatten, default and label configuration documents (P1-P7, P12, FL6).

``flatten`` turns a nested document into flat columns with the absent/empty
rule applied.  ``resolve_defaults`` then fills defaults; the order of its steps
decides the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import blank, full_version, major_minor

# Defaults, image names and address forms.
RELEASE_TYPE = "official"
CLUSTER_CIDR = "10.128.0.0/14"
HOST_PREFIX = 23
SERVICE_NETWORK = "172.30.0.0/16"
REGISTRY_IMAGE = "docker.io/library/registry:3.1.1"
REGISTRY_USER = "admin"
REGISTRY_REPO = "ocp4/openshift4"
RELEASE_IMAGE = "quay.io/openshift-release-dev/ocp-release:%s-ppc64le"
CLIENT_URL = "https://mirror.openshift.com/pub/openshift-v4/ppc64le/clients/ocp/%s/"
BOOT_URL = "https://mirror.openshift.com/pub/openshift-v4/ppc64le/dependencies/rhcos/%s/latest/"
CLIENT_FILE = "openshift-client-linux.tar.gz"
INSTALLER_FILE = "openshift-install-linux.tar.gz"
MIRROR_FILE = "oc-mirror.tar.gz"
KERNEL_FILE = "rhcos-live-kernel.ppc64le"
INITRAMFS_FILE = "rhcos-live-initramfs.ppc64le.img"
ROOTFS_FILE = "rhcos-live-rootfs.ppc64le.img"
PROXY_PORT = 3128
REGISTRY_PORT = 5000

_TEXT = {
    "dns_external": "services.dns.external_nameserver",
    "dhcp_external": "services.dhcp.external_dhcp_server",
    "pxe_external": "services.pxe.external_pxe_server",
    "vip_given": "services.load_balancer.vip",
    "lb_external": "services.load_balancer.external_lb_ip",
    "nfs_external": "services.nfs.external_nfs_server",
    "nfs_path": "services.nfs.external_nfs_path",
    "proxy_http": "services.proxy.external_http_proxy",
    "proxy_https": "services.proxy.external_https_proxy",
    "no_proxy": "services.proxy.no_proxy",
    "registry_external": "services.registry.external_registry_server",
    "registry_user": "services.registry.username",
    "isolation_given": "network.isolation_level",
    "interface": "network.controller_interface",
    "machine_cidr": "network.machine_network_cidr",
    "gateway": "network.gateway",
    "cluster_name": "openshift.cluster_name",
    "version": "openshift.version",
    "release_type": "openshift.release_type",
    "base_domain": "openshift.base_domain",
    "cluster_cidr": "openshift.cluster_network_cidr",
    "service_network": "openshift.service_network",
    "pull_secret": "openshift.pull_secret_file",
    "ssh_key": "openshift.ssh_public_key_file",
    "kernel_url": "openshift.rhcos_images.kernel_url",
    "initramfs_url": "openshift.rhcos_images.initramfs_url",
    "rootfs_url": "openshift.rhcos_images.rootfs_url",
    "client_url": "openshift.ocp_client_config.ocp_client",
    "installer_url": "openshift.ocp_client_config.ocp_installer",
    "mirror_url": "openshift.ocp_client_config.ocp_mirror_client",
    "checksum_url": "openshift.ocp_client_config.checksum_url",
    "hmc_ip": "hmc.ip",
    "hmc_user": "hmc.username",
    "boot_method": "nodes.boot_method",
}


def flatten(configs: DataFrame) -> DataFrame:
    """Flat columns: text never null, blocks as presence flags, node lists as arrays."""
    passed = [c for c in configs.columns if c not in ("services", "network", "openshift", "hmc", "nodes", "raw")]
    nodes = {role: F.coalesce(F.col(f"nodes.{role}"), F.expr(f"filter(nodes.{role}, x -> false)"),
                              F.array().cast(configs.schema["nodes"].dataType[role].dataType))
             for role in ("bootstrap", "masters", "workers")}
    return configs.select(
        *passed,
        *[blank(F.col(path)).alias(name) for name, path in _TEXT.items()],
        F.col("services.proxy").isNotNull().alias("proxy_present"),
        F.col("services.registry").isNotNull().alias("registry_present"),
        F.coalesce("network.dns_forwarders", F.array().cast("array<string>")).alias("dns_forwarders"),
        F.coalesce("openshift.cluster_network_host_prefix", F.lit(0)).alias("host_prefix"),
        F.coalesce("openshift.force_ocp_download", F.lit(False)).alias("force_download"),
        F.coalesce("hmc.password_set", F.lit(False)).alias("hmc_password_set"),
        *[value.alias(role) for role, value in nodes.items()])


def with_managed_flags(flat: DataFrame) -> DataFrame:
    """Core services are managed unless external; proxy and registry only if their block is present."""
    return flat.withColumns({
        "dns_managed": F.col("dns_external") == "",
        "dhcp_managed": F.col("dhcp_external") == "",
        "pxe_managed": F.col("pxe_external") == "",
        "lb_managed": F.col("lb_external") == "",
        "nfs_managed": F.col("nfs_external") == "",
        "proxy_managed": F.col("proxy_present") & (F.col("proxy_http") == ""),
        "registry_managed": F.col("registry_present") & (F.col("registry_external") == ""),
    })


def _or_default(name: str, default: Column | str, when: Column | None = None) -> Column:
    fill = F.col(name) == ""
    value = default if isinstance(default, Column) else F.lit(default)
    return F.when(fill if when is None else fill & when, value).otherwise(F.col(name))


def _address(form: str, part: Column, file: str) -> Column:
    head, tail = form.split("%s")
    return F.concat(F.lit(head), part, F.lit(tail + file))


def resolve_defaults(flat: DataFrame) -> DataFrame:
    """Fill defaults in the documented order and add managed flags.

    A managed proxy overrides a managed registry's air gap, so isolation is
    settled before anything that depends on it.
    """
    gap = F.col("isolation_given") == "air-gapped"
    df = flat.withColumns({
        "release_type": _or_default("release_type", RELEASE_TYPE),
        "registry_present": F.col("registry_present") | gap})
    df = with_managed_flags(df)
    settled = (F.when(F.col("proxy_managed"), F.lit("restricted-network"))
               .when(F.col("registry_managed"), F.lit("air-gapped"))
               .when(F.col("isolation_given").isin("air-gapped", "restricted-network"), F.col("isolation_given"))
               .otherwise(F.lit("connected")))
    df = df.withColumn("isolation", settled)
    air_gapped = F.col("isolation") == "air-gapped"
    own_registry = air_gapped & F.col("registry_managed")
    known = F.col("version") != ""
    boots = known & (F.col("boot_method") != "agent")
    version, minor = F.col("version"), major_minor(F.col("version"))
    head, tail = RELEASE_IMAGE.split("%s")
    return df.withColumns({
        "registry_image": F.when(own_registry, F.lit(REGISTRY_IMAGE)).otherwise(F.lit("")),
        "registry_repo": F.when(own_registry, F.lit(REGISTRY_REPO)).otherwise(F.lit("")),
        "registry_user": _or_default("registry_user", REGISTRY_USER, own_registry),
        "release_image": F.when(air_gapped & known, F.concat(F.lit(head), full_version(version), F.lit(tail)))
        .otherwise(F.lit("")),
        "client_url": _or_default("client_url", _address(CLIENT_URL, version, CLIENT_FILE), known),
        "installer_url": _or_default("installer_url", _address(CLIENT_URL, version, INSTALLER_FILE), known),
        "mirror_url": _or_default("mirror_url", _address(CLIENT_URL, version, MIRROR_FILE), known),
        "kernel_url": _or_default("kernel_url", _address(BOOT_URL, minor, KERNEL_FILE), boots),
        "initramfs_url": _or_default("initramfs_url", _address(BOOT_URL, minor, INITRAMFS_FILE), boots),
        "rootfs_url": _or_default("rootfs_url", _address(BOOT_URL, minor, ROOTFS_FILE), boots),
        "cluster_cidr": _or_default("cluster_cidr", CLUSTER_CIDR),
        "host_prefix": F.when(F.col("host_prefix") == 0, F.lit(HOST_PREFIX)).otherwise(F.col("host_prefix")),
        "service_network": _or_default("service_network", SERVICE_NETWORK),
        "vip": F.when(F.col("lb_external") != "", F.col("lb_external"))
        .when(F.col("vip_given") != "", F.col("vip_given")).otherwise(F.col("controller_ip")),
    })


def boot_managed(service: str) -> Column:
    """Managed, and used by the cluster's boot method."""
    agent = F.col("boot_method") == "agent"
    managed = F.col(f"{service}_managed")
    if service in ("dhcp", "pxe"):
        return managed & ~agent
    return managed & agent if service == "nfs" else managed


# Display names, in display order.
_SERVICE_LABELS = {"dns": "DNS", "dhcp": "DHCP", "pxe": "PXE", "lb": "HAProxy", "nfs": "NFS"}


def with_service_list(df: DataFrame) -> DataFrame:
    names = [F.when(boot_managed(key), F.lit(label)) for key, label in _SERVICE_LABELS.items()]
    joined = F.concat_ws(", ", *names)
    return df.withColumns({
        **{f"{key}_active": boot_managed(key) for key in _SERVICE_LABELS},
        "managed_services": F.when(joined == "", F.lit("None")).otherwise(joined)})


def is_single_node() -> Column:
    return F.size("masters") == 1


def explode_nodes(flat: DataFrame, *keep: str) -> DataFrame:
    """Node rows with role, overall position ``ord`` and position in role ``role_ord``.

    Exactly one master means a single-node cluster: that node alone, role ``sno``.
    """
    keep = keep or ("controller_id", "cluster_name")
    each = flat.select(*keep, F.posexplode(node_entries()).alias("ord", "n"))
    return each.select(
        *keep, "ord", "n.role", "n.role_ord",
        blank(F.col("n.node.name")).alias("hostname"), blank(F.col("n.node.ip")).alias("ip"),
        blank(F.col("n.node.existing_lpar_name")).alias("lpar_name"),
        blank(F.col("n.node.system_name")).alias("system_name"),
        blank(F.col("n.node.mac_address")).alias("mac"))


def node_entries() -> Column:
    """A document's nodes in order, as an array of (role, role_ord, node)."""
    def tagged(role: str, label: str) -> Column:
        return F.transform(F.col(role), lambda n, i: F.struct(
            F.lit(label).alias("role"), i.alias("role_ord"), n.alias("node")))

    single = F.transform(F.slice("masters", 1, 1), lambda n, i: F.struct(
        F.lit("sno").alias("role"), i.alias("role_ord"), n.alias("node")))
    many = F.concat(tagged("bootstrap", "bootstrap"), tagged("masters", "master"), tagged("workers", "worker"))
    return F.when(is_single_node(), single).otherwise(many)


def cluster_labels(flat: DataFrame, readable: Column | None = None) -> DataFrame:
    """Type, network and address labels of the fleet list (P5)."""
    kind = F.concat(
        F.when(is_single_node(), F.lit("SNO")).otherwise(F.lit("Multi")),
        F.when(F.col("boot_method") == "netboot", F.lit(" (netboot)")).otherwise(F.lit(" (agent)")))
    network = (F.when(F.col("isolation_given") == "air-gapped", F.lit("Air-Gapped"))
               .when(F.col("isolation_given") == "restricted-network", F.lit("Restricted Network"))
               .otherwise(F.lit("Connected")))
    address = F.when(F.col("vip_given") != "", F.col("vip_given"))
    ok = F.lit(True) if readable is None else readable
    return flat.withColumns({
        "cluster_type": F.when(ok, kind).otherwise(F.lit("Multi (agent)")),
        "network_label": F.when(ok, network).otherwise(F.lit("Unknown")),
        "cluster_ip": F.coalesce(F.when(ok, address), F.lit("Unknown"))})


def service_modes(resolved: DataFrame) -> DataFrame:
    """Proxy and registry mode and address."""
    own_proxy = F.concat(F.lit("http://"), F.col("controller_ip"), F.lit(f":{PROXY_PORT}"))
    own_registry = F.concat(F.col("controller_ip"), F.lit(f":{REGISTRY_PORT}"))
    away = F.col("isolation") == "air-gapped"
    return resolved.withColumns({
        "proxy_mode": F.when(F.col("proxy_managed"), F.lit("managed"))
        .when(F.col("proxy_http") != "", F.lit("external")).otherwise(F.lit("none")),
        "proxy_url": F.when(F.col("proxy_managed"), own_proxy).otherwise(F.col("proxy_http")),
        "registry_mode": F.when(F.col("registry_managed"), F.lit("managed"))
        .when(away, F.lit("external")).otherwise(F.lit("official")),
        "registry_url": F.when(F.col("registry_managed"), own_registry)
        .when(away, F.col("registry_external")).otherwise(F.lit(""))})


# Names served below the apps domain, and the two host lists.
_APPS = {"console": "console-openshift-console", "oauth": "oauth-openshift",
         "prometheus": "prometheus-k8s-openshift-monitoring", "grafana": "grafana-openshift-monitoring"}
_INSTALL_APPS = ("console", "oauth")


def endpoints(df: DataFrame) -> DataFrame:
    """Addresses of completed clusters, and both host-file lines."""
    domain = F.concat_ws(".", "cluster_name", "base_domain")
    done = F.col("status") == "completed"

    def app(name: str) -> Column:
        return F.concat(F.lit(f"{_APPS[name]}.apps."), domain)

    shown = [F.concat(F.lit("api."), domain), *[app(n) for n in _APPS]]
    install = [F.concat(F.lit("api."), domain), F.concat(F.lit("api-int."), domain), *[app(n) for n in _INSTALL_APPS]]
    return df.withColumns({
        "api_url": F.when(done, F.concat(F.lit("https://api."), domain, F.lit(":6443"))),
        **{f"{n}_url": F.when(done, F.concat(F.lit("https://"), app(n))) for n in _APPS},
        "hosts_entry": F.when(done, F.concat_ws(" ", "vip", *shown)),
        "install_hosts_entry": F.concat_ws(" ", "vip", *install)})


def version_parts(version: Column) -> dict[str, Column]:
    """Major.minor, release tag and update channel."""
    return {"minor": major_minor(version), "tag": full_version(version),
            "channel": F.concat(F.lit("stable-"), major_minor(version))}


def has_external() -> Column:
    """Any core service external, whatever the boot method (FL6, check form)."""
    return ~(F.col("dns_managed") & F.col("dhcp_managed") & F.col("pxe_managed") & F.col("lb_managed"))


def has_external_for_boot() -> Column:
    """Any external service that the boot method uses (FL6, report form)."""
    agent = F.col("boot_method") == "agent"
    netboot = ~agent & ~(F.col("dhcp_managed") & F.col("pxe_managed"))
    return ~F.col("dns_managed") | ~F.col("lb_managed") | netboot | (agent & ~F.col("nfs_managed"))
