"""Explicit schemas for every document and snapshot table.  Nothing is inferred.

Field names follow the documents being read.  Secrets (passwords, session
tokens) have no column: they are dropped while reading.
"""

NODE = ("STRUCT<name: STRING, ip: STRING, existing_lpar_name: STRING, "
        "system_name: STRING, mac_address: STRING>")

CONFIG = f"""
services STRUCT<
  dns: STRUCT<external_nameserver: STRING>,
  dhcp: STRUCT<external_dhcp_server: STRING>,
  pxe: STRUCT<external_pxe_server: STRING>,
  load_balancer: STRUCT<vip: STRING, external_lb_ip: STRING>,
  nfs: STRUCT<external_nfs_server: STRING, external_nfs_path: STRING>,
  proxy: STRUCT<external_http_proxy: STRING, external_https_proxy: STRING, no_proxy: STRING>,
  registry: STRUCT<external_registry_server: STRING, username: STRING, ca_cert_file: STRING>>,
network STRUCT<isolation_level: STRING, controller_interface: STRING,
  machine_network_cidr: STRING, gateway: STRING, dns_forwarders: ARRAY<STRING>>,
openshift STRUCT<cluster_name: STRING, version: STRING, release_type: STRING,
  base_domain: STRING, cluster_network_cidr: STRING, cluster_network_host_prefix: INT,
  service_network: STRING, pull_secret_file: STRING, ssh_public_key_file: STRING,
  force_ocp_download: BOOLEAN,
  rhcos_images: STRUCT<kernel_url: STRING, initramfs_url: STRING, rootfs_url: STRING>,
  ocp_client_config: STRUCT<ocp_client: STRING, ocp_installer: STRING,
                            ocp_mirror_client: STRING, checksum_url: STRING>>,
hmc STRUCT<ip: STRING, username: STRING, password_set: BOOLEAN>,
nodes STRUCT<boot_method: STRING, bootstrap: ARRAY<{NODE}>, masters: ARRAY<{NODE}>,
             workers: ARRAY<{NODE}>>
"""

STATE = """
state_version INT, cluster_name STRING, status STRING, current_phase STRING,
completed_phases ARRAY<STRING>, start_time STRING, end_time STRING, error STRING,
locked BOOLEAN, lock_time STRING,
command_history ARRAY<STRUCT<command: STRING, start_time: STRING, end_time: STRING,
  duration: STRING, status: STRING, error: STRING, user: STRING, hostname: STRING, pid: INT,
  config_file: STRING, flags: MAP<STRING,STRING>,
  phases_before: ARRAY<STRING>, phases_after: ARRAY<STRING>>>,
phase_history ARRAY<STRUCT<phase: STRING, start_time: STRING, end_time: STRING,
  duration: STRING, status: STRING, error: STRING, attempts: INT>>,
config_backups ARRAY<STRING>, last_config_update STRING, total_duration STRING,
resume_count INT, version STRING,
downloaded_artifacts ARRAY<STRUCT<name: STRING, type: STRING, url: STRING, destination: STRING,
  size: BIGINT, checksum: STRING, status: STRING, started_at: STRING, completed_at: STRING,
  duration: STRING, error: STRING>>,
configured_services ARRAY<STRUCT<name: STRING, type: STRING, status: STRING, managed: BOOLEAN,
  config_file: STRING, service_name: STRING, started_at: STRING, completed_at: STRING,
  duration: STRING, error: STRING, details: STRING>>,
discovered_nodes ARRAY<STRUCT<hostname: STRING, role: STRING, ip: STRING, mac_address: STRING,
  uuid: STRING, profile_uuid: STRING, location_code: STRING, system_name: STRING,
  lpar_name: STRING, discovered_at: STRING>>,
nfs_mounts ARRAY<STRUCT<vios_uuid: STRING, vios_name: STRING, system_name: STRING,
  mount_point: STRING, nfs_server: STRING, export_path: STRING, mounted_at: STRING>>,
iso_mappings ARRAY<STRUCT<node_name: STRING, media_name: STRING, vios_uuid: STRING,
  vios_name: STRING, lpar_uuid: STRING, system_name: STRING, mount_point: STRING, mapped_at: STRING>>,
completed_events ARRAY<STRING>, failed_events ARRAY<STRING>,
download_progress MAP<STRING, STRUCT<url: STRING, destination: STRING, status: STRING,
  bytes_downloaded: BIGINT, total_bytes: BIGINT, checksum: STRING, started_at: STRING,
  completed_at: STRING, error: STRING>>,
service_operations ARRAY<STRUCT<service: STRING, operation: STRING, status: STRING,
  started_at: STRING, completed_at: STRING, details: STRING, error: STRING>>,
node_boot_status MAP<STRING, STRUCT<node_name: STRING, role: STRING, nfs_mounted: BOOLEAN,
  nfs_mount_point: STRING, iso_mapped: BOOLEAN, iso_media_name: STRING, network_booted: BOOLEAN,
  powered_on: BOOLEAN, boot_started_at: STRING, boot_completed_at: STRING>>,
cleanup_progress STRUCT<started_at: STRING, power_off_completed: ARRAY<STRING>,
  iso_unmapped: ARRAY<STRING>, nfs_unmounted: ARRAY<STRING>, services_removed: ARRAY<STRING>,
  vip_removed: BOOLEAN, status: STRING, completed_at: STRING, error: STRING>
"""

_AT = "controller_id STRING, snapshot_ts TIMESTAMP"

# One row per observed item; the two leading columns are added at collection.
INVENTORY = {
    "lpars": f"{_AT}, system_name STRING, system_uuid STRING, lpar_name STRING, lpar_uuid STRING, state STRING",
    "adapters": f"{_AT}, lpar_uuid STRING, ord INT, mac STRING, location_code STRING",
    "profiles": f"{_AT}, lpar_uuid STRING, ord INT, profile_uuid STRING",
    "vios": f"{_AT}, system_name STRING, ord INT, vios_uuid STRING, vios_name STRING, state STRING, rmc_state STRING",
    "repos": f"{_AT}, system_name STRING, vios_name STRING, size_mb BIGINT, free_mb BIGINT",
    "vgs": f"{_AT}, vios_uuid STRING, ord INT, group_name STRING, free_space STRING",
    "scsi_maps": f"{_AT}, vios_uuid STRING, lpar_href STRING, media_name STRING",
    "k8s_nodes": f"{_AT}, cluster_name STRING, name STRING, ready STRING",
    "k8s_csrs": f"{_AT}, cluster_name STRING, name STRING, has_status BOOLEAN",
    "processes": f"{_AT}, pid BIGINT",
}
