"""Independent SQL for the registered queries, over the same tables.

``VIEWS`` are named sub-queries; ``sql`` prepends those a body mentions.  The
text is written for the checking engine, not derived from the operators.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def sql(body: str) -> str:
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                used.append(name)

    need(body)
    head = ", ".join(f"{name} as (\n{VIEWS[name].strip()}\n)" for name in used)
    body = body.strip()
    if body.startswith("with "):
        return f"with {head}, {body[5:]}" if used else body
    return f"with {head}\n{body}" if used else body


def oracle(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


VIEWS["b_clusters"] = """
select o_custkey % 50 as controller_id, lpad(cast(o_orderkey as varchar), 9, '0') as cluster_name,
  o_orderkey as cluster_id,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'in_progress' else 'failed' end as status,
  o_orderstatus = 'F' as managed, o_orderstatus = 'P' as failed, o_orderkey % 7 = 0 as deleted,
  o_orderkey % 9 = 0 as locked,
  case when o_orderkey % 5 = 0 then '' else '10.' || (o_orderkey % 16) || '.0.' || (o_custkey % 250) end as vip,
  cast(floor(o_totalprice) as bigint) as elapsed_s
from orders"""

VIEWS["b_raw"] = """
select o_orderkey as k, o_custkey as c, substr(o_orderpriority, 1, 1) as prio, o_custkey % 50 as controller_id,
  '10.' || (o_custkey % 50 % 16) || '.0.1' as controller_ip, lpad(cast(o_orderkey as varchar), 9, '0') as cluster_name,
  case when o_orderkey % 9 = 0 then '8.8.4.4' else '' end as dns_external,
  case when o_orderkey % 11 = 0 then '10.0.0.2' else '' end as dhcp_external,
  case when o_orderkey % 13 = 0 then '10.0.0.3' else '' end as pxe_external,
  case when o_orderkey % 5 <> 0 then '10.' || (o_orderkey % 16) || '.0.' || (o_custkey % 250) else '' end as vip_given,
  case when o_orderkey % 5 <> 0 and o_orderkey % 17 = 0 then '10.99.0.1' else '' end as lb_external,
  case when o_orderkey % 10 = 0 then 'nfs.x' else '' end as nfs_external,
  case when o_orderkey % 20 = 0 then '/vol' else '' end as nfs_path,
  o_orderkey % 4 = 0 as proxy_present, case when o_orderkey % 8 = 0 then 'http://p:8080' else '' end as proxy_http,
  o_orderkey % 6 = 0 as registry_block,
  case when o_orderkey % 24 = 0 then 'registry.example.com' when o_orderkey % 12 = 0 then 'registry.x' else '' end
    as registry_external,
  case when o_orderkey % 18 = 0 then 'ops' else '' end as user_given,
  case substr(o_orderpriority, 1, 1) when '1' then 'air-gapped' when '2' then 'restricted-network'
    when '3' then 'connected' else 'other' end as isolation_given,
  case when o_orderkey % 19 = 0 then '' else 'eth0' end as interface,
  case when o_orderkey % 23 = 0 then '' when o_orderkey % 23 = 1 then 'bad'
    else '10.' || (o_orderkey % 16) || '.0.0/16' end as machine_cidr,
  case when o_orderkey % 7 = 0 then '' when o_orderkey % 7 = 1 then '10.200.0.1'
    else '10.' || (o_orderkey % 16) || '.0.1' end as gateway,
  case when o_orderkey % 3 = 0 then 0 else 2 end as forwarders,
  case when o_orderkey % 29 = 0 then '' else '4.' || (o_orderkey % 22)
    || case when o_orderkey % 2 = 0 then '.' || (o_custkey % 40) else '' end end as version,
  o_orderkey % 22 as minor,
  case o_orderkey % 5 when 0 then '' when 1 then 'ci' when 2 then 'nightly' else 'official' end as release_given,
  case when o_orderkey % 31 = 0 then '' else 'example.local' end as base_domain,
  case when o_orderkey % 37 = 0 then '' else '/s/' || (o_custkey % 30) end as pull_secret,
  case when o_orderkey % 41 = 0 then '' else '/k/' || (o_custkey % 30) end as ssh_key,
  case o_orderkey % 3 when 0 then 'agent' when 1 then 'netboot' else '' end as boot_method,
  case when o_custkey % 3 = 0 then 1 else 0 end as nb,
  case o_custkey % 8 when 3 then 1 when 4 then 5 when 5 then 4 when 6 then 2 else 3 end as nm,
  (o_orderkey + o_custkey) % 5 as nw
from orders"""

VIEWS["b_cfg"] = """
select *, dns_external = '' as dns_managed, dhcp_external = '' as dhcp_managed, pxe_external = '' as pxe_managed,
  lb_external = '' as lb_managed, nfs_external = '' as nfs_managed, proxy_present and proxy_http = '' as proxy_managed,
  (registry_block or isolation_given = 'air-gapped') and registry_external = '' as registry_managed,
  case when proxy_present and proxy_http = '' then 'restricted-network'
       when (registry_block or isolation_given = 'air-gapped') and registry_external = '' then 'air-gapped'
       when isolation_given in ('air-gapped', 'restricted-network') then isolation_given else 'connected' end as isolation,
  case when lb_external <> '' then lb_external when vip_given <> '' then vip_given else controller_ip end as vip,
  case when release_given = '' then 'official' else release_given end as release_type,
  machine_cidr like '10.%' as net_ok, cluster_name || '.' || base_domain as domain
from b_raw"""

# Nodes of the configuration documents, role by role.
VIEWS["b_roles"] = """
select b_raw.*, r.role, r.letter, r.shift, case r.role when 'bootstrap' then nb when 'master' then nm else nw end as n
from b_raw cross join (select 'bootstrap' as role, 'b' as letter, 0 as shift union all select 'master', 'm', 1
  union all select 'worker', 'w', 3) r"""

VIEWS["b_all_nodes"] = """
select x.*, k + j + shift as m,
  case when (k + j + shift) % 29 = 0 then '' else letter || '-' || j end as hostname,
  case when (k + j + shift) % 37 = 0 then '' when (k + j + shift) % 41 = 0 then 'x'
    else '10.' || (case when (k + j + shift) % 33 = 0 then 99 else k % 16 end) || '.' || (c % 250) || '.'
      || ((j + shift) % 7 + 10) end as ip,
  case when (k + j + shift) % 43 = 0 then '' else 'l' || (c % 40) || '-' || ((j + shift) % 6) end as lpar_name,
  case when (k + j + shift) % 53 = 0 then '' else 'sys' || ((k + j + shift) % 20) end as system_name,
  case when (k + j + shift) % 2 = 1 then 'AA-BB-0' || (j % 10) || '-' ||
    lpad(cast((k + j + shift) % 97 as varchar), 2, '0') else '' end as mac
from (select b_roles.*, unnest(range(n)) as j from b_roles) x"""

VIEWS["b_cn"] = """
select *, case when nm = 1 then 'sno' else role end as placed,
  case when nm = 1 then 0 when role = 'bootstrap' then j when role = 'master' then nb + j else nb + nm + j end as ord
from b_all_nodes where nm <> 1 or role = 'master'"""

VIEWS["b_sound"] = """
select *, case when nm = 1 and (nw > 0 or nb > 0) then 'R27' when nm = 1 then null when nm < 3 then 'R28'
  when nm % 2 = 0 then 'R29' when boot_method = 'netboot' and nb = 0 then 'R30'
  when boot_method = 'agent' and nb > 0 then 'R31' end as problem from b_cfg"""

VIEWS["b_nodes"] = """
select l_orderkey as cluster_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
       l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 as ord,
  'n' || l_linenumber as hostname, case when l_linenumber <= 3 then 'master' else 'worker' end as role,
  l_suppkey as system_id, 'l' || l_partkey as lpar_name,
  '10.' || (case when l_tax > 0.07 then 99 else l_orderkey % 16 end) || '.' || (l_suppkey % 250) || '.'
    || (l_partkey % 250) as ip,
  'AA-BB-CC-' || lpad(cast(l_suppkey % 100 as varchar), 2, '0') || '-' || lpad(cast(l_partkey % 100 as varchar), 2, '0')
    || '-0' || l_linenumber as mac
from lineitem"""

VIEWS["b_discovered"] = """
select *, 'u-' || cluster_id || '-' || ord as uuid from b_nodes where (cluster_id + ord) % 5 <> 0"""

VIEWS["b_lpars"] = """
select distinct l_suppkey as system_name, 'l' || l_partkey as lpar_name,
  case l_partkey % 3 when 0 then 'running' when 1 then 'not activated' else 'open firmware' end as state,
  'u-' || l_suppkey || '-' || l_partkey as lpar_uuid, l_suppkey + l_partkey as mix
from lineitem where (l_partkey + l_suppkey) % 4 <> 0"""

VIEWS["b_vios"] = """
select s_suppkey as system_name, o.ord, 'v' || s_suppkey || '-' || o.ord as vios_uuid, 'v' || o.ord as vios_name,
  case when (s_suppkey + o.ord) % 3 = 0 then 'not activated' else 'running' end as state,
  case when s_suppkey % 4 = 0 then 'inactive' else 'active' end as rmc_state,
  case when s_suppkey % 5 = 0 then 0 else 2048 * (1 + s_suppkey % 9) end as size_mb, 512 * (s_suppkey % 9) as free_mb
from supplier cross join (select 0::bigint as ord union all select 1 union all select 2) o"""

VIEWS["b_vgs"] = """
select s_suppkey as system_name, o.ord, case o.ord when 0 then 'rootvg' else 'vg' || o.ord end as group_name,
  case when s_suppkey % 11 = 0 then null else (s_suppkey * (o.ord + 3)) % 40 end as free
from supplier cross join (select 0::bigint as ord union all select 1 union all select 2) o"""

VIEWS["b_ping"] = "select distinct ip from b_nodes where cluster_id % 10 = 0"

VIEWS["b_lines"] = """
select doc_id, source as cluster_name, i - 1 as pos, parts[i] as line from (
  select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i
  from (select doc_id, source, string_split(text, chr(10)) as parts from documents))"""

VIEWS["b_maps"] = """
select l_orderkey as cluster_id, 'n' || l_linenumber as node_name, l_suppkey as system_name,
  'v' || l_suppkey || '-' || (l_partkey % 3) as vios_uuid, 'u-' || l_suppkey || '-' || l_partkey as lpar_uuid,
  'iso-' || (l_orderkey % 40) as media_name,
  case when l_orderkey % 6 = 0 then '' else '/mnt/' || (l_orderkey % 500) end as mount_point,
  l_orderkey * 10 + l_linenumber as ord
from lineitem"""

_PHASES = (("discovery", 2), ("downloads", 3), ("services", 5), ("ignition", 7), ("boot", 11), ("wait", 13),
           ("booted_m-1", 17), ("ready_w-0", 19), ("unknown", 23))
_JOINED = " || ".join(f"case when o_orderkey % {n} = 0 then ',{p}' else '' end" for p, n in _PHASES)

VIEWS["b_states"] = f"""
select o_orderkey as k, o_custkey as c, o_custkey % 50 as controller_id,
  lpad(cast(o_orderkey as varchar), 9, '0') as cluster_name, o_orderkey as cluster_id,
  case when o_orderkey % 9 = 0 then 0 else 2 end as state_version,
  case when o_orderkey % 10 = 0 then '' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O'
    then 'in_progress' when o_orderkey % 31 = 0 then 'odd' else 'failed' end as status,
  case when o_orderkey % 8 = 1 then '' else {_JOINED} end as done, {_JOINED} as marks,
  case when o_orderkey % 12 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03Z' end as start_time,
  case when o_orderkey % 12 = 0 then null else o_orderdate + interval 3723 second end as started,
  case when o_orderstatus <> 'F' then null when o_orderkey % 15 = 0 then 'soon'
    else strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(cast(o_custkey % 24 as varchar), 2, '0') || ':'
      || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':09' end as end_clock,
  case when o_orderstatus = 'F' and o_orderkey % 15 <> 0 then o_orderdate
    + to_seconds((o_custkey % 24) * 3600 + (o_orderkey % 60) * 60 + 9 - case when o_orderkey % 4 = 0 then 19800 else 0 end)
    end as ended,
  o_orderdate as snapshot_ts, o_orderkey % 25 = 0 as corrupt
from orders"""

VIEWS["b_age"] = """
select *, case when status = '' then case when end_clock is not null then 'completed' else 'in_progress' end
    else status end as fixed,
  cast(epoch(ended) - epoch(started) as bigint) as took,
  cast(epoch(timestamp '2002-06-01 00:00:00') - epoch(started) as bigint) as running
from b_states"""


def human(x: str) -> str:
    """Duration text of a whole number of seconds; negative values keep only seconds."""
    return (f"case when {x} >= 3600 then ({x} // 3600) || 'h ' || ({x} // 60 % 60) || 'm' "
            f"when {x} >= 60 then ({x} // 60) || 'm ' || ({x} % 60) || 's' else ({x} % 60) || 's' end")


# --- sources -----------------------------------------------------------------

oracle("src1_configs", """
select o_orderkey as cluster_id, o_orderkey % 97 = 0 as failed,
  case when o_orderkey % 97 <> 0 then 'c' || o_orderkey end as name,
  case when o_orderkey % 97 <> 0 then '4.' || (o_orderkey % 30) end as version,
  case when o_orderkey % 97 <> 0 then o_orderkey % 9 + 16 end as host_prefix,
  o_orderkey % 97 <> 0 and o_orderkey % 4 = 0 as has_proxy,
  case when o_orderkey % 97 <> 0 and o_orderkey % 6 = 0 then 'r.x' end as registry,
  case when o_orderkey % 97 <> 0 then o_orderkey % 5 not in (0, 1) end as password_set,
  case when o_orderkey % 97 <> 0 then o_custkey % 3 + 1 end as masters,
  case when o_orderkey % 97 <> 0 then '10.0.0.1' end as first_ip
from orders""")

oracle("src2_states", """
select cluster_id, corrupt, case when not corrupt then status end as status,
  case when not corrupt then state_version::bigint end as state_version,
  case when not corrupt and k % 8 <> 1 then len(done) - len(replace(done, ',', '')) end as phases,
  case when not corrupt then case k % 3 when 0 then 'haproxy' when 1 then 'squid-proxy' else 'local-registry' end end
    as first_service,
  case when not corrupt and k % 7 = 0 then k % 21 = 0 end as vip_removed
from b_states""")

oracle("src3_markers", "select cluster_name, managed, failed, deleted, locked from b_clusters")

oracle("src4_locks", """
select cluster_id, case when cluster_id % 5 <> 0 then cluster_id end as lock_pid,
  case when cluster_id % 5 <> 0 then cast(epoch(timestamp '2024-03-01 08:00:00') as bigint) + 86400 * (cluster_id % 9) end
    as lock_time from b_clusters""")

oracle("src5_logs", "select doc_id, pos, line from b_lines")

VIEWS["o_file_lines"] = """
select cluster_name, row_number() over (partition by cluster_name order by doc_id, pos) as line_no, line from b_lines"""

oracle("src3_listed_markers", """
select 'c' || c_custkey as cluster_name, c_custkey % 2 = 0 as managed, c_custkey % 7 = 0 as failed,
  c_custkey % 11 = 0 as deleted, c_custkey % 6 = 0 as locked from customer""")

oracle("src4_listed_locks", """
select 'c' || c_custkey as cluster_name, case when c_custkey % 5 <> 0 then c_custkey end as lock_pid,
  case when c_custkey % 5 <> 0 then epoch(timestamp '2024-03-01 08:00:00')::bigint + (c_custkey % 9) * 86400 end as lock_time,
  true as dated from customer where c_custkey % 6 = 0""")

oracle("src5_numbered_logs", "select cluster_name, line_no, md5(line) as digest from o_file_lines")
oracle("src6_followed_logs", "select cluster_name, line_no, md5(line) as digest from o_file_lines")
oracle("src10_listed_files", """
select 'c' || c_custkey as cluster_name, 'config.yaml' as file, len('n: ' || c_custkey)::bigint as length, true as dated
from customer where c_custkey % 3 <> 0""")

oracle("w7_segments_of_files", r"""
select cluster_name, segment, min(line_no) as first_line, max(line_no) as last_line, count(*) as lines from (
  select cluster_name, line_no, count(*) filter (regexp_matches(line, '^[A-Z].*\.$'))
    over (partition by cluster_name order by line_no) as segment from o_file_lines) group by 1, 2""")

oracle("src7_manifests", r"""
select doc_id, pos, parts[1] as hash, parts[-1] as name from (
  select doc_id, pos, string_split(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' ') as parts
  from b_lines) where len(parts) >= 2""")

oracle("src8_inventory", """
select cast(system_name as varchar) as system_name, lpar_name, lpar_uuid, state from b_lpars""")

oracle("src9_sockets", """
select case when cluster_id % 4 = 0 then '[::]' else ip end as local_addr, system_id + 1000 as port,
  count(*) as sockets, min('users:(("' || hostname || '",pid=' || cluster_id || '))') as process
from b_nodes group by 1, 2""")

oracle("src9_host_lines", """
select 'eth' || (system_id % 4) as iface, 24::bigint as prefix, count(*) as lines, sum((cluster_id % 2 = 0)::int)::bigint as alive,
  sum((cluster_id % 6 = 0)::int)::bigint as unreadable,
  sum(case when cluster_id % 6 <> 0 then cluster_id * 1000 end)::bigint as avail_kb, count(*) as same
from b_nodes group by 1, 2""")

oracle("src10_files", """
select source as cluster_name, lang, count(*) as files, max(n_chars) as largest from documents group by 1, 2""")

oracle("snk1_report", """
select controller_id, count(*) filter (not deleted) as visible, count(*) filter (deleted) as prunable, count(*) as total
from b_clusters group by 1""")

oracle("snk2_snapshots", """
select strftime(ts, '%Y-%m-%d') as day, case when value < 20 then 'failed' else 'success' end as status, count(*) as snapshots
from events group by 1, 2""")

oracle("snk2_committed_runs", """
select case when user_id % 2 = 0 then 'even' else 'odd' end as run_id,
  case when value < 20 then 'failed' else 'success' end as status, count(*) as snapshots
from events where user_id is not null group by 1, 2""")

# --- projections -------------------------------------------------------------

oracle("p1_resolve_defaults", """
select controller_id, cluster_name, isolation, release_type, vip,
  case when isolation = 'air-gapped' and version <> '' then 'quay.io/openshift-release-dev/ocp-release:' || version
    || case when len(string_split(version, '.')) = 2 then '.0' else '' end || '-ppc64le' else '' end as release_image,
  case when isolation = 'air-gapped' and registry_managed then 'docker.io/library/registry:3.1.1' else '' end
    as registry_image,
  case when isolation = 'air-gapped' and registry_managed then 'ocp4/openshift4' else '' end as registry_repo,
  case when user_given <> '' then user_given when isolation = 'air-gapped' and registry_managed then 'admin' else '' end
    as registry_user,
  case when k % 16 = 0 then 'http://m/client' when version = '' then '' else
    'https://mirror.openshift.com/pub/openshift-v4/ppc64le/clients/ocp/' || version || '/openshift-client-linux.tar.gz'
    end as client_url,
  case when version = '' then '' else 'https://mirror.openshift.com/pub/openshift-v4/ppc64le/clients/ocp/' || version
    || '/openshift-install-linux.tar.gz' end as installer_url,
  case when version = '' then '' else 'https://mirror.openshift.com/pub/openshift-v4/ppc64le/clients/ocp/' || version
    || '/oc-mirror.tar.gz' end as mirror_url,
  case when k % 15 = 0 then 'http://m/kernel' when version = '' or boot_method = 'agent' then '' else
    'https://mirror.openshift.com/pub/openshift-v4/ppc64le/dependencies/rhcos/4.' || minor
    || '/latest/rhcos-live-kernel.ppc64le' end as kernel_url,
  case when version = '' or boot_method = 'agent' then '' else
    'https://mirror.openshift.com/pub/openshift-v4/ppc64le/dependencies/rhcos/4.' || minor
    || '/latest/rhcos-live-initramfs.ppc64le.img' end as initramfs_url,
  case when version = '' or boot_method = 'agent' then '' else
    'https://mirror.openshift.com/pub/openshift-v4/ppc64le/dependencies/rhcos/4.' || minor
    || '/latest/rhcos-live-rootfs.ppc64le.img' end as rootfs_url,
  case when k % 14 = 0 then '10.132.0.0/14' else '10.128.0.0/14' end as cluster_cidr,
  case when k % 15 = 0 then 22 else 23 end::bigint as host_prefix, '172.30.0.0/16' as service_network
from b_cfg""")

oracle("p2_managed_flags", """
select controller_id, cluster_name, dns_managed, dhcp_managed, pxe_managed, lb_managed, nfs_managed, proxy_managed,
  registry_block and registry_external = '' as registry_managed from b_cfg""")

oracle("p3_service_list", """
select controller_id, cluster_name, dhcp_managed and boot_method <> 'agent' as dhcp_active,
  pxe_managed and boot_method <> 'agent' as pxe_active, nfs_managed and boot_method = 'agent' as nfs_active,
  coalesce(nullif(concat_ws(', ', case when dns_managed then 'DNS' end,
    case when dhcp_managed and boot_method <> 'agent' then 'DHCP' end,
    case when pxe_managed and boot_method <> 'agent' then 'PXE' end, case when lb_managed then 'HAProxy' end,
    case when nfs_managed and boot_method = 'agent' then 'NFS' end), ''), 'None') as managed_services
from b_cfg""")

oracle("p4_explode_nodes", """
select controller_id, cluster_name, ord, placed as role, j as role_ord, hostname, ip, lpar_name, system_name, mac
from b_cn""")

oracle("p5_cluster_labels", """
select controller_id, cluster_name,
  case when k % 10 = 0 then 'Multi (agent)' else (case when nm = 1 then 'SNO' else 'Multi' end)
    || (case when boot_method = 'netboot' then ' (netboot)' else ' (agent)' end) end as cluster_type,
  case when k % 10 = 0 then 'Unknown' when isolation_given = 'air-gapped' then 'Air-Gapped'
    when isolation_given = 'restricted-network' then 'Restricted Network' else 'Connected' end as network_label,
  case when k % 10 = 0 or vip_given = '' then 'Unknown' else vip_given end as cluster_ip
from b_cfg""")

oracle("p6_service_modes", """
select controller_id, cluster_name,
  case when proxy_managed then 'managed' when proxy_http <> '' then 'external' else 'none' end as proxy_mode,
  case when proxy_managed then 'http://' || controller_ip || ':3128' else proxy_http end as proxy_url,
  case when registry_managed then 'managed' when isolation = 'air-gapped' then 'external' else 'official' end
    as registry_mode,
  case when registry_managed then controller_ip || ':5000' when isolation = 'air-gapped' then registry_external
    else '' end as registry_url
from b_cfg""")

oracle("p7_endpoints", """
select controller_id, cluster_name,
  case when status = 'completed' then 'https://api.' || domain || ':6443' end as api_url,
  case when status = 'completed' then 'https://console-openshift-console.apps.' || domain end as console_url,
  case when status = 'completed' then 'https://grafana-openshift-monitoring.apps.' || domain end as grafana_url,
  case when status = 'completed' then r.vip || ' api.' || domain || ' console-openshift-console.apps.' || domain
    || ' oauth-openshift.apps.' || domain || ' prometheus-k8s-openshift-monitoring.apps.' || domain
    || ' grafana-openshift-monitoring.apps.' || domain end as hosts_entry,
  r.vip || ' api.' || domain || ' api-int.' || domain || ' console-openshift-console.apps.' || domain
    || ' oauth-openshift.apps.' || domain as install_hosts_entry
from b_cfg r join b_clusters using (controller_id, cluster_name)""")

VIEWS["o_dns_common"] = """
select controller_id, cluster_name, 'A' as kind, 'api.' || domain as name, vip as value from b_cfg
union all select controller_id, cluster_name, 'A', '*.apps.' || domain, vip from b_cfg"""

oracle("p8_desired_dns", """
select q.* from (select * from o_dns_common
union all select b_cfg.controller_id, b_cfg.cluster_name, 'A', 'api-int.' || domain, case when b_cfg.nm = 1 then b_cn.ip else vip end
  from b_cfg left join b_cn on b_cn.cluster_name = b_cfg.cluster_name and b_cn.placed = 'sno'
union all select controller_id, cluster_name, 'A', hostname, ip from b_cn
union all select controller_id, cluster_name, 'A', hostname || '.' || cluster_name || '.' || base_domain, ip from b_cn
union all select controller_id, cluster_name, 'A', 'etcd-' || j || '.' || cluster_name || '.' || base_domain, ip
  from b_cn where placed = 'master'
union all select controller_id, cluster_name, 'SRV', '_etcd-server-ssl._tcp.' || cluster_name || '.' || base_domain,
  'etcd-' || j || '.' || cluster_name || '.' || base_domain || ' 2380 0 ' || j from b_cn where placed = 'master'
union all select controller_id, cluster_name, 'A', 'registry.' || domain, controller_ip from b_cfg
  where isolation = 'air-gapped' and registry_managed) q semi join (select controller_id, cluster_name from b_cfg where dns_managed) g
  using (controller_id, cluster_name)""")

oracle("p8_desired_dns_external", """
select q.* from (select * from o_dns_common
union all select controller_id, cluster_name, 'A', 'api-int.' || domain, vip from b_cfg
union all select controller_id, cluster_name, 'A', hostname, ip from b_cn) q semi join (select controller_id, cluster_name from b_cfg where not dns_managed) g
  using (controller_id, cluster_name)""")

oracle("p9_desired_dhcp", """
select q.* from (select controller_id, cluster_name, hostname, lower(mac) as mac, ip,
  case when mac = '' then 'pending' else 'reserved' end as state from b_cn) q semi join (select controller_id, cluster_name from b_cfg where dhcp_managed and boot_method <> 'agent') g
  using (controller_id, cluster_name)""")

oracle("p9_dhcp_network", """
select q.* from (select controller_id, cluster_name, string_split(machine_cidr, '/')[1] as network,
  case when net_ok then '255.255.0.0' else '255.255.255.0' end as netmask, gateway,
  case when dns_external <> '' then dns_external else controller_ip end as dns_server,
  case when pxe_external <> '' then pxe_external else controller_ip end as pxe_server from b_cfg) q semi join (select controller_id, cluster_name from b_cfg where dhcp_managed and boot_method <> 'agent') g
  using (controller_id, cluster_name)""")

VIEWS["o_member"] = """
select *, case when placed = 'sno' and hostname = '' then cluster_name else hostname end as host from b_cn"""

oracle("p10_desired_pools", """
select q.* from (with api as (select unnest([6443, 22623])::bigint as port), web as (
  select 80::bigint as port, 'http' as kind union all select 443, 'https')
select controller_id, cluster_name, port, host as member, ip as address, true as backup from o_member, api
  where placed = 'bootstrap' and j = 0
union all select controller_id, cluster_name, port, 'bootstrap', ip, true from o_member, api
  where placed = 'master' and j = 0 and nb = 0 and boot_method = 'agent'
union all select controller_id, cluster_name, port, host, ip, false from o_member, api where placed in ('master', 'sno')
union all select controller_id, cluster_name, port, host || case when placed = 'sno' then '-' || kind
  else '-' || kind || '-router0' end, ip, false from o_member, web where placed <> 'bootstrap') q semi join (select controller_id, cluster_name from b_cfg where lb_managed) g
  using (controller_id, cluster_name)""")

oracle("p10_desired_pools_external", """
select q.* from (with api as (select unnest([6443, 22623])::bigint as port), web as (select unnest([80, 443])::bigint as port)
select controller_id, cluster_name, port, host as member, ip as address, placed = 'bootstrap' as backup
  from o_member, api where placed <> 'worker'
union all select controller_id, cluster_name, port, host, ip, false from o_member, web
  where (nw > 0 and placed = 'worker') or (nw = 0 and placed in ('master', 'sno'))) q semi join (select controller_id, cluster_name from b_cfg where not lb_managed) g
  using (controller_id, cluster_name)""")

oracle("p11_required_ports", """
with w as (
  select 'http' as service, 'tcp' as proto, 8080::bigint as port, '' as label union all select 'dns', 'tcp', 53, ''
  union all select 'dns', 'udp', 53, '' union all select 'dhcp', 'udp', 67, '' union all select 'pxe', 'udp', 69, ''
  union all select 'lb', 'tcp', unnest([6443, 22623, 80, 443]), ''
  union all select 'nfs', 'service', null, unnest(['nfs', 'rpc-bind', 'mountd']))
select controller_id, cluster_name, service, proto, port, label from b_cfg, w
where case service when 'http' then boot_method <> 'agent' when 'dns' then dns_managed
  when 'dhcp' then dhcp_managed and boot_method <> 'agent' when 'pxe' then pxe_managed and boot_method <> 'agent'
  when 'lb' then lb_managed else nfs_managed and boot_method = 'agent' end""")

oracle("p12_version_parts", """
select controller_id, cluster_name, case when version = '' then '' else '4.' || minor end as minor,
  case when version = '' then '' when len(string_split(version, '.')) = 2 then version || '.0' else version end as tag,
  'stable-' || case when version = '' then '' else '4.' || minor end as channel from b_cfg""")

oracle("p13_split_failed", """
select event_id, event_type as event, case when event_id % 4 <> 0 then props || ': late' end as error from events""")

oracle("p14_redact", r"""
select page_id, md5(clean) as digest, len(clean) as size from (
  select page_id, regexp_replace(case when token = '' then html else replace(html, token, '***[REDACTED]***') end,
    '(<title>)[^\n]*?(</title>)', '\1***[REDACTED]***\2', 'gi') as clean
  from (select page_id, html, regexp_extract(url, '//([^./]+)', 1) as token from pages))""")

# --- rules -------------------------------------------------------------------

VIEWS["o_config_rules"] = """
select controller_id, cluster_name, unnest(list_filter([
  case when interface = '' then 'R01' end, case when k % 43 = 0 then 'R03' end, case when k % 47 = 0 then 'R04' end,
  case when k % 49 = 0 then 'R05' end, case when base_domain = '' then 'R06' end,
  case when machine_cidr = '' then 'R07' end, case when machine_cidr = 'bad' then 'R08' end,
  case when net_ok and gateway <> '' and not starts_with(gateway, '10.' || (k % 16) || '.0.') then 'R09' end,
  case when net_ok and not starts_with(vip, '10.' || (k % 16) || '.0.') then 'R10' end,
  case when net_ok and gateway = '' then 'R11' end, case when net_ok and dns_managed and forwarders = 0 then 'R12' end,
  case when version = '' then 'R15' end, case when release_type not in ('official', 'ci') then 'R16' end,
  case when pull_secret = '' then 'R17' end, case when ssh_key = '' then 'R18' end,
  case when version = '' and k % 16 <> 0 then 'R19' end, case when version = '' then 'R20' end,
  case when boot_method <> 'agent' and version = '' and k % 15 <> 0 then 'R21' end,
  case when boot_method <> 'agent' and version = '' then 'R22' end,
  case when boot_method <> 'agent' and version = '' then 'R23' end,
  case when isolation = 'air-gapped' and not registry_managed and registry_external = 'registry.example.com'
    then 'R25' end,
  case when isolation = 'restricted-network' and not proxy_managed and proxy_http = '' then 'R26' end
  ], lambda x: x is not null)) as rule_id from b_cfg"""

oracle("r01_config_rules", "select *, 'E' as severity from o_config_rules")

VIEWS["o_topology"] = """
select controller_id, cluster_name, problem as rule_id, case problem
  when 'R27' then 'one master together with other nodes' when 'R28' then 'fewer than three masters'
  when 'R29' then 'even number of masters' when 'R30' then 'netboot without bootstrap node'
  else 'agent boot with bootstrap node' end as message from b_sound where problem is not null
union all select controller_id, cluster_name, 'R32', 'agent boot without managed nfs' from b_sound
  where problem is null and boot_method = 'agent' and not nfs_managed
union all select controller_id, cluster_name, 'R33', 'external nfs without path' from b_sound
  where problem is null and not nfs_managed and nfs_path = ''
union all select controller_id, cluster_name, 'R42', 'netboot needs three masters, found ' || nm from b_sound
  where problem is null and nm <> 1 and boot_method = 'netboot' and nm <> 3
union all select controller_id, cluster_name, 'R43', 'netboot needs two workers, found ' || nw from b_sound
  where problem is null and nm <> 1 and boot_method = 'netboot' and nw < 2"""

oracle("r27_topology_rules", "select * from o_topology")

VIEWS["o_sound_nodes"] = """
select b_cn.* from b_cn join b_sound using (cluster_name) where problem is null"""

VIEWS["o_duplicates"] = """
select controller_id, cluster_name, rule_id, 'E' as severity,
  'duplicate ' || kind || ' ' || key || ': ' || prev || ', ' || hostname as message from (
  select *, lag(hostname) over (partition by cluster_name, rule_id, key order by ord) as prev from (
    select controller_id, cluster_name, ord, hostname, 'R34' as rule_id, 'address' as kind, ip as key from o_sound_nodes
    union all select controller_id, cluster_name, ord, hostname, 'R35', 'hostname', hostname from o_sound_nodes
    union all select controller_id, cluster_name, ord, hostname, 'R36', 'partition', lpar_name from o_sound_nodes))
where prev is not null"""

oracle("r34_duplicate_rules", "select * from o_duplicates")

VIEWS["o_node_rules"] = """
with p as (select *, case placed when 'master' then 'masters' when 'worker' then 'workers' else 'bootstrap' end
    || '[' || j || ']' as place, ip <> '' and ip <> 'x' as ip_ok,
    case placed when 'master' then 'R47' when 'bootstrap' then 'R48' else 'R49' end as rid from o_sound_nodes)
select controller_id, cluster_name, 'R37' as rule_id, 'node ' || hostname || ' address ' || ip || ' is outside '
  || machine_cidr as message from p where machine_cidr like '10.%' and ip_ok
  and not starts_with(ip, '10.' || (k % 16) || '.')
union all select controller_id, cluster_name, 'R38', 'single node address is empty or invalid: ' || ip from p
  where placed = 'sno' and not ip_ok
union all select controller_id, cluster_name, 'R39', 'single node system is empty' from p
  where placed = 'sno' and system_name = ''
union all select controller_id, cluster_name, 'R40', 'single node partition is empty' from p
  where placed = 'sno' and lpar_name = ''
union all select controller_id, cluster_name, rid, place || ' name is empty' from p where placed <> 'sno' and hostname = ''
union all select controller_id, cluster_name, rid, place || ' system is empty' from p
  where placed <> 'sno' and system_name = ''
union all select controller_id, cluster_name, rid, place || ' address is empty' from p where placed <> 'sno' and ip = ''
union all select controller_id, cluster_name, rid, place || ' partition is empty' from p
  where placed <> 'sno' and lpar_name = ''
union all select controller_id, cluster_name, rid, place || ' address is invalid: ' || ip from p
  where placed = 'master' and ip = 'x'"""

oracle("r37_node_rules", "select * from o_node_rules")

VIEWS["o_active"] = """
select controller_id, cluster_name, vip from b_clusters where (managed or failed) and not deleted and vip <> ''"""

oracle("r14_vip_state", """
with x as (
  select b_cfg.controller_id, b_cfg.cluster_name, b_cfg.vip, h.vip is not null as bound,
    (select min(a.cluster_name) from o_active a where a.controller_id = b_cfg.controller_id and a.vip = b_cfg.vip
      and a.cluster_name <> b_cfg.cluster_name) as held_by
  from b_cfg left join (select distinct controller_id, vip from b_clusters where cluster_id % 11 = 0 and vip <> '') h
    on h.controller_id = b_cfg.controller_id and h.vip = b_cfg.vip
  where lb_managed and interface <> '' and b_cfg.vip <> controller_ip and net_ok)
select controller_id, cluster_name, vip, held_by, case when bound and held_by is not null then 'in use by cluster'
  when bound then 'bound on interface' else 'assigned to cluster' end as problem
from x where bound or held_by is not null""")

oracle("r17_missing_paths", """
with have as (select distinct c_custkey % 50 as controller_id, unnest(['/s/' || (c_custkey % 30),
    '/k/' || (c_custkey % 15)]) as path from customer where c_custkey % 3 <> 0),
named as (select controller_id, cluster_name, 'R17' as rule_id, pull_secret as path from b_cfg
  union all select controller_id, cluster_name, 'R18', ssh_key from b_cfg)
select controller_id, cluster_name, rule_id, path from named where path <> ''
  and not exists (select 1 from have where have.controller_id = named.controller_id and have.path = named.path)""")

oracle("r50_absent_interfaces", """
select controller_id, cluster_name, interface from b_cfg where interface <> '' and controller_id not in (
  select c_custkey % 50 from customer where c_custkey % 50 % 4 <> 0)""")

oracle("r51_disk_rules", """
with d as (select *, case when k % 13 <> 0 then k * 1000 / 1048576.0 end as web,
  case when k % 17 <> 0 then k * 5000 / 1048576.0 end as reg,
  isolation = 'air-gapped' and registry_managed as needs from b_cfg)
select controller_id, cluster_name, 'R51' as rule_id, 'E' as severity from d where web < 10
union all select controller_id, cluster_name, 'R51', 'W' from d where web is null
union all select controller_id, cluster_name, 'R52', 'E' from d where web is not null and needs and reg < 40
union all select controller_id, cluster_name, 'R52', 'W' from d where web is not null and needs and reg is null""")

oracle("r54_vip_alive", """
select controller_id, cluster_name, vip from b_cfg c where lb_managed and vip <> controller_ip
  and exists (select 1 from b_clusters p where p.cluster_id % 6 = 0 and p.controller_id = c.controller_id and p.vip = c.vip)
  and not (interface = 'eth0' and exists (select 1 from b_clusters h where h.cluster_id % 11 = 0
    and h.controller_id = c.controller_id and h.vip = c.vip))""")

oracle("r55_live_node_addresses", """
select cluster_id, count(*) as conflicts from b_nodes where ip in (select ip from b_ping) group by 1""")

oracle("r64_external_rules", """
with e as (select b_cfg.*, (select count(*) from b_cn where b_cn.cluster_name = b_cfg.cluster_name and b_cn.ip = '') as missing
  from b_cfg where not (dns_managed and dhcp_managed and pxe_managed and lb_managed))
select controller_id, cluster_name, 'R64' as rule_id, 'W' as severity, 'external dns does not answer: ' || dns_external as message
  from e where not dns_managed and k % 2 = 1
union all select controller_id, cluster_name, 'R65', 'W', 'external dhcp must cover the nodes' from e
  where not dhcp_managed and missing > 0
union all select controller_id, cluster_name, 'R66', 'W', 'external pxe must serve the boot files' from e
  where not pxe_managed and boot_method <> 'agent'
union all select controller_id, cluster_name, 'R67', 'W', 'external balancer port ' || unnest(
  case when k % 3 = 0 then [6443, 80] else [443] end) || ' does not answer' from e where not lb_managed
union all select controller_id, cluster_name, 'R67', 'W', 'external balancer must be configured at ' || vip from e
  where not lb_managed""")

oracle("r68_state_rules", """
select controller_id, cluster_name, 'R68' as rule_id, 'state version is not set' as message from b_states
  where state_version = 0
union all select controller_id, cluster_name, 'R70', 'invalid status: ' || status from b_states where status in ('', 'odd')
union all select controller_id, cluster_name, 'R71', 'start time is not set' from b_states where start_time = ''
union all select controller_id, cluster_name, 'R73', 'cleanup is completed but state is not deleted' from b_states
  where k % 14 = 0
union all select controller_id, cluster_name, 'R72', 'unknown completed phase: ready_w-0' from b_states
  where k % 19 = 0 and k % 8 <> 1
union all select controller_id, cluster_name, 'R72', 'unknown completed phase: unknown' from b_states
  where k % 23 = 0 and k % 8 <> 1
union all select controller_id, cluster_name, 'R74', 'duplicate completed event: ' || e from (
  select k, controller_id, cluster_name, e, row_number() over (partition by k, e) as n from (
    select k, controller_id, cluster_name, unnest([cast(k % 3 as varchar), cast(k % 2 as varchar),
      cast(c % 3 as varchar), '0']) as e from b_states)) where n > 1""")

oracle("r74_repeated_lines", """
select doc_id, count(*) - count(distinct line) as repeats from b_lines group by 1
having count(*) > count(distinct line)""")

oracle("r75_scale_rules", """
with s as (select n.*, c.status, split_part(n.ip, '.', 2) = cast(n.cluster_id % 16 as varchar)
    and split_part(n.ip, '.', 3) <> '' as inside, n.ip in (select ip from b_ping) as alive
  from b_nodes n join b_clusters c using (cluster_id) where role = 'worker')
select cluster_id, hostname, lpar_name, 'R75' as rule_id, 'E' as severity, 'cluster is not completed: ' || status as message
  from s where status <> 'completed'
union all select cluster_id, hostname, lpar_name, 'R76', 'E', 'address ' || ip || ' is invalid or outside 10.'
  || (cluster_id % 16) || '.0.0/16' from s where not inside
union all select cluster_id, hostname, lpar_name, 'R77', 'E', 'address ' || ip || ' already answers' from s where alive""")

# Longer-family text as 128 characters 0 and 1; a dotted address is its mapped form, so one comparison serves both families.
VIEWS["b_wide_nodes"] = """
with m as (select *, substr(lpar_name, 2)::bigint as m from b_nodes),
hexes as (select *, printf('%x', cluster_id % 16) as x, printf('%x', m % 4096) as y from m)
select * exclude (ip, m, x, y), case
  when m % 7 <= 1 then 'fd00:' || upper(x) || '::' || y
  when m % 7 = 2 then 'FD00:0:0:0:0:0:' || upper(x) || ':' || upper(y)
  when m % 7 = 3 then '2001:db8:' || upper(x) || '::10.1.2.' || (m % 250)
  when m % 7 = 4 then '::FFFF:10.' || ((cluster_id + ord % 2) % 16) || '.7.' || (m % 250)
  when m % 7 = 5 then '10.' || (cluster_id % 16) || '.1.' || (m % 250)
  else 'fd00:::' || upper(x) end as ip from hexes"""

VIEWS["b_wide_nets"] = """
select k as cluster_id, case k % 6 when 0 then 'fd00:' || x || '::/32' when 1 then '2001:DB8:' || x || ':0:0:0:0:0/' || (k % 20 + 40)
  when 2 then '::ffff:10.' || (k % 16) || '.0.0/112' when 3 then 'fd00::' || x || ':0/' || (k % 40 + 95)
  when 4 then '10.' || (k % 16) || '.0.0/16' else 'fd00:' || x || '::/129' end as machine_cidr
from (select o_orderkey as k, printf('%x', o_orderkey % 16) as x from orders)"""

VIEWS["o_wide_texts"] = """
select distinct t, not contains(t, ':::') and not contains(t, 'g') as ok from (
  select ip as t from b_wide_nodes union all select string_split(machine_cidr, '/')[1] from b_wide_nets
  union all select vip from o_wide_configs union all select gateway from o_wide_configs)"""

VIEWS["o_wide_bits"] = """
with dotted as (select t, ok, string_split(regexp_extract(t, '[0-9]+[.][0-9.]+$'), '.') as d from o_wide_texts where ok and t <> ''),
plain as (select t, case when len(d) < 4 then lower(t) else
  case when contains(t, ':') then lower(regexp_replace(t, '[0-9]+[.][0-9.]+$', '')) else '::ffff:' end
  || printf('%02x%02x:%02x%02x', d[1]::int, d[2]::int, d[3]::int, d[4]::int) end as p from dotted),
sides as (select t, list_filter(string_split(string_split(p, '::')[1], ':'), lambda g: g <> '') as l,
  list_filter(string_split(coalesce(string_split(p, '::')[2], ''), ':'), lambda g: g <> '') as r from plain),
digits as (select t, array_to_string(list_transform(l, lambda g: lpad(g, 4, '0')), '') || repeat('0000', 8 - len(l) - len(r))
  || array_to_string(list_transform(r, lambda g: lpad(g, 4, '0')), '') as h from sides)
select t, array_to_string(list_transform(range(1, 33), lambda i:
  lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') as bits from digits"""

VIEWS["o_wide_nets"] = """
select cluster_id, machine_cidr, bits, case when contains(machine_cidr, ':') then 0 else 96 end + n as n,
  starts_with(bits, repeat('0', 80) || repeat('1', 16)) as four
from (select *, string_split(machine_cidr, '/')[2]::int as n from b_wide_nets) join o_wide_bits on t = string_split(machine_cidr, '/')[1]
where n <= 128"""

VIEWS["o_wide_configs"] = """
select controller_id, cluster_name, k, case when k % 7 = 0 then '' else 'fd00:' || case when k % 5 = 0 then '99' else printf('%x', k % 16) end
  || '::1' end as gateway, case k % 3 when 0 then 'FD00:' || printf('%x', k % 16) || ':0:0:0:0:0:5'
  when 1 then '::ffff:10.' || (k % 16) || '.0.9' else 'fd00::g' end as vip from b_cfg"""

oracle("s8_wide_networks", """
select n.cluster_id, n.ord, n.ip, w.machine_cidr, left(a.bits, g.n) = left(g.bits, g.n) as inside,
  case when g.bits is not null then if(g.four, 4, 6) end::bigint as net_family, (g.n - if(g.four, 96, 0))::bigint as bits,
  case when a.bits is not null then if(starts_with(a.bits, repeat('0', 80) || repeat('1', 16)), 4, 6) end::bigint as family
from b_wide_nodes n join b_wide_nets w using (cluster_id) left join o_wide_nets g using (cluster_id)
left join o_wide_bits a on a.t = n.ip""")

oracle("j8_wide_outside", """
select n.cluster_id, n.ord, n.ip, g.machine_cidr from b_wide_nodes n join o_wide_nets g using (cluster_id)
left join o_wide_bits a on a.t = n.ip where coalesce(left(a.bits, g.n) <> left(g.bits, g.n), true)""")

oracle("r09_wide_config_rules", """
with c as (select c.*, w.machine_cidr, g.n, g.bits, gw.bits as gb, vb.bits as vb from o_wide_configs c
  join b_wide_nets w on w.cluster_id = c.k left join o_wide_nets g on g.cluster_id = c.k
  left join o_wide_bits gw on gw.t = c.gateway left join o_wide_bits vb on vb.t = c.vip)
select controller_id, cluster_name, 'R02' as rule_id, 'E' as severity, 'vip is no address: ' || vip as message from c where vb is null
union all select controller_id, cluster_name, 'R08', 'E', 'machine network is invalid: ' || machine_cidr from c where n is null
union all select controller_id, cluster_name, 'R09', 'E', 'gateway ' || gateway || ' is outside ' || machine_cidr from c
  where n is not null and gateway <> '' and left(gb, n) <> left(bits, n)
union all select controller_id, cluster_name, 'R10', 'E', 'vip ' || vip || ' is outside ' || machine_cidr from c
  where n is not null and coalesce(left(vb, n) <> left(bits, n), true)
union all select controller_id, cluster_name, 'R11', 'E', 'gateway is empty' from c where n is not null and gateway = ''""")

oracle("r76_wide_scale_rules", """
with s as (select n.*, c.status, w.machine_cidr, g.n, g.bits, a.bits as ab, case when role = 'master' then 'masters' else 'workers' end
    || '[' || ord || ']' as place from b_wide_nodes n join b_clusters c using (cluster_id) join b_wide_nets w using (cluster_id)
  left join o_wide_nets g using (cluster_id) left join o_wide_bits a on a.t = n.ip)
select cluster_id, hostname, lpar_name, 'R37' as rule_id, 'E' as severity,
  'node ' || hostname || ' address ' || ip || ' is outside ' || machine_cidr as message from s where left(ab, n) <> left(bits, n)
union all select cluster_id, hostname, lpar_name, 'R47', 'E', place || ' address is invalid: ' || ip from s where role = 'master' and ab is null
union all select cluster_id, hostname, lpar_name, 'R75', 'E', 'cluster is not completed: ' || status from s where status <> 'completed'
union all select cluster_id, hostname, lpar_name, 'R76', 'E', 'address ' || ip || ' is invalid or outside ' || machine_cidr from s
  where ab is null or left(ab, n) <> left(bits, n)
union all select cluster_id, hostname, lpar_name, 'R77', 'E', 'address ' || ip || ' already answers' from s where ord % 3 = 0""")

VIEWS["o_preflight"] = """
select controller_id, cluster_name, rule_id from o_config_rules
union all select controller_id, cluster_name, rule_id from o_topology
union all select controller_id, cluster_name, rule_id from o_node_rules
union all select controller_id, cluster_name, rule_id from o_duplicates"""

oracle("a3_rollup", """
select b_raw.controller_id, b_raw.cluster_name, count(rule_id) as errors, 0::bigint as warnings, count(rule_id) = 0 as passed,
  min(rule_id) as first_rule
from b_raw left join o_preflight p using (cluster_name) group by 1, 2""")

VIEWS["o_host"] = """
select controller_id, cluster_name, 'R14' as rule_id, 'E' as severity, 'address ' || vip || ' is ' || case
  when bound and held_by is not null then 'in use by cluster' when bound then 'bound on interface' else 'assigned to cluster' end
  || ' ' || coalesce(held_by, '') as message
from (select c.*, (select min(a.cluster_name) from o_active a where a.controller_id = c.controller_id and a.vip = c.vip
    and a.cluster_name <> c.cluster_name) as held_by, interface = 'eth0' and exists (select 1 from b_clusters h
    where h.cluster_id % 11 = 0 and h.controller_id % 4 <> 0 and h.controller_id = c.controller_id and h.vip = c.vip) as bound
  from b_cfg c where lb_managed and interface <> '' and vip <> controller_ip and net_ok and vip <> '')
where bound or held_by is not null
union all select controller_id, cluster_name, rule_id, 'E', case rule_id when 'R17' then 'pull secret' else 'ssh key' end
  || ' file is missing: ' || path from o_missing
union all select controller_id, cluster_name, 'R50', 'E', 'interface is not on the host: ' || interface from b_cfg
where interface <> '' and not (interface = 'eth0' and controller_id in (
  select controller_id from b_clusters where cluster_id % 11 = 0 and vip <> '' and controller_id % 4 <> 0))
union all select controller_id, cluster_name, 'R53', 'E', 'files of this name are already on the host'
from b_clusters where cluster_id % 4 in (0, 1)
union all select controller_id, cluster_name, 'R54', 'E', 'address already answers: ' || vip from b_cfg c
where lb_managed and vip <> controller_ip and vip <> ''
  and exists (select 1 from b_clusters p where p.cluster_id % 6 = 0 and p.controller_id = c.controller_id and p.vip = c.vip)
  and not (interface = 'eth0' and exists (select 1 from b_clusters h where h.cluster_id % 11 = 0
    and h.controller_id % 4 <> 0 and h.controller_id = c.controller_id and h.vip = c.vip))"""

VIEWS["o_missing"] = ORACLES["r17_missing_paths"]

VIEWS["o_inventory"] = """
select controller_id, cluster_name, 'R60' as rule_id, 'E' as severity, case when system_id % 9 = 0
  then 'system not found: ' || system_id else 'partition not found: ' || lpar_name || ' on ' || system_id end as message
from b_nodes join b_clusters using (cluster_id) where system_id % 9 = 0 or (system_id + substr(lpar_name, 2)::bigint) % 4 = 0
union all select controller_id, cluster_name, 'R61', 'E', 'partition is running: ' || lpar_name || ' on ' || system_id
from b_nodes join b_clusters using (cluster_id) where system_id % 9 <> 0
  and (system_id + substr(lpar_name, 2)::bigint) % 4 <> 0 and substr(lpar_name, 2)::bigint % 3 = 0
union all select controller_id, cluster_name, 'R55', 'E', 'address already answers: ' || hostname || ' ' || ip
from b_nodes join b_clusters using (cluster_id) where (controller_id, ip) in (
  select (controller_id, ip) from b_nodes join b_clusters using (cluster_id) where cluster_id % 10 = 0)"""

oracle("r60_inventory_violations", "select * from o_inventory")

VIEWS["o_external"] = ORACLES["r64_external_rules"]

oracle("r53_host_violations", "select * from o_host")

oracle("a3_report_pages", """
select controller_id, (n - 1) // 3 as page, string_agg(message, ' | ' order by n) as messages from (
  select controller_id, message, row_number() over (partition by controller_id order by rule_id, message) as n
  from o_topology) group by 1, 2""")

# --- filters -----------------------------------------------------------------

oracle("fl1_visible", "select controller_id, cluster_name from b_clusters where not deleted")
oracle("fl2_active", "select controller_id, cluster_name from b_clusters where (managed or failed) and not deleted")
oracle("fl3_prunable", "select controller_id, cluster_name from b_clusters where deleted")
oracle("fl4_resumable", """
select controller_id, cluster_name, (case when status <> '' then status when coalesce(end_clock, '') <> '' then 'completed' else 'in_progress' end) as status from b_states
where (case when status <> '' then status when coalesce(end_clock, '') <> '' then 'completed' else 'in_progress' end) in ('in_progress', 'failed') and done <> '' and k % 25 <> 0""")
oracle("fl5_create_gate", """
select controller_id, cluster_name, case when deleted then 'fresh' when failed then 'resume' when managed then 'refuse'
  else 'start' end as decision,
  case when deleted then 'fresh' when locked then 'locked' else 'exists' end as directory_decision from b_clusters""")
oracle("fl6_has_external", """
select controller_id, cluster_name, dns_external <> '' or dhcp_external <> '' or pxe_external <> '' or lb_external <> ''
    as checked,
  dns_external <> '' or lb_external <> '' or (boot_method <> 'agent' and (dhcp_external <> '' or pxe_external <> ''))
    or (boot_method = 'agent' and nfs_external <> '') as reported from b_cfg""")
oracle("fl7_classify", """
select cluster_name, case when contains(lower(line), 'license') then 'license' when contains(lower(line), 'password')
    then 'secret' when contains(lower(line), 'the') then 'the' when contains(line, 'Un ') then 'un' end as error_class,
  not contains(lower(line), 'license') and not contains(lower(line), 'password') and contains(lower(line), 'the') as benign,
  count(*) as lines
from b_lines group by all""")

oracle("fl7_rule_table", """
with rules as (select unnest([0, 1, 2, 3])::bigint as ord, unnest(['no release found', 'unauthorized', 'invalid credentials',
    'no space left on device']) as needle, unnest(['missing_release', 'auth', 'auth', 'disk_full']) as name,
    false as benign, true as any_case
  union all select doc_id + 100, substr(text, 4, 11), 'd' || doc_id, doc_id % 3 = 0, doc_id % 2 = 0 from documents where len(text) >= 14),
lines as (select doc_id, pos, case when pos % 5 = 0 then line || ' UNAUTHORIZED' else line end as line from b_lines),
hits as (select l.doc_id, l.pos, min(r.ord) as ord from lines l join rules r on case when r.any_case
  then contains(lower(l.line), lower(r.needle)) else contains(l.line, r.needle) end group by 1, 2)
select r.name as error_class, coalesce(r.benign, false) as benign, count(*) as lines, min(l.doc_id) as first_doc
from lines l left join hits using (doc_id, pos) left join rules r on r.ord = hits.ord group by 1, 2""")

oracle("a11_merged_sketches", """
select event_type as phase, share, count(*) as runs, true as within from events, (select unnest([0.5::double, 0.9, 0.99]) as share)
group by 1, 2""")

oracle("s19_file_digests", """
with f as (select c_custkey as k, unnest(['config.yaml', '.managed', '.failed', '.deleted', '.lock']) as name from customer)
select 'c' || k as folder, name, len(content)::bigint as length, sha256(content) as sha256 from (
  select k, name, case name when 'config.yaml' then 'n: ' || k when '.lock' then case when k % 5 = 0 then 'garbage' else
    'Locked at: 2024-03-0' || (k % 9 + 1) || 'T10:00:00+02:00' || chr(10) || 'PID: ' || k || chr(10) end else '' end as content
  from f where case name when 'config.yaml' then k % 3 <> 0 when '.managed' then k % 2 = 0 when '.failed' then k % 7 = 0
    when '.deleted' then k % 11 = 0 else k % 6 = 0 end)""")

# --- joins -------------------------------------------------------------------

oracle("j1_vip_conflicts", f"""
select c.controller_id, c.cluster_name, c.vip, min(a.cluster_name) as held_by, c.status,
  {human('c.elapsed_s')} as age
from b_clusters c join o_active a on a.controller_id = c.controller_id and a.vip = c.vip
  and a.cluster_name <> c.cluster_name
where not c.deleted group by c.controller_id, c.cluster_name, c.vip, c.status, c.elapsed_s""")

for _svc, _test in (("proxy", "proxy_managed"), ("registry", "registry_block and registry_external = ''")):
    oracle(f"j2_shared_{_svc}", f"""
with u as (select controller_id, cluster_name, ({_test}) and k % 7 <> 0 as uses from b_cfg)
select controller_id, cluster_name, n - uses::int as other_users, n - uses::int > 0 as shared
from u join (select controller_id, count(*) filter (uses) as n from u group by 1) using (controller_id)""")

oracle("j3_lpar_check", """
select system_id as system_name, case when state is null then 'missing' when state = 'running' then 'running' else 'ok' end
    as verdict, count(*) as nodes, min(n.lpar_name) as first_lpar
from b_nodes n left join b_lpars l on l.system_name = n.system_id and l.lpar_name = n.lpar_name group by 1, 2""")

oracle("j4_enrich_nodes", """
with -- a host listed again counts as listed last
found as (select * from b_discovered
  union all select * replace ('a-' || uuid as uuid, ord + 20 as ord) from b_discovered where cluster_id % 4 = 0),
latest as (select * from found f where not exists (select 1 from found g
  where g.cluster_id = f.cluster_id and g.hostname = f.hostname and g.ord > f.ord))
select n.cluster_id, n.ord, n.hostname, n.role, d.uuid, coalesce(d.mac, n.mac) as mac
from b_nodes n left join latest d on d.cluster_id = n.cluster_id and d.hostname = n.hostname""")

oracle("j5_discover", """
with x as (select n.system_id as system_name, l.lpar_uuid, l.mix from b_nodes n
  left join b_lpars l on l.system_name = n.system_id and l.lpar_name = n.lpar_name)
select system_name, case when lpar_uuid is null then 'partition not found' when mix % 6 = 0 then 'no profile'
    when mix % 5 = 0 then 'no network adapter' end as error,
  case when lpar_uuid is not null and mix % 5 <> 0 then 'mac2' end as mac, count(*) as nodes,
  min(case when mix % 6 <> 0 then 'p0-' || lpar_uuid end) as profile,
  max(case when mix % 5 <> 0 then lpar_uuid end) as place
from x group by 1, 2, 3""")

oracle("j6_scale_down", """
select cluster_id, ord, hostname, lpar_name from b_discovered
where role = 'worker' and cluster_id % 3 = 0 and hostname = 'n7'""")

oracle("j7_scale_up", """
with x as (select n.*, s.done,
    exists (select 1 from b_cn o where o.cluster_name = n.cluster_name and o.hostname = n.hostname and o.ord % 2 = 0) as live
  from b_cn n join b_states s using (cluster_name) where n.placed = 'worker')
select controller_id, cluster_name, ord, hostname, case when live then 'backfill' else 'add' end as action,
  not live and not (k % 17 = 0 and k % 8 <> 1 and hostname = 'm-1') as pending_boot, 'ready_' || hostname as marker
from x where not (k % 19 = 0 and k % 8 <> 1 and hostname = 'w-0')""")

oracle("j8_outside_network", """
select n.cluster_id, n.ord, n.ip, '10.' || (n.cluster_id % 16) || '.0.0/16' as machine_cidr
from b_nodes n join orders on o_orderkey = n.cluster_id
where split_part(n.ip, '.', 2) <> cast(n.cluster_id % 16 as varchar)""")

oracle("j9_live_conflicts", "select cluster_id, ord, ip from b_nodes where ip in (select ip from b_ping)")

oracle("j10_port_collisions", """
with sockets as (select c_custkey % 50 as controller_id, case when c_custkey % 5 = 0 then 'udp' else 'tcp' end as proto,
    ([80, 443, 6443, 53, 5000, 3128, 22623])[c_custkey % 7 + 1] as port,
    case c_custkey % 3 when 0 then '0.0.0.0' when 1 then '10.1.0.1' else '[::]' end as addr,
    case c_custkey % 4 when 0 then 'haproxy' when 1 then 'dnsmasq' else 'x' end as process from customer),
need as (
  select controller_id, cluster_name, unnest([80, 443, 6443, 22623]) as port, 'tcp' as proto, 'haproxy' as owner, vip as own_addr
    from b_cfg where lb_managed
  union all select controller_id, cluster_name, 53, unnest(['udp', 'tcp']), 'dnsmasq', controller_ip from b_cfg where dns_managed
  union all select controller_id, cluster_name, 5000, 'tcp', '', controller_ip from b_cfg
    where isolation = 'air-gapped' and registry_managed
  union all select controller_id, cluster_name, 3128, 'tcp', 'squid', controller_ip from b_cfg where proxy_managed)
select distinct controller_id, cluster_name, n.port::bigint as port, proto, owner, own_addr
from need n join sockets s using (controller_id, proto, port)
where (addr <> '10.1.0.1' or addr = own_addr) and (owner = '' or process <> owner)
  and not (n.port = 5000 and controller_id % 4 = 0)""")

VIEWS["o_held"] = ORACLES["j10_port_collisions"]

VIEWS["o_ports"] = """
select controller_id, cluster_name, case when port = 53 then 'R57' when port = 5000 then 'R58' when port = 3128 then 'R59'
  else 'R56' end as rule_id, 'E' as severity, proto || ' port ' || port || ' is held by another process' as message from o_held"""

oracle("r56_port_violations", "select * from o_ports")

oracle("j11_stale_media", """
with -- wanted media in any drive: mapped; every other filled drive is stale
drive as (select vios_uuid, lpar_uuid, min(media_name) as held from b_maps where cluster_id % 4 <> 0 group by 1, 2
  union select vios_uuid, lpar_uuid, unnest(['old.iso', 'zz.iso']) from b_maps where cluster_id % 3 = 0),
per_node as (select m.cluster_id, m.node_name, m.media_name, m.vios_uuid, m.lpar_uuid,
    (select count(*) from drive d where d.vios_uuid = m.vios_uuid and d.lpar_uuid = m.lpar_uuid and held = m.media_name) as fit,
    (select count(*) from drive d where d.vios_uuid = m.vios_uuid and d.lpar_uuid = m.lpar_uuid and held <> m.media_name) as odd
  from b_maps m)
select cluster_id, case when fit > 0 then 'mapped' when odd > 0 then 'stale' else 'absent' end as status,
  count(*) as nodes, sum(odd)::bigint as other_media
from per_node group by 1, 2""")

VIEWS["o_server"] = """
select controller_id, cluster_name, cluster_id, unnest(['rhcos/kernel', 'rhcos/initramfs.img', 'rhcos/rootfs.img']) as path
from b_clusters where not deleted"""

oracle("j12_missing_files", """
select controller_id, cluster_name, path from o_server where (cluster_id + len(path)) % 3 = 0""")

oracle("j12_missing_folders", """
with w as (select controller_id, cluster_name, cluster_id, unnest(['ignition', 'rhcos', 'tools', 'scripts']) as folder
  from b_clusters where not deleted)
select controller_id, cluster_name, folder from w where case folder when 'ignition' then cluster_id % 2 <> 0
  when 'rhcos' then cluster_id % 3 <> 0 when 'tools' then cluster_id % 5 <> 0 else true end""")

oracle("j12_missing_helper_files", """
with w as (select cluster_id, unnest(['ignition/bootstrap.ign', 'ignition/master.ign', 'ignition/worker.ign',
  'rhcos/rhcos-live-kernel-ppc64le', 'rhcos/rhcos-live-initramfs.ppc64le.img', 'rhcos/rhcos-live-rootfs.ppc64le.img',
  'tools/openshift-install', 'tools/oc', 'tools/kubectl']) as path from b_clusters where not deleted)
select path, count(*) as clusters from w where (cluster_id + len(path)) % 3 = 0 group by 1""")

oracle("j13_name_collisions", """
with named as (select * replace (case when cluster_id % 8 < 4 then 'a-' else '' end || cluster_name as cluster_name)
  from b_clusters)
select controller_id, cluster_name, case cluster_id % 4 when 0 then '/var/www/html/' || cluster_name || '/x'
    when 1 then '/etc/dnsmasq.d/10-x-' || cluster_name || '-my-dns.conf'
    else '/etc/haproxy/conf.d/' || case when cluster_id % 8 = 2 then '10' else '99' end || '-' || cluster_name || '.cfg' end as path,
  cluster_id % 8 = 6 as legacy
from named where cluster_id % 3 <> 0 and cluster_id % 4 <> 3""")

oracle("j14_download_action", """
select doc_id, case when doc_id % 11 = 0 then 'wipe'
  when doc_id % 5 <> 1 and doc_id % 7 = 0 then 'fetch' when doc_id % 5 = 0 then 'wipe' when doc_id % 5 <> 1 then 'skip'
  when doc_id % 7 <> 0 and n_chars > 0 then 'skip' else 'fetch' end as action from documents""")

oracle("j15_resolve_uuid", """
with -- the first listed entry with an id
listed as (select cluster_id, hostname, ord, case when ord = 1 then '' else uuid end as uuid from b_discovered),
known as (select distinct on (cluster_id, hostname) cluster_id, hostname, uuid from (
    select * from listed
    union all select cluster_id, hostname, ord + 20, 'a-' || uuid from listed where cluster_id % 4 = 0)
  where uuid <> '' order by cluster_id, hostname, ord)
select n.cluster_id, n.hostname, n.lpar_name, coalesce(k.uuid, l.lpar_uuid) as resolved_uuid,
  case when k.uuid is not null then 'state' when l.lpar_uuid is not null then 'inventory' else 'unknown' end as uuid_source
from b_nodes n left join known k using (cluster_id, hostname)
  left join b_lpars l on l.system_name = n.system_id and l.lpar_name = n.lpar_name""")

oracle("j16_was_managed", """
with past as (select k, bool_or(m % 3 = 0 and m % 2 = 0) as lb, bool_or(m % 3 = 1 and m % 2 = 0) as proxy,
    bool_or(m % 3 = 2 and m % 2 = 0) as registry
  from (select k, k + unnest(range(k % 3 + 1)) as m from b_raw) group by 1)
select controller_id, cluster_name, lb_managed or lb as was_lb_managed, proxy_managed or proxy as was_proxy_managed,
  (isolation = 'air-gapped' and registry_managed) or registry as was_registry_managed
from b_cfg join past using (k)""")

oracle("j17_reconcile", """
with seen as (
  select cluster_id, ord, hostname, case when ord = 2 then '0.0.0.0' else ip end as ip from b_nodes where cluster_id % 9 <> 0
  union all select cluster_id, ord + 100, hostname, ip from b_nodes where cluster_id % 10 = 3)
select coalesce(n.cluster_id, s.cluster_id) as cluster_id, coalesce(n.ord, s.ord) as ord,
  case when s.ip is null then 'add' when n.ip is null then 'remove' when s.ip = n.ip and s.hostname = n.hostname then 'same'
    else 'change' end as action, n.ip as want_ip, s.ip as have_ip
from b_nodes n full join seen s on s.cluster_id = n.cluster_id and s.ord = n.ord""")

oracle("j17_reconcile_values", """
with want as (select distinct cluster_id, role, ip from b_nodes),
have as (select * from want where len(ip) % 3 <> 0 union select cluster_id, role, ip || '9' from want where cluster_id % 10 = 3)
select *, 'same' as action from (select * from want intersect select * from have)
union all select *, 'add' from (select * from want except select * from have)
union all select *, 'remove' from (select * from have except select * from want)""")

oracle("j18_purge_leases", """
with lease as (select distinct lower(replace(mac, '-', ':')) as m, ip || case when cluster_id % 2 = 0 then '1' else '' end as a,
    '1700000000 ' || m || ' ' || a || ' h *' as line from b_nodes),
macs as (select distinct lower(replace(mac, '-', ':')) as m from b_nodes where cluster_id % 50 = 0),
ips as (select distinct ip as a from b_nodes where cluster_id % 50 = 0)
select distinct line, 'exact' as mode from lease
  where m in (select m from macs) or a in (select a from ips)
union all select distinct line, 'substring' from lease
  where m in (select m from macs) or exists (select 1 from ips where contains(lease.a, ips.a))""")

oracle("j19_orphans", """
select lpad(cast(m.cluster_id as varchar), 9, '0') as cluster_name,
  case when o_orderkey % 7 = 0 then 'deleted' else 'boot method' end as reason, count(*) as mappings
from b_maps m join orders on o_orderkey = m.cluster_id where o_orderkey % 7 = 0 or o_orderkey % 3 <> 0 group by 1, 2""")

oracle("j20_rename_context", """
select cluster_id, case when hostname = 'n1' then 'c-' || cluster_id else hostname end as name, count(*) as entries
from b_nodes group by 1, 2""")

oracle("j20_overlay", """
select distinct on (cluster_id, hostname) cluster_id, hostname, ord, kind, lpar_name from (
  select cluster_id, hostname, ord, 'old' as kind, lpar_name, 0 as layer from b_discovered
  union all select cluster_id, hostname, ord, 'new', lpar_name, 1 from b_nodes where cluster_id % 2 = 0)
order by cluster_id, hostname, layer desc, ord desc""")

# --- aggregations ------------------------------------------------------------

VIEWS["o_need"] = """
select cluster_id, system_id, count(*) as nodes, sum(count(*)) over (partition by cluster_id)::bigint as cluster_nodes
from b_nodes group by 1, 2"""

oracle("a1_media_need", """
select cluster_id, system_id, nodes, cluster_nodes, nodes * 1536 as need_mb, greatest(nodes * 1536, 10240) as create_mb,
  greatest(cluster_nodes * 1536, 10240) as boot_create_mb from o_need""")

oracle("a1_capacity", """
with v as (select distinct on (system_name) system_name, size_mb, free_mb from b_vios
  where state = 'running' and rmc_state = 'active' order by system_name, ord),
x as (select cluster_id, system_id as system_name, nodes * 1536 as need_mb, v.system_name is not null as ok, size_mb, free_mb,
    case when v.size_mb = 0 then (select group_name from b_vgs g where g.system_name = v.system_name
      and g.free >= greatest(nodes * 1536, 10240) / 1024.0 order by group_name = 'rootvg', g.ord limit 1) end as target_vg
  from o_need left join v on v.system_name = o_need.system_id)
select cluster_id, system_name, need_mb, target_vg, case when not ok then 'W no active server'
  when size_mb = 0 and target_vg is not null then 'create' when size_mb = 0 then 'R63'
  when free_mb < need_mb then 'R62' else 'ok' end as verdict from x""")

VIEWS["o_capacity"] = ORACLES["a1_capacity"]
VIEWS["o_disk"] = ORACLES["r51_disk_rules"]

VIEWS["o_media"] = """
select controller_id, cluster_name, case verdict when 'R63' then 'R63' else 'R62' end as rule_id,
  case when verdict like 'R%' then 'E' else 'W' end as severity,
  case verdict when 'R62' then 'media repository is full on ' || system_name || ', needed MB: ' || need_mb
    when 'R63' then 'no volume group for a media repository on ' || system_name
    else 'media repository is not checked on ' || system_name end as message
from o_capacity join b_clusters using (cluster_id) where verdict not in ('ok', 'create') and cluster_id % 3 = 0"""

oracle("r62_capacity_violations", "select * from o_media")

oracle("a3_full_rollup", """
with v as (select cluster_name, rule_id, 'E' as severity from o_preflight
  union all select cluster_name, rule_id, severity from o_host
  union all select cluster_name, rule_id, severity from o_disk
  union all select cluster_name, rule_id, severity from o_inventory
  union all select cluster_name, rule_id, severity from o_media
  union all select cluster_name, rule_id, severity from o_ports
  union all select cluster_name, rule_id, severity from o_external)
select b_raw.controller_id, b_raw.cluster_name, count(*) filter (where severity = 'E') as errors,
  count(*) filter (where severity = 'W') as warnings, count(*) filter (where severity = 'E') = 0 as passed,
  min(rule_id) filter (where severity = 'E') as first_rule
from b_raw left join v using (cluster_name) group by 1, 2""")

oracle("a2_topology", """
select cluster_id, count(*) as nodes, count(*) filter (role = 'master') as masters,
  count(*) filter (role = 'worker') as workers, 0::bigint as bootstraps from b_nodes group by 1""")

oracle("a4_poweroff_tally", """
select cluster_id, count(*) filter (ord % 6 <> 5 and ord % 3 = 0) as accepted,
  count(*) filter (ord % 6 <> 5 and ord % 3 = 1) as already_off, count(*) filter (ord % 6 <> 5 and ord % 3 = 2) as failed,
  count(*) filter (ord % 6 = 5) as skipped, count(*) as total from b_discovered group by 1""")

oracle("a5_barrier", """
select cluster_id, count(*) filter (state is null or state = 'not activated') as met, count(*) as total,
  bool_and(state is null or state = 'not activated') as all_met
from b_nodes n left join b_lpars l on l.system_name = n.system_id and l.lpar_name = n.lpar_name group by 1""")

oracle("a6_mapping_plan", """
select system_name, vios_uuid, lpar_uuid, (n - 1) // 2 as call, string_agg(media_name, ',' order by n) as media from (
  select *, row_number() over (partition by system_name, vios_uuid, lpar_uuid order by ord, media_name) as n from b_maps)
group by 1, 2, 3, 4""")

oracle("a7_media_to_delete", "select distinct cluster_id, vios_uuid, media_name from b_maps")

oracle("a7_mounts_to_unmount", """
select cluster_id, mount_point, vios_uuid, 'shared' as form from (
  select distinct on (cluster_id, mount_point) * from b_maps where mount_point <> ''
  order by cluster_id, mount_point, ord, vios_uuid)
union all select distinct cluster_id, mount_point, vios_uuid, 'by server' from b_maps where mount_point <> ''""")

oracle("a8_disk_usage", """
select source as cluster_name, lang as subdirectory, sum(n_chars)::bigint as bytes, count(*) as files from documents group by 1, 2""")

oracle("a9_history_summary", """
with n as (select *, count(*) over (partition by doc_id) as total from b_lines)
select doc_id, 1::bigint as phases, max(total) as events, greatest(0, max(total) - 20) as omitted, 0::bigint as failures,
  md5(string_agg(line, chr(10) order by pos) filter (total <= 20 or pos < 10 or pos >= total - 10)) as sample
from n group by 1""")

oracle("a10_fleet_counts", """
select controller_id, count(*) filter (not deleted) as visible, count(*) filter (deleted) as prunable,
  count(*) filter (managed and not deleted) as managed, count(*) filter (failed and not deleted) as failed,
  count(*) as total from b_clusters group by 1""")

oracle("a11_phase_stats", """
select event_type as phase, count(*) as runs, count(*) filter (value < 20) as failures,
  min(cast(floor(value * 1000) as bigint)) as shortest, max(cast(floor(value * 1000) as bigint)) as longest,
  quantile_disc(cast(floor(value * 1000) as bigint), 0.5) as p50,
  quantile_disc(cast(floor(value * 1000) as bigint), 0.9) as p90,
  quantile_disc(cast(floor(value * 1000) as bigint), 0.99) as p99 from events group by 1""")

# --- windows -----------------------------------------------------------------

for _name, _key, _label in (("w1_duplicates", "hostname", "lpar_name"), ("w1_duplicate_lpars", "lpar_name", "hostname")):
    oracle(_name, f"""
select cluster_id, ord, {_key}, previous_holder, occurrence from (
  select cluster_id, ord, {_key}, lag({_label}) over w as previous_holder, row_number() over w as occurrence from b_nodes
  window w as (partition by cluster_id, {_key} order by ord)) where occurrence > 1""")

oracle("w2_latest_with_attempts", """
select user_id as cluster_id, event_type as phase, arg_max(event_id, (ts, event_id)) as event_id,
  arg_max(case when value < 20 then 'failed' else 'success' end, (ts, event_id)) as status,
  arg_max(cast(floor(value * 1000) as bigint), (ts, event_id)) as dur_ms, count(*) as attempts from events group by 1, 2""")

oracle("w3_inventory_as_of", """
with stock as (select system_name, lpar_name, 'running' as state from b_lpars where system_name % 2 = 1
  or system_name not in (select system_name from b_lpars where substr(lpar_name, 2)::bigint % 5 <> 0)
  union all select system_name, lpar_name, state from b_lpars where system_name % 2 = 0 and substr(lpar_name, 2)::bigint % 5 <> 0)
select system_id as system_name, case when state is null then 'missing' when state = 'running' then 'running' else 'ok' end
  as verdict, count(*) as nodes, min(state) as state
from b_nodes n left join stock s on s.system_name = n.system_id and s.lpar_name = n.lpar_name group by 1, 2""")

for _name, _dir in (("w3_keep_last", "desc"), ("w3_keep_first", "asc")):
    oracle(_name, f"""
select distinct on (cluster_id, hostname) * from b_discovered order by cluster_id, hostname, ord {_dir}""")

oracle("w4_head_tail", """
select doc_id, pos, case when pos < 10 then 'head' else 'tail' end as part, pos + 1 as position,
  greatest(0, total - 20) as omitted, md5(line) as digest
from (select *, count(*) over (partition by doc_id) as total from b_lines) where pos < 10 or pos >= total - 10""")

oracle("w5_config_changes", """
select conv_id, turn, h as content_hash, p as previous_hash from (
  select conv_id, turn, sha256(v) as h, lag(sha256(v)) over (partition by conv_id order by turn) as p
  from (select conv_id, turn, case when turn % 4 >= 2 then 'same' else coalesce(text, '') end as v from conversations))
where p is not null and p <> h""")

_ORDER = ("discovery", "downloads", "services", "ignition", "boot", "wait")
oracle("w6_command_deltas", f"""
select conv_id, turn, concat_ws(',', {', '.join(
    f"case when t % {i + 3} <> 1 and t % {i + 2} <> 0 then '{p}' end" for i, p in enumerate(_ORDER))}) as added,
  sum((role = 'user' and t % 2 = 0)::int) over (partition by conv_id order by turn)::bigint as resume_count
from (select *, len(text) as t from conversations)""")

oracle("w7_segment_log", r"""
select doc_id, segment, min(pos) as first_line, max(pos) as last_line, count(*) as lines,
  md5(coalesce(max(case when h = 1 then line end), '')) as title from (
  select *, sum(h) over (partition by doc_id order by pos)::bigint as segment from (
    select *, regexp_matches(line, '^[A-Z].*\.$')::int as h from b_lines)) group by 1, 2""")

oracle("w8_pair_requests", """
with e as (select user_id as cluster_name, 'https://h/rest/' || event_type as url, event_id, epoch_us(ts) as t_us,
    case when event_id % 3 = 0 then 'open' when event_id % 7 = 0 then 'error' when event_id % 5 = 0 then null else 'close' end as kind
  from events),
r as (select *, sum((kind = 'open')::int) over w as o, sum((kind <> 'open')::int) over w as c from e where kind is not null
  window w as (partition by cluster_name, url order by t_us, event_id))
select cluster_name, url, (case when kind = 'open' then o else c end)::bigint as turn,
  min(case when kind = 'open' then t_us end) as opened_at, min(case when kind <> 'open' then t_us end) as closed_at,
  bool_or(kind = 'error') as failed, bool_or(case when kind = 'open' then o - c > 1 else o - c >= 1 end) as ambiguous,
  min(case when kind <> 'open' then t_us end) is null as unanswered
from r group by 1, 2, 3""")

oracle("w9_first_master", """
select controller_id, cluster_name, placed as role, arg_min(hostname, ord) as first, count(*) as nodes
from b_cn group by 1, 2, 3""")

# --- lists and reports -------------------------------------------------------

VIEWS["o_listed"] = f"""
select *, case when started is null then 'N/A' when end_clock is not null then
    case when took > 0 then {human('took')} else 'N/A' end
  when fixed = 'in_progress' then {human('running')} || '*' else 'N/A' end as duration from b_age"""

oracle("t1_fleet_list", """
select c.controller_id, c.cluster_name, case when s.corrupt then 'unknown' else fixed end as status,
  case when s.corrupt then 'N/A' when vip_given = '' then 'Unknown' else vip_given end as cluster_ip,
  case when s.corrupt then 'N/A' else (case when nm = 1 then 'SNO' else 'Multi' end)
    || (case when boot_method = 'netboot' then ' (netboot)' else ' (agent)' end) end as type,
  case when s.corrupt then 'N/A' when isolation_given = 'air-gapped' then 'Air-Gapped'
    when isolation_given = 'restricted-network' then 'Restricted Network' else 'Connected' end as network,
  case when s.corrupt then 'N/A' else duration end as duration,
  case when s.corrupt or end_clock = 'soon' then 'N/A' when end_clock is not null then replace(end_clock, 'T', ' ')
    else strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') end as last_updated
from b_clusters c join o_listed s using (cluster_name) join b_cfg using (cluster_name) where not c.deleted""")

oracle("t2_latest_backup", """
select o_custkey as cluster_id, '/w/' || max(n) as path, max(n) as name from (
  select o_custkey, 'state.json.backup-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') as n from orders where o_orderkey % 5 <> 0)
group by 1""")

oracle("t3_active_vios", """
select distinct on (system_name) system_name, ord, vios_uuid, vios_name, state, rmc_state from b_vios
where state = 'running' and rmc_state = 'active' order by system_name, ord""")

oracle("t4_pick_vg", """
select distinct on (system_name) system_name, group_name from b_vgs where free >= system_name % 13 * 1.5 + 10
order by system_name, group_name = 'rootvg', ord""")

oracle("t5_fleet_detail", f"""
select r.controller_id, r.cluster_name, fixed as status,
  case when marks = '' then '' else string_split(marks, ',')[-1] end as phase,
  case when nm = 1 then 'SNO' else 'Multi-Node' end as type, version,
  case when started is null then 'N/A' when end_clock is not null then case when took > 0 then {human('took')}
      || case when fixed = 'in_progress' then '*' else '' end else 'N/A' end
    when fixed = 'in_progress' and running > 0 then {human('running')} || '*' else 'N/A' end as duration,
  r.c % 4 as resume_count,
  case when fixed = 'completed' then vip || ' api.' || domain || ' console-openshift-console.apps.' || domain
    || ' oauth-openshift.apps.' || domain || ' prometheus-k8s-openshift-monitoring.apps.' || domain
    || ' grafana-openshift-monitoring.apps.' || domain end as hosts_entry,
  nfs_managed and boot_method = 'agent' as managed_nfs,
  case when proxy_managed then 'managed' when proxy_http <> '' then 'external' else 'none' end as proxy_mode,
  case when registry_managed then controller_ip || ':5000' when isolation = 'air-gapped' then registry_external
    else '' end as registry_url,
  case when fixed = 'completed' then 'https://oauth-openshift.apps.' || domain end as oauth, 'm-0' as first_node
from b_cfg r join b_age using (cluster_name)""")

# --- sets --------------------------------------------------------------------

oracle("u1_dedupe_events", """
select doc_id, sum(n - 1)::bigint as events_removed, md5(string_agg(line, chr(10) order by first)) as digest from (
  select doc_id, line, min(pos) as first, count(*) as n from b_lines group by 1, 2) group by 1""")

oracle("u2_resume_plan", f"""
select controller_id, cluster_name, concat_ws(',', {', '.join(
    f"case when not resumes or k % 8 = 1 or k % {n} <> 0{extra} then '{p}' end" for p, n, extra in (
        ("discovery", 2, ""), ("downloads", 3, " or k % 4 = 0"), ("services", 5, ""), ("ignition", 7, " or k % 6 = 0"),
        ("boot", 11, ""), ("wait", 13, "")))}) as plan
from (select *, (case when status <> '' then status when coalesce(end_clock, '') <> '' then 'completed' else 'in_progress' end) in ('in_progress', 'failed') and done <> '' and k % 25 <> 0 as resumes from b_states)""")

oracle("u3_boot_plan", """
select controller_id, cluster_name, ord, hostname from b_cn where not (k % 17 = 0 and k % 8 <> 1 and hostname = 'm-1')""")

oracle("u4_drop_markers", """
select controller_id, cluster_name,
  trim(replace(replace(done || ',', ',booted_m-1,', ','), ',ready_w-0,', ','), ',') as phases from b_states""")

oracle("u5_repair", """
select controller_id, cluster_name, 2::bigint as state_version, fixed as status,
  concat_ws(',', cast(k % 3 as varchar), case when k % 2 <> k % 3 then cast(k % 2 as varchar) end,
    case when c % 3 <> k % 3 and c % 3 <> k % 2 then cast(c % 3 as varchar) end,
    case when 0 not in (k % 3, k % 2, c % 3) then '0' end) as events,
  case when k % 6 = 0 then 1 else 0 end::bigint as failures from b_age""")

oracle("u6_cleanup_remaining", """
select distinct controller_id, cluster_name, step, item from (
  select controller_id, cluster_name, k, unnest(['power_off', 'unmap_media']) as step, hostname as item from b_cn
  union all select controller_id, cluster_name, cluster_id, 'remove_vip', 'vip' from b_clusters
  union all select controller_id, cluster_name, cluster_id, 'remove_service', unnest(['haproxy', 'dnsmasq']) from b_clusters)
where not (k % 7 = 0 and ((step = 'power_off' and item in ('m-0', 'm-2')) or (step = 'unmap_media' and item = 'm-1')
  or (step = 'remove_service' and item = 'haproxy') or (step = 'remove_vip' and k % 21 = 0)))""")

oracle("u7_union_nodes", """
select r.controller_id, r.cluster_name, (r.nb + r.nm + r.nw)::bigint as nodes, string_agg(hostname, ',' order by role, j) as names
from b_raw r join b_all_nodes using (cluster_name) group by 1, 2, 3""")

# --- scalars -----------------------------------------------------------------

oracle("s2_human_duration", f"""
select cluster_id, {human('(elapsed_s % 20000)')} as age from b_clusters""")

oracle("s4_elapsed", f"""
select cluster_id, case when started is null then 'N/A' when end_clock is not null then
    case when took > 0 then {human('took')} else 'N/A' end
  when status = 'in_progress' then {human('running')} || '*' else 'N/A' end as listed,
  case when started is null then 'N/A' when end_clock is not null then case when took > 0 then {human('took')} else 'N/A' end
  when status = 'in_progress' and running > 0 then {human('running')} || '*' else 'N/A' end as detailed,
  case when end_clock <> 'soon' then replace(end_clock, 'T', ' ') end as ended from b_age""")

oracle("s5_duration_seconds", """
select event_id, case when v > 60000 then v else v % 60000 end as ms from (
  select event_id, cast(floor(value * 1000) as bigint) as v from events)""")

oracle("s6_addresses", """
select cluster_id, ord, true as valid, 10 * 16777216 + split_part(ip, '.', 2)::bigint * 65536
  + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint as value, false as five, false as led,
  6::bigint as family from b_nodes""")

oracle("s7_networks", """
select cluster_id, p <= 32 as valid, case when p <= 32 then p end as prefix,
  case when p > 32 then '255.255.255.0' else
    ((mask // 16777216) || '.' || (mask // 65536 % 256) || '.' || (mask // 256 % 256) || '.' || (mask % 256)) end as mask,
  a as address, case when p <= 32 then 4 // pow(2, 32 - p)::bigint = 9 // pow(2, 32 - p)::bigint end as inside
from (select cluster_id, cluster_id % 40 as p, '10.' || (cluster_id % 16) || '.3.4' as a,
  4294967296 - pow(2, 32 - least(cluster_id % 40, 32))::bigint as mask from b_clusters)""")

oracle("s9_names", """
select cluster_id, ord, lower(replace(mac, '-', ':')) as mac, true as host_ok, false as dash_ok,
  substr('cluster-with-a-long-name-' || lpar_name, 1, 30) as media, lpad(lpar_name, 36, 'a') as link,
  null::varchar as short, lpar_name || '.tgz' as file from b_nodes""")

oracle("s11_checksums", """
select doc_id, sha256(text) as digest, case doc_id % 5 when 1 then 'length' when 2 then 'hex' end as problem from documents""")

oracle("s15_sizes", """
select system_name, vios_name, cast(round(size_mb / 1024.0 * 1000) as bigint) as thousandths,
  cast(floor(free_mb) as bigint) as gb from b_vios""")

oracle("s16_collections", """
select cluster_id, case when contains(done || ',', ',boot,') then substr(done, 2) else substr(done || ',boot', 2) end as appended,
  case when done like ',discovery%' then 'discovery' when done like ',downloads%' then 'downloads' end as first_d,
  case when k % 2 = 0 then 'new' else status end as a, k % 2 = 1 as has_c, case when k % 2 = 0 then 2 else 3 end::bigint as entries
from b_states""")

oracle("s18_json_path", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, null::varchar as none from events""")

# --- streaming ---------------------------------------------------------------

oracle("st1_follow_logs", """
select doc_id, pos, case when contains(t, 'not found') or contains(t, 'manifest unknown') then 'missing_image'
    when contains(t, 'unauthorized') or contains(t, 'invalid credentials') then 'auth'
    when contains(t, 'no space left on device') then 'disk_full' end as error_class,
  md5(case when pos % 2 = 0 then '<Tok>***[REDACTED]***</Tok> unauthorized' else line end) as digest
from (select *, lower(line) || case when pos % 2 = 0 then ' unauthorized' else '' end as t from b_lines)""")

oracle("st2_pending_requests", """
-- told at first, and again after more than ten minutes without a report
select user_id as cluster_name, event_type as name from (
  select *, lag(ts) over (partition by user_id, event_type order by ts) as before from events where event_id % 3 <> 0)
where before is null or ts - before > interval 600 second""")

for _name, _limit in (("st3_wait_for_ready", 64800), ("st4_phase_deadline", 5400)):
    oracle(_name, f"""
with t as (select user_id, event_type, min(ts) as started, min(case when value > 10 then ts end) as ready_at from events group by 1, 2),
w as (select user_id, count(*) as targets, min(started) + interval {_limit} second as deadline,
  count(*) filter (ready_at <= started + interval {_limit} second) as ready, max(ready_at) as last from t group by 1)
select user_id as cluster_name, targets, ready, case when ready = targets then 'ready' else 'timed_out' end as verdict,
  epoch_us(case when ready = targets then last else deadline end) as resolved_at
from w where ready = targets or (select max(ts) from events) >= deadline""")

oracle("st3_keyed_waits", """
with t as (select user_id, event_type, min(case when value > 10 then ts end) as ready_at from events group by 1, 2),
s as (select user_id, min(ts) + interval 64800 second as deadline from events group by 1),
w as (select user_id, deadline, count(*) as targets, count(*) filter (ready_at <= deadline) as ready, max(ready_at) as last
  from t join s using (user_id) group by 1, 2)
select user_id as cluster_name, targets, ready, case when ready = targets then 'ready' else 'timed_out' end as verdict,
  epoch_us(case when ready = targets then last else deadline end) as resolved_at
from w where ready = targets or (select max(ts) from events) >= deadline""")

oracle("st5_stale_locks", """
select controller_id, cluster_name, lock_pid, case when lock_pid > 0 then case when exists (select 1 from customer
    where c_custkey = lock_pid and c_custkey % 50 = controller_id) then 'held' else 'stale' end
  when 6000 - (cluster_id % 3) * 3000 > 3600 then 'stale' else 'held' end as verdict
from (select *, case when cluster_id % 4 <> 0 then cluster_id end as lock_pid from b_clusters where locked)""")

oracle("st6_state_changes", """
select user_id as cluster_name, 'add' as action, arg_max(event_type, (ts, event_id)) as status,
  arg_max(cast(floor(value) as bigint), (ts, event_id)) as resume_count from events group by 1""")

oracle("st7_bursts", """
with s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as burst from (
  select user_id, ts, (ts >= coalesce(lag(ts) over (partition by user_id order by ts), timestamp '1970-01-01')
    + interval 30 minute)::int as fresh from events))
select user_id as cluster_name, epoch_us(min(ts)) as burst_start, epoch_us(max(ts) + interval 30 minute) as burst_end,
  count(*) as lines from s group by user_id, burst
having max(ts) + interval 30 minute <= (select date_trunc('millisecond', max(ts)) from events) - interval 1 hour""")
